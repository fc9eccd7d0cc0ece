"""Conversations in reply order, with quotations linked to the messages they come from and taken out of the text.

Everything here is DataFrame functions. A line's quote level is the number of ``>`` it begins with. Consecutive lines of
one level are a passage; quoted blank lines cut it into paragraphs. A message's own text is its lines of level 0 without the line that announces a quotation
(``... wrote:``). Own text is cut into units: all of it, its paragraphs and its lines. Passages and units are normalised
(lower case, letters and digits only, single blanks) and compared by hash inside their conversation.

A passage comes from the latest earlier message with an equal unit; a passage that equals none is tried by its paragraphs,
and a paragraph that equals none line by line, so paragraphs may be left out and wrapped anew. A message replies to the source of most of its level-1 text, else to that of its least quoted level with a source, else to
the message before it. Depth and first message of a thread follow by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.session import drop_staged, stage

QUOTE = r"^(?:[ \t]*>)+"
ANNOUNCED = r"(?i)^.*\b(wrote|writes|schrieb|a écrit|escribió)\b.*:\s*$"
BLOCK = 1024
MAX_DOUBLINGS = 40


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, QUOTE, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _key(plain: Column) -> Column:
    return F.when(plain != "", F.md5(plain.cast("binary")))


def _messages(conversations: DataFrame) -> DataFrame:
    """Messages with a number each, their lines and own text. Of rows with one (conv_id, turn) all stay, numbered apart."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    lines = F.split("body", r"\r?\n")
    own = F.filter(
        lines,
        lambda x, i: (_level(x) == 0) & ~(x.rlike(ANNOUNCED) & (_level(F.coalesce(F.get(F.split("body", r"\r?\n"), i + 1), F.lit(""))) > 0)),
    )
    quoting = F.col("body").rlike("(?m)" + QUOTE)
    # most texts quote nothing and need no line by line look
    text = F.when(quoting, F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).otherwise(F.col("body"))
    return rows.withColumn("id", F.monotonically_increasing_id()).withColumn("quoting", quoting).withColumn("text", text)


def _before(messages: DataFrame) -> DataFrame:
    """(id, before): the message before each one in its conversation, by (turn, id).

    Windows see at most the messages of ``BLOCK`` turn numbers; the last message of a block is carried to the next one.
    """
    place = F.struct("turn", "id")
    keyed = messages.where("conv_id IS NOT NULL").select("conv_id", "id", "turn", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"), place.alias("place"))
    inside = Window.partitionBy("conv_id", "block").orderBy("place")
    ends = keyed.groupBy("conv_id", "block").agg(F.max("place").alias("last"))
    earlier = ends.withColumn("carried", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))).select("conv_id", "block", "carried")
    found = keyed.withColumn("own", F.lag("place").over(inside)).join(earlier, ["conv_id", "block"])
    return found.select("id", F.coalesce("own.id", "carried.id").alias("before"))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv_id, id, turn, level, island, para, line_at, n, key): quoted passages, their paragraphs and their lines.

    ``para`` is null for a whole passage, ``line_at`` for a passage or paragraph.
    """
    lines = messages.where("quoting").select("conv_id", "id", "turn", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line"))
    levelled = lines.withColumn("level", _level(F.col("line"))).where("level > 0").withColumn("line", F.regexp_replace("line", QUOTE + " ?", ""))
    order = Window.partitionBy("id", "level").orderBy("at")
    blanks = F.sum(F.when(F.col("line").rlike(r"^\s*$"), 1).otherwise(0)).over(order)
    islands = levelled.withColumn("island", F.col("at") - F.row_number().over(order)).withColumn("para", blanks)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    place = ("conv_id", "id", "turn", "level", "island")
    whole = islands.groupBy(*place).agg(_plain(joined).alias("plain"))
    paragraphs = islands.groupBy(*place, "para").agg(_plain(joined).alias("plain"))
    single = islands.select(*place, "para", _plain(F.col("line")).alias("plain"), F.col("at").alias("line_at"))
    keyed = single.unionByName(paragraphs, True).unionByName(whole, True).withColumn("key", _key(F.col("plain"))).where("key IS NOT NULL")
    return keyed.select(*place, "para", "line_at", F.length("plain").alias("n"), "key")


def _units(messages: DataFrame) -> DataFrame:
    """(conv_id, key, turn, id): the own text of messages, whole, by paragraph and by line."""
    parts = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[ \t\r]*\n"), F.split("text", r"\n")))
    return messages.select("conv_id", "turn", "id", F.explode(parts).alias("part")).select("conv_id", "turn", "id", _key(_plain(F.col("part"))).alias("key")).where("key IS NOT NULL").distinct()


def _sources(messages: DataFrame) -> DataFrame:
    """(id, source): the message that each quoting message answers by its quotations.

    Passages and units of one key are put in order of turn together, and a passage takes the last unit before it, so a
    sentence that comes and is quoted very often makes no pairs.
    """
    passages = stage(_passages(messages), "passages")
    # only conversations with quotations are looked at
    units = _units(messages.join(passages.select("conv_id").distinct(), "conv_id", "left_semi"))
    line = passages.select("conv_id", "key", "turn", "id", "level", "island", "para", "line_at", "n", F.lit(None).cast("bigint").alias("unit"))
    both = line.unionByName(units.withColumn("unit", F.col("id")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "key").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("source", F.last("unit", ignorenulls=True).over(before)).where("unit IS NULL AND source IS NOT NULL AND source <> id")
    # paragraphs count only where their whole passage has no source, lines only where their paragraph has none either
    whole = met.where("para IS NULL").select("id", "level", "island").withColumn("found", F.lit(True))
    parts = met.where("para IS NOT NULL AND line_at IS NULL").select("id", "level", "island", "para").withColumn("part_found", F.lit(True))
    traced = met.join(whole, ["id", "level", "island"], "left").join(parts, ["id", "level", "island", "para"], "left")
    counted = traced.where("para IS NULL OR (found IS NULL AND (line_at IS NULL OR part_found IS NULL))")
    weight = counted.groupBy("id", "level", "source").agg(F.sum("n").alias("n"))
    # the least quoted level first, then the most text, then the later message
    best = weight.groupBy("id").agg(F.min_by("source", F.struct("level", -F.col("n"), -F.col("source"))).alias("source"))
    return best


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotations), reply_to, quoted, thread, depth.

    ``reply_to`` and ``thread`` are turns, ``quoted`` says whether a quotation gave the link; sorted by (conv_id, thread,
    depth, turn) every message stands after the one it answers. Null texts are empty texts; null turns come first in their
    conversation; messages without conv_id are threads of their own. Repeated rows are messages of their own, in an order
    of their own. Other columns are not read; an empty table gives no rows.
    """
    messages = stage(_messages(conversations), "messages")
    links = messages.select("id", "conv_id", "turn").join(_before(messages), "id", "left").join(_sources(messages), "id", "left")
    links = links.select("id", "turn", F.coalesce("source", "before").alias("parent"), F.col("source").isNotNull().alias("quoted"))
    links = stage(links, "links")
    # every step doubles the distance that ``up`` looks ahead; at the end it is the first message of the thread
    walk = stage(links.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "walk")
    for _ in range(MAX_DOUBLINGS):
        ahead = walk.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        after = stage(walk.join(ahead, "up").select("id", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "walk")
        moved = after.where("moved").limit(1).count()
        drop_staged(walk)
        walk = after.drop("moved")
        if not moved:
            break
    turns = messages.select("id", "turn")
    parents = turns.select(F.col("id").alias("parent"), F.col("turn").alias("reply_to"))
    threads = turns.select(F.col("id").alias("up"), F.col("turn").alias("thread"))
    placed = links.select("id", "parent", "quoted").join(walk, "id").join(parents, "parent", "left").join(threads, "up", "left")
    return messages.join(placed, "id").select("conv_id", "turn", "role", "text", "reply_to", "quoted", "thread", "depth")
