"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns, known by a 128-bit sum over its turns of hashes of (place, role, text).
Nodes whose members all go on alike to the same end need no search: their totals follow from the length that is left.
The other nodes are dealt to shards by whole subtrees: a shard root is the first node on a path with at most
``SHARD_MEMBERS`` members, so that the nodes above shard roots are at most the number of turns divided by that. Each shard
sorts its nodes by reverse level order (an external sort of Spark's) and passes totals up through a priority queue that
spills sorted runs to disk: a node takes the messages addressed to it off the queue and sends its own total to its
parent. The same is then done over the nodes above, with the totals of shard roots as messages.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.session import drop_staged, ship_package, stage

SHARD_MEMBERS = 1 << 14
#: Entries of a queue in memory before a sorted run goes to disk.
QUEUE_ENTRIES = 200_000
#: Most turns that a conversation takes over from the first of its group of ``GROUP``.
HEADS, GROUP = 9, 5
#: Decimal ids joined to one piece before they are hashed.
PIECE_IDS = 8192

_MASK = (1 << 64) - 1


class SpillingQueue:
    """Priority queue of (key, payload), smallest key first; beyond ``limit`` entries sorted runs go to unnamed files."""

    def __init__(self, limit: int = QUEUE_ENTRIES):
        self.limit, self.heap, self.runs, self.count = limit, [], [], 0

    def push(self, key: tuple, payload: tuple) -> None:
        self.count += 1  # sets equal keys apart, so that payloads are never compared
        heapq.heappush(self.heap, (key, self.count, payload))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        entries = sorted(self.heap)
        self.heap = []
        file = tempfile.TemporaryFile()
        for at in range(0, len(entries), 1024):
            pickle.dump(entries[at : at + 1024], file)
        file.seek(0)
        run = self._read(file)
        self.runs.append([next(run), run])
        heapq.heapify(self.runs)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def pop_all(self, key: tuple) -> Iterator[tuple]:
        """Payloads of all entries with ``key``, which must be the smallest one there is, or not there."""
        while True:
            from_run = self.runs and (not self.heap or self.runs[0][0] < self.heap[0])
            if not from_run and not self.heap:
                return
            entry = self.runs[0][0] if from_run else self.heap[0]
            if entry[0] != key:
                return
            if from_run:
                following = next(self.runs[0][1], None)
                if following is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, [following, self.runs[0][1]])
            else:
                heapq.heappop(self.heap)
            yield entry[2]


def _scan(df: DataFrame, group: str, order: list[str], local, kind: str, sums: list[str], held: list[DataFrame]) -> DataFrame:
    """Running sums over each group in ``order``, with no group gathered in one task.

    Rows are dealt by ranges of (group, order, a number of their own); ``local`` adds each task's running sums ``sums``
    to its rows, and the totals of a group in earlier tasks (two groups a task at most go beyond it) are added after.
    The written table that the result reads is noted in ``held``.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie")
    inside = ranged.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_task", F.spark_partition_id())
    scanned = stage(inside.mapInArrow(local, kind), "scanned")
    held.append(scanned)
    totals = scanned.groupBy(group, "_task").agg(*(F.max_by(s, "_nth").alias(s) for s in sums))
    # a group's tasks: one row each, for groups that have several
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    several = totals.withColumn("_tasks", F.count("*").over(Window.partitionBy(group))).where("_tasks > 1")
    carried = several.select(group, "_task", *(F.sum(F.col(s).cast("decimal(38,0)")).over(earlier).alias(f"_{s}") for s in sums))
    # at most two groups a task: no more rows than twice the number of tasks
    joined = scanned.join(F.broadcast(carried), [group, "_task"], "left")
    wrapped = [F.col(s).cast("decimal(38,0)") + F.coalesce(f"_{s}", F.lit(0)) for s in sums]
    return joined.withColumns(dict(zip(sums, wrapped, strict=True))).drop("_task", "_nth", *(f"_{s}" for s in sums))


def _group_place(ids: np.ndarray, state: list) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of runs of one id, place of each row in its group so far); ``state`` holds the last id and its count."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
    if state and state[0] == ids[0]:
        place[: starts[1] if len(starts) > 1 else len(ids)] += state[1]
    state[:] = [ids[-1], int(place[-1])]
    return starts, place


def _number(batches):
    state: list = []
    for batch in batches:
        if batch.num_rows:
            _, place = _group_place(batch.column("conv_id").to_numpy(), state)
            place = pa.array(place.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, place, place], [*batch.schema.names, "place", "_nth"])


def ordered_turns(conversations: DataFrame, held: list[DataFrame]) -> DataFrame:
    """(conv_id, place from 1, role, text): turns in order (null first; equal turns by role and text)."""
    source = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    kind = "conv_id bigint, turn bigint, role string, text string, _task int, place bigint, _nth bigint"
    return _scan(source, "conv_id", ["turn", "role", "text"], _number, kind, ["place"], held).select("conv_id", F.col("place").cast("bigint").alias("place"), "role", "text")


def rebuilt(conversations: DataFrame, held: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with the first turns taken over from the first conversation of each group."""
    own = stage(ordered_turns(conversations, held), "turns")
    held.append(own)
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = sizes.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = stage(convs.withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    # a base's first turns: less than HEADS rows, for at most GROUP conversations
    heads = own.where(F.col("place") < HEADS).select(F.col("conv_id").alias("base"), "place", "role", "text")
    first = convs.where("taken > 0").join(heads, "base").where("place <= taken").select("conv_id", "place", "role", "text", "len")
    rest = own.join(convs.where("own > h").select("conv_id", "h", "taken", "len"), "conv_id").where("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text", "len")
    turns = first.unionByName(rest).select(
        "conv_id", "place", "len", F.octet_length("text").cast("bigint").alias("bytes"),
        F.xxhash64(F.lit(1), "place", "role", "text").alias("k1"), F.xxhash64("place", "text", F.lit(2), "role").alias("k2"),
    )
    return turns, convs


def _prefix_sums(batches):
    state: list = []
    carry = [0, 0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        goes_on = bool(state) and state[0] == ids[0]
        starts, nth = _group_place(ids, state)
        sums = []
        for i, name in enumerate(("bytes", "k1", "k2")):
            own = batch.column(name).to_numpy().view(np.uint64)
            total = np.cumsum(own)
            before = (total - own)[starts]
            if goes_on:
                before[0] -= np.uint64(carry[i])
            total = total - np.repeat(before, np.diff(np.append(starts, len(ids))))
            carry[i] = int(total[-1])
            sums.append(pa.array(total.view(np.int64)))
        columns = {c: batch.column(c) for c in ("conv_id", "place", "len", "_task")}
        own = [batch.column(c) for c in ("bytes", "k1", "k2")]
        yield pa.RecordBatch.from_arrays(
            [*columns.values(), *own, *sums, pa.array(nth.astype(np.int64))], [*columns, "bytes", "o1", "o2", "to_here", "k1", "k2", "_nth"]
        )


def _wrapped(name: str) -> F.Column:
    """A sum of 64-bit hashes modulo 2**64, as a long."""
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    rest = F.pmod(F.col(name), whole)
    return F.when(rest >= F.lit(str(1 << 63)).cast("decimal(38,0)"), rest - whole).otherwise(rest).cast("bigint").alias(name)


def prefixes(conversations: DataFrame, held: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a row per conversation and place with the keys of its prefix there and of the one before, conversations)."""
    turns, convs = rebuilt(conversations, held)
    turns = turns.select("conv_id", "place", "len", "bytes", "k1", "k2")
    kind = "conv_id bigint, place bigint, len bigint, _task int, bytes bigint, o1 bigint, o2 bigint, to_here bigint, k1 bigint, k2 bigint, _nth bigint"
    summed = _scan(turns, "conv_id", ["place"], _prefix_sums, kind, ["to_here", "k1", "k2"], held)
    summed = summed.withColumns({"p1": F.col("k1") - F.col("o1"), "p2": F.col("k2") - F.col("o2")})
    return summed.select("conv_id", "place", "len", "bytes", F.col("to_here").cast("bigint").alias("to_here"), *map(_wrapped, ("k1", "k2", "p1", "p2"))), convs


TOTALS = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint"


def _pass_up(batches):
    """Nodes in reverse level order to nodes with totals, each written when its parent is met; tops without a parent.

    Totals of a node that leads to one end only are in its row; the others' are what comes up to them and their own.
    """
    queue = SpillingQueue()
    out: list[tuple] = []
    columns = [c.split()[0] for c in TOTALS.split(", ")]

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(columns))], columns)
        out.clear()
        return batch

    names = ("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "own", "top", "n_children", "n_leaves", "saved", "settled")
    for batch in batches:
        for depth, k1, k2, p1, p2, conv, n, own, top, children, leaves, saved, settled in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if not settled:
                saved += own
                for child in queue.pop_all((-depth, k1, k2)):
                    children += 1
                    leaves += child[5]
                    saved += child[6]
                    out.append((*child[:2], conv, *child[3:]))
            row = (conv, depth, None, n, children, leaves, saved, k1, k2, p1, p2)
            if top:
                out.append(row)
            else:
                queue.push((1 - depth, p1, p2), row)
            if len(out) >= 20_000:
                yield flush()
    yield flush()


def _joined_ids(batches):
    """Ids of each key in order, joined to pieces."""
    held: list = []
    key = first = None

    def piece():
        return (*key, first, len(held), ",".join(map(str, held)))

    for batch in batches:
        rows = []
        for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id")), strict=True):
            if (k1, k2) != key or len(held) >= PIECE_IDS:
                if held:
                    rows.append(piece())
                key, first, held = (k1, k2), conv, []
            held.append(conv)
        yield _piece_batch(rows)
    yield _piece_batch([piece()] if held else [])


def _piece_batch(rows):
    kinds = [("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])


def _hashed_pieces(batches):
    key = digest = None
    for batch in batches:
        rows = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                digest.update(b",")
            else:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
        yield _hash_batch(rows)
    yield _hash_batch([(*key, digest.hexdigest())] if key is not None else [])


def _hash_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): SHA-256 of each key's ids in ascending order, joined by commas.

    Ids are joined to pieces in parallel, also those of one key; one task hashes a key's pieces as they stream by.
    """
    ranged = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    joined = stage(ranged.mapInArrow(_joined_ids, "k1 bigint, k2 bigint, first bigint, n bigint, ids string"), "ends")
    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed_pieces, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation and are left out; null roles and texts are empty; null turns come first;
    equal turns are ordered by role and text, and repeated rows are turns like others. An empty table has no node.
    Conversations whose turns are all taken away are members of the root only. Other columns are not read.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    held: list[DataFrame] = []
    unstaged, convs = prefixes(conversations, held)
    rows = stage(unstaged, "prefixes")
    drop_staged(*held)
    whole = rows.where("place = len").select("conv_id", F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("to_here").alias("all_bytes"))
    keyed = rows.join(whole, "conv_id")
    same = (F.min("w1") == F.max("w1")) & (F.min("w2") == F.max("w2"))
    nodes = keyed.groupBy(F.col("place").alias("depth"), "k1", "k2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        same.alias("settled"), F.min("len").alias("len"), F.min("w1").alias("w1"), F.min("w2").alias("w2"),
        F.min(F.col("all_bytes") - F.col("to_here") + F.col("bytes")).alias("left"),
    )
    nodes = stage(nodes, "nodes")
    tally = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")).first()
    own = (F.col("n_convs") - 1) * F.col("bytes")

    # nodes that lead to one end only
    done = nodes.where("settled").select(
        "conv_id", "depth", "n_convs", F.when(F.col("depth") < F.col("len"), 1).otherwise(0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("left")).alias("saved"), "k1", "k2", "p1", "p2", "w1", "w2",
    )
    first_done = done.groupBy("w1", "w2").agg(F.min("depth").alias("depth"))
    flagged = stage(done.join(first_done.withColumn("is_first", F.lit(True)), ["w1", "w2", "depth"], "left"), "settled")
    inner = flagged.where("is_first IS NULL").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", "k1", "k2", "p1", "p2")
    blank = {c: F.lit(0).cast("bigint") for c in ("n_children", "n_leaves", "saved")}
    kept = ["depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "own", "n_children", "n_leaves", "saved", "settled"]
    work = flagged.where("is_first").withColumns({"own": F.lit(0).cast("bigint"), "settled": F.lit(True)}).select(*kept).unionByName(
        nodes.where("NOT settled").withColumn("own", own).withColumns(blank).select(*kept)
    )
    large = work.where(F.col("n_convs") > SHARD_MEMBERS)
    small = work.where(F.col("n_convs") <= SHARD_MEMBERS)

    # the shard root of a node: the first place on its smallest member's path with few members
    crowded = nodes.where(F.col("n_convs") > SHARD_MEMBERS).select(F.col("depth").alias("place"), "k1", "k2")
    deepest = rows.join(crowded, ["place", "k1", "k2"]).groupBy("conv_id").agg(F.max("place").alias("crowded"))
    roots = rows.join(deepest, "conv_id", "left").where(F.col("place") == F.coalesce("crowded", F.lit(0)) + 1)
    roots = roots.select("conv_id", F.col("place").alias("root_depth"), F.xxhash64("k1", "k2").alias("shard"))
    sharded = small.join(roots, "conv_id").withColumn("top", F.col("depth") == F.col("root_depth"))
    ordered = sharded.repartition("shard").sortWithinPartitions(F.col("depth").desc(), "k1", "k2").drop("shard", "root_depth")
    passed = stage(ordered.mapInArrow(_pass_up, TOTALS), "shards")
    shard_tops = passed.where("parent_conv_id IS NULL")

    # above: the root and the crowded nodes, with what shard roots and each other bring; at most turns / SHARD_MEMBERS nodes
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    brought = shard_tops.groupBy(*parent).agg(
        F.count("*").alias("b_children"), F.sum("n_leaves").alias("b_leaves"), F.sum("saved").alias("b_saved")
    )
    root = spark.range(1).select(
        *(F.lit(v).cast("bigint").alias(c) for c, v in (("depth", 0), ("k1", 0), ("k2", 0), ("p1", 0), ("p2", 0), ("conv_id", tally["conv"]), ("n_convs", tally["n"]), ("own", 0), ("n_children", 0), ("n_leaves", 0), ("saved", 0))),
        F.lit(False).alias("settled"),
    ).where(F.lit(tally["n"] > 0))
    upper = stage(large.unionByName(root), "upper")
    fed = upper.join(brought, ["depth", "k1", "k2"], "left").withColumn("top", F.col("depth") == 0)
    for c in ("children", "leaves", "saved"):
        name = c if c == "saved" else f"n_{c}"
        fed = fed.withColumn(name, F.col(name) + F.coalesce(f"b_{c}", F.lit(0)))
    above = stage(fed.coalesce(1).sortWithinPartitions(F.col("depth").desc(), "k1", "k2").mapInArrow(_pass_up, TOTALS), "above")

    over = upper.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("over"))
    tops = shard_tops.join(over, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.col("over")).drop("over")
    every = inner.unionByName(passed.where("parent_conv_id IS NOT NULL")).unionByName(tops).unionByName(above)

    turnless = convs.where("len = 0").select(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv_id")
    ends = end_hashes(rows.where("place = len").select("k1", "k2", "conv_id").unionByName(turnless))
    empty = hashlib.sha256(b"").hexdigest()
    no_leaf_below = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    return every.join(ends, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", no_leaf_below.cast("bigint").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
