"""Exact n-gram Jaccard join of documents with prefix trees.

Every text is the set of its distinct n-word shingles. One order holds for all shingles: first by rarity (the product of
the counts of its words over all documents, in a table of fixed size), then by hash; an element is a 64-bit number that
sorts that way. The join finds all links with ``den * intersection >= num * union``:

1. Equal sets are one class; only classes go on.
2. A class gives its first ``n - ceil(t n) + l`` elements. Two sets that link share at least ``min(l, l')`` of them.
   Elements held by up to ``SMALL`` classes give pairs, which are counted; those that can still reach ``l`` are kept. A
   link that no such element shows joins two classes with ``l`` elements held by more. With ``l = 1 + n // 20`` these
   are few; they are looked at again with ``l = n // 2``, and what then still has ``l`` elements held by many is mostly
   made of copies of one text: stars around one class tie it together. Pairs and stars make cells; no link leaves one.
3. The whole sets of a cell go into one prefix tree, which is searched for all of them at once (``trie.py``). A cell
   beyond ``BLOCK`` sets is dealt out in blocks; each block also holds the same few leaders. Components then show which
   sets are not yet with the cell's largest component, and only those are searched for in the trees of all sets whose
   size allows a link, in blocks of ``SECOND_BLOCK``. Pairs inside one component need no second look, so large groups of
   near copies cost no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm import trie
from sheetlens.llm.components import connected_components
from sheetlens.llm.texts import SMALL_CHUNK_BYTES, as_texts, chunks, distinct_per_row, lists, mix, row_bounds, shingles, words
from sheetlens.session import drop_staged, ship_package, stage

SKETCH_BITS = 18
SLICES = 16
SMALL = 16
BLOCK = 256
#: Sets of a block when those outside a cell's largest component are looked for: what is copied falls with it.
SECOND_BLOCK = 1024
LEADERS = 16
BROADCAST_ROWS = 500_000
#: Rows of one element that are held before its star goes out in pieces.
HELD_ROWS = 1 << 20

_U = np.uint64


def _sketch_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _elements(found, n: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, element) pairs in order: rarity in the top 8 bits, shingle hash in the rest."""
    row, value = shingles(found, n)
    if not len(row):
        return row, value
    commonness = np.concatenate([[0], np.cumsum(rarity[_sketch_slot(found.hash)])])
    counts = found.counts()
    first = np.searchsorted(found.row, np.arange(found.n_rows))
    # shingles come as all full windows in order, then the short texts
    full = np.flatnonzero(found.row[: len(found.row) - n + 1] == found.row[n - 1 :]) if len(found.row) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    common = np.concatenate([commonness[full + n] - commonness[full], commonness[first[short] + counts[short]] - commonness[first[short]]])
    level = np.minimum(255, common * 8 // n).astype(np.uint64)
    return distinct_per_row(row, (level << _U(56)) | (value >> _U(8)))


def _describe(n: int):
    """Per document its set's size and signature; per task the counts of words by slot."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "sig", "check", "slice", "counts"]
        for batch in batches:
            texts = as_texts(batch.column("text"))
            for at, part in chunks(texts, SMALL_CHUNK_BYTES):
                found = words(part)
                counts += np.bincount(_sketch_slot(found.hash), minlength=1 << SKETCH_BITS)
                row, value = distinct_per_row(*shingles(found, n))
                bounds = row_bounds(row, len(part))
                sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(value ^ _U(salt)))]) for salt in (1, 0x5BF03635)]
                sig, check = (mix(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                empty = pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array(np.diff(bounds)), pa.array(sig), pa.array(check), *empty], names
                )
        size = len(counts) // SLICES
        pieces = pa.array([counts[i * size : (i + 1) * size].tobytes() for i in range(SLICES)], pa.binary())
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pieces], names)

    return run


def _add_up(batches):
    """The sum of the counts of each slice, one row at a time."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(counts.as_buffer(), np.int64)
            totals[at] = totals[at] + own if at in totals else own.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["slice", "counts"])


def _rarity(described: DataFrame) -> np.ndarray:
    """log2 of the count of the words in each slot, over all documents (a table of fixed size)."""

    parts = described.where("slice IS NOT NULL").select("slice", "counts")
    kind = "slice int, counts binary"
    # added up where they lie, then once more per slice, one at a time as they stream by
    summed = parts.mapInArrow(_add_up, kind).repartition(SLICES, "slice").mapInArrow(_add_up, kind)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(summed.collect(), key=lambda r: r["slice"])])
    return np.round(np.log2(counts + 1.0)).astype(np.int64)


#: ``l`` as a function of the set size, at the first look and at the second.
LOOKS = (lambda n: 1 + n // 20, lambda n: np.maximum(1, n // 2))


def prefix_sizes(n: np.ndarray, num: int, den: int, look: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of the prefix, elements of it that two linked sets share at least)."""
    least = LOOKS[look](n)
    return np.minimum(n, n - (n * num + den - 1) // den + least), least


def _prefixes(n_words: int, num: int, den: int, look: int, rarity):
    """(element, sig, n) of the prefixes; a set seen before in the task is left out."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        levels = rarity.value
        for batch in batches:
            texts = as_texts(batch.column("text"))
            for _, part in chunks(texts, SMALL_CHUNK_BYTES):
                found = words(part)
                row, value = distinct_per_row(*shingles(found, n_words))
                bounds = row_bounds(row, len(part))
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(value ^ _U(1)))])
                sig = mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
                row, value = _elements(found, n_words, levels)
                bounds = row_bounds(row, len(part))
                n = np.diff(bounds)
                _, first = np.unique(sig, return_index=True)
                fresh = first[(n[first] > 0) & ~np.isin(sig[first], seen)]
                seen = np.concatenate([seen, sig[fresh]])
                length, _ = prefix_sizes(n[fresh], num, den, look)
                at = np.repeat(bounds[fresh] - np.cumsum(length) + length, length) + np.arange(length.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[at].view(np.int64)), pa.array(np.repeat(sig[fresh], length)), pa.array(np.repeat(n[fresh], length).astype(np.int32))],
                    ["element", "sig", "n"],
                )

    return run


def _meet(num: int, den: int, look: int):
    """Pairs of classes that share an element of few classes; stars for elements of many. Input is ordered by element."""

    def run(batches):
        held = large = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            element = columns[0]
            if not len(element):
                continue
            last = np.searchsorted(element, element[-1])  # the last element may go on in the next batch
            held = [c[last:] for c in columns]
            yield from _of_elements(*(c[:last] for c in columns), num, den, look, large)
            if len(held[0]) > HELD_ROWS:
                # one element of very many classes: its star is made of pieces that share the first class
                large = held[0][0]
                yield from _of_elements(*held, num, den, look, large)
                held = [c[:1] for c in held]
        if held is not None:
            yield from _of_elements(*held, num, den, look, large)

    return run


def _of_elements(element, sig, n, num, den, look, large=None):
    """Edges of elements; ``large`` is an element that had pieces before: the rest of it is a star however small."""
    if not len(element):
        return
    keep = np.concatenate([[True], (element[1:] != element[:-1]) | (sig[1:] != sig[:-1])])
    element, sig, n = element[keep], sig[keep], n[keep]
    start = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    size = np.diff(np.append(start, len(element)))
    group = np.repeat(np.arange(len(start)), size)
    is_large = size > SMALL
    if large is not None:
        is_large |= element[start] == large
    a, b = [], []
    in_small = ~is_large[group]
    for gap in range(1, SMALL):
        i = np.flatnonzero(in_small[:-gap] & (group[:-gap] == group[gap:]))
        if not len(i):
            break
        j = i + gap
        near = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (sig[i] != sig[j])
        a.append(i[near])
        b.append(j[near])
    if a and sum(map(len, a)):
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.stack([sig[a], sig[b]], 1)  # sorted by sig inside an element
        ends, at, times = np.unique(pair, axis=0, return_index=True, return_counts=True)
        yield _edges(ends[:, 0], ends[:, 1], n[a[at]], n[b[at]], times, False, look)
    star = np.flatnonzero(is_large[group])
    if len(star):
        pair = np.stack([sig[start[group[star]]], sig[star]], 1)
        ends, at, times = np.unique(pair, axis=0, return_index=True, return_counts=True)
        own = n[star[at]]
        yield _edges(ends[:, 0], ends[:, 1], own, own, times, True, look)


def _edges(a, b, n_a, n_b, times, star, look):
    need = np.minimum(LOOKS[look](n_a.astype(np.int64)), LOOKS[look](n_b.astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(need.astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(np.full(len(a), star))],
        ["a", "b", "need", "times", "star"],
    )


def _sets(n_words: int, rarity):
    def run(batches):
        for batch in batches:
            for at, part in chunks(as_texts(batch.column("text")), SMALL_CHUNK_BYTES):
                row, value = _elements(words(part), n_words, rarity.value)
                ids = [batch.column(c).slice(at, len(part)) for c in ("cell", "m", "node")]
                yield pa.RecordBatch.from_arrays([*ids, lists(value.view(np.int64), row_bounds(row, len(part)), pa.int64())], ["cell", "m", "node", "elements"])

    return run


def _star_of(p: np.ndarray, s: np.ndarray, node: np.ndarray) -> pa.Table:
    """The links of one block, kept as each node's link to the smallest node of its component in the block."""
    ids, local = np.unique(node, return_inverse=True)
    least = np.arange(len(ids))
    a, b = local[p], local[s]
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, least):
            break
        least = after
    moved = least != np.arange(len(ids))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[least[moved]], pa.int64())})


def _search(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        elements = table.column("elements").combine_chunks()
        bounds = elements.offsets.to_numpy().astype(np.int64)
        flat = elements.values.to_numpy()[: bounds[-1]].view(np.uint64)
        node = table.column("node").to_numpy()
        probes = np.flatnonzero(table.column("probe").to_numpy(zero_copy_only=False))
        p, s = trie.links(flat, bounds, probes, num, den)
        return _star_of(p, s, node)

    return run


EDGE = "a bigint, b bigint"


def _join_cells(members: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between the nodes of ``members``, complete up to components.

    ``members`` has cell, m (nodes in the cell), node and elements.
    """
    sized = stage(members.withColumn("at", F.xxhash64("node")), "sets")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    dealt = sized.withColumn("block", F.pmod("at", blocks))
    search = _search(num, den)
    rank = Window.partitionBy("cell").orderBy("at", "node")
    # only sets that sort first by hash can lead, so the window sees few rows of any cell
    may_lead = sized.where(F.col("m") > BLOCK).where(F.pmod("at", F.greatest(F.lit(1), (F.col("m") / (8 * LEADERS)).cast("int"))) == 0)
    leaders = may_lead.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= LEADERS)
    everywhere = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where(F.pmod("at", blocks) != F.col("block"))
    first = dealt.select("cell", "block", "node", "elements", F.lit(True).alias("probe")).unionByName(
        everywhere.select("cell", "block", "node", "elements", F.lit(True).alias("probe"))
    )
    found = stage(first.groupBy("cell", "block").applyInArrow(search, EDGE), "links")
    large = sized.where(F.col("m") > BLOCK)
    if large.limit(1).count() == 0:
        drop_staged(sized)
        return found
    labels = connected_components(found)
    kind = F.floor(F.log(F.size("elements").cast("double")) / F.lit(math.log(den / num) + 1e-9)).cast("int") if num < den else F.size("elements")
    named = stage(
        large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("kind", kind), "labelled"
    )
    by_size = Window.partitionBy("cell").orderBy(F.col("c").desc(), "component")
    main = named.groupBy("cell", "component").agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(by_size)).where("r = 1")
    others = stage(named.join(main.select("cell", "component"), ["cell", "component"], "left_anti"), "others")
    # sets that link are of one kind of size or of two next to each other, so each of the others meets three kinds of its cell
    of_kind = named.groupBy("cell", "kind").agg(F.ceil(F.count("*") / F.lit(SECOND_BLOCK)).cast("int").alias("blocks"))
    to_kinds = others.withColumn("kind", F.explode(F.array(*[F.col("kind") + step for step in (-1, 0, 1)]))).join(of_kind, ["cell", "kind"])
    in_chunks = to_kinds.groupBy("cell", "kind").agg(F.ceil(F.count("*") / F.lit(SECOND_BLOCK)).cast("int").alias("chunks"))
    # the others that a kind meets in chunks of about SECOND_BLOCK sets, against every block of the kind
    chunk, block = F.pmod(F.xxhash64("at"), F.col("chunks")), F.pmod("at", F.col("blocks"))
    base = named.join(of_kind, ["cell", "kind"]).join(in_chunks, ["cell", "kind"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    probes = to_kinds.join(in_chunks, ["cell", "kind"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = base.select("cell", "kind", block.alias("block"), F.col("chunk").cast("bigint"), "node", "elements", F.lit(False).alias("probe")).unionByName(
        probes.select("cell", "kind", F.col("block").cast("bigint"), chunk.alias("chunk"), "node", "elements", F.lit(True).alias("probe"))
    )
    more = stage(second.groupBy("cell", "kind", "block", "chunk").applyInArrow(search, EDGE), "links")
    drop_staged(sized, named, others)
    return found.unionByName(more)


def _texts_of(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source`` joined with the rows of ``nodes`` for its doc_id; up to ``BROADCAST_ROWS`` rows of numbers are broadcast."""
    nodes = stage(nodes, "nodes")
    few = nodes.count() <= BROADCAST_ROWS
    return source.join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("node"))


def _meetings(source: DataFrame, n: int, num: int, den: int, look: int, rarity):
    """(pairs of classes that may link, classes with many elements held by many classes, stars of such elements)."""
    prefixes = source.select("text").mapInArrow(_prefixes(n, num, den, look, rarity), "element bigint, sig bigint, n int")
    ordered = prefixes.repartition("element").sortWithinPartitions("element", "sig")
    edges = stage(ordered.mapInArrow(_meet(num, den, look), "a bigint, b bigint, need int, times int, star boolean"), "meetings")
    hot = edges.where("star").groupBy(F.col("b").alias("sig")).agg(F.sum("times").alias("hot"), F.max("need").alias("need"))
    hot_of = [hot.select(F.col("sig").alias(k), F.col("hot").alias(f"hot_{k}")) for k in ("a", "b")]
    counted = edges.where("NOT star").groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("times").alias("times"))
    reachable = F.col("times") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    pairs = counted.join(hot_of[0], "a", "left").join(hot_of[1], "b", "left").where(reachable >= F.col("need")).select("a", "b")
    many = stage(hot.where("hot >= need").select("sig"), "many")
    # the classes of a star meet at their element's first class, whether or not that has many such elements itself
    stars = edges.where("star").select("a", "b").distinct().join(many, F.col("b") == F.col("sig")).select("a", "b")
    return pairs, many, stars


def ngram_jaccard_join(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), class_id and component_id.

    ``class_id`` is the smallest doc_id with an equal set, ``component_id`` the smallest doc_id reachable by links of
    ``den * intersection >= num * union``. Texts without words, null texts and rows without doc_id link with nothing: a
    document's component is then its own doc_id (null without one). Rows that repeat a doc_id with another text each go
    with their own text. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stage(
        source.mapInArrow(_describe(n), "doc_id bigint, n bigint, sig bigint, check bigint, slice int, counts binary"), "shingled"
    )
    rows = described.where("slice IS NULL").select("doc_id", "n", "sig", "check")
    rarity = spark.sparkContext.broadcast(_rarity(described))
    usable = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("sig", "check", "n").agg(F.min("doc_id").alias("rep"))

    pairs, many, _ = _meetings(source.where("doc_id IS NOT NULL"), n, num, den, 0, rarity)
    again = _texts_of(source, classes.join(many, "sig").select(F.col("rep").alias("node")).distinct())
    more, _, stars = _meetings(again, n, num, den, 1, rarity)
    cells = connected_components(pairs.unionByName(more).unionByName(stars))
    members = cells.join(classes.select("sig", "rep"), F.col("node") == F.col("sig"))
    members = stage(members.select(F.col("component").alias("cell"), F.col("rep").alias("node")).distinct(), "cells")
    sized = members.join(members.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sets = _texts_of(source, stage(sized, "cells")).select("cell", "m", "node", "text")
    sets = sets.mapInArrow(_sets(n, rarity), "cell bigint, m bigint, node bigint, elements array<bigint>")
    found = _join_cells(sets, num, den)
    linked = connected_components(found)
    roots = classes.join(linked, F.col("rep") == F.col("node"), "left").select(
        "sig", "check", "n", "rep", F.coalesce("component", "rep").alias("component")
    )
    return _rows_with_components(rows, roots)


SALTS = 16


def _rows_with_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their class and component; classes are copied over salts, since one may hold a third of all rows."""
    salted = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(salted, ["sig", "check", "n", "salt"], "left")
    mine = F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(mine, F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(mine, F.coalesce("component", "doc_id")).alias("component_id"),
    )
