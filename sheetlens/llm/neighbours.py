"""Nearest vectors by largest inner product: a neighbour graph by NN-descent, and greedy search in it.

Equal vectors are one node. Nodes are grouped by length, each group at most twice as long as another of it, and every
group has a graph of its own. In it all vectors get one more component that brings them to the length of the longest, so
that the largest inner product with a query (whose extra component is 0) is the nearest node as well. Single vectors that
are far longer or shorter than the rest leave the scale of the others as it is.

The graph. Nodes are ordered by nearest of a bounded set of sampled pivots and by their place along a random direction,
dealt out by ranges of that order, and every run of ``RUN`` nodes is compared in full; two such orders give the first
lists. Then NN-descent: a node's list and the nodes that list it are brought together by joins, all pairs of such
neighbours are compared, and each node keeps the best ``LIST`` it has met. Only pairs with an entry that is new since the
last round are compared, and only pairs that beat a list's last entry are sent on. Rounds end when few lists change.

The search. In every group a query starts from its own node where it is there and from the nearest of the group's sampled
nodes, and in every round joins the best nodes it has not followed yet with the graph, up to ``ROUNDS`` rounds. Groups too
short to hold one of its best are left out; groups with few nodes are sampled whole and need no rounds. Results get their scores from
the original vectors in double precision, and equal vectors are expanded to their rows. Nodes, queries and graph stay
distributed; only the sampled nodes are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sheetlens.session import drop_staged, ship_package, stage

LIST = 32
REVERSE = 16
RUN = 1024
PIVOTS = 256
ORDERS = 6
DESCENTS = 5
SETTLED = 0.003
BEAM = 96
FOLLOW = 12
ROUNDS = 5
SALTS = 16
SEED = 17

EDGES = "u bigint, v bigint, s float"


def _rows(column) -> np.ndarray:
    """Matrix of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(column, kind) -> np.ndarray:
    """Matrix of a binary column of equally long vectors."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(kind).reshape(len(column), -1)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<float>) of the rows that take part.

    Rows without id, with a null, zero or non-finite vector, or of another length than most do not.
    """
    e = F.col("embedding").cast("array<float>")
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & sound)
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    return rows.where(F.size("embedding") == (lengths["d"] if lengths else 0))


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows with the 128-bit key of their vector; adding 0 makes -0 and 0 alike."""
    plain = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))
    return rows.withColumn("k1", F.xxhash64(plain)).withColumn("k2", F.xxhash64(F.lit(1), plain))


def _length(e: F.Column) -> F.Column:
    return F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _by_length(nodes: DataFrame) -> DataFrame:
    """Nodes with ``grp``: lengths from 0.71 to 1.41 times a power of two."""
    return nodes.withColumn("grp", F.floor(F.log2(_length(F.col("embedding"))) + 0.5).cast("int"))


def _groups(nodes: DataFrame) -> dict[int, tuple[int, float]]:
    """Nodes and greatest length of every group."""
    return {r[0]: (r[1], r[2]) for r in nodes.groupBy("grp").agg(F.count("*"), F.max(_length(F.col("embedding")))).collect()}


def _lifted(x: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Vectors of length one with the extra component, each in the scale of its group."""
    x = x.astype(np.float64) / longest[:, None]
    extra = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.concatenate([x, extra[:, None]], 1).astype(np.float32)


def _extended(longest: dict[int, float], pivots, directions):
    """Lifted vectors and their place in every order."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _lifted(_rows(batch.column("embedding")), np.array([longest[g] for g in batch.column("grp").to_pylist()]))
            cells = np.stack([(x @ p.T).argmax(1) for p in pivots.value], 1).astype(np.int32)
            places = np.stack([x @ d for d in directions.value], 1).astype(np.float32)
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1])
            orders = [pa.ListArray.from_arrays(bounds, pa.array(c.ravel())) for c in (cells, places)]
            vec = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("grp"), vec, *orders], ["node", "grp", "vec", "cells", "places"])

    return run


def _best_pairs(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest entries of every row."""
    k = min(k, near.shape[1])
    top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
    return np.repeat(np.arange(len(near)), k), top.ravel()


def _compare_runs(batches):
    """Best pairs of one order and group inside every run of ``RUN`` nodes of a sorted partition; runs overlap by half."""

    def best(node, turn, grp, x):
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        near[(grp[:, None] != grp) | (turn[:, None] != turn)] = -np.inf
        u, v = _best_pairs(near, min(LIST, len(node) - 1))
        s = near[u, v]
        u, v, s = (c[s > -np.inf] for c in (u, v, s))
        return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v]), pa.array(s)], ["u", "v", "s"])

    held = None
    for batch in batches:
        if not len(batch):
            continue
        more = [*(batch.column(c).to_numpy() for c in ("node", "turn", "grp")), _packed(batch.column("vec"), np.float32)]
        held = more if held is None else [np.concatenate(c) for c in zip(held, more)]
        while len(held[0]) >= 2 * RUN:
            yield best(*(c[:RUN] for c in held))
            held = [c[RUN // 2 :] for c in held]
    while held is not None and len(held[0]) > 1:
        yield best(*(c[:RUN] for c in held))
        if len(held[0]) <= RUN:
            break
        held = [c[RUN // 2 :] for c in held]


def _merged(edges: DataFrame) -> DataFrame:
    """(u, v, s, fresh, r, last): the ``LIST`` best of every node's edges in order, each edge once and fresh if all its rows are.

    ``last`` is the score that a new edge of the node has to beat.
    """
    # a node's edges meet in one exchange for both steps
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    list_of = Window.partitionBy("u")
    ranked = once.withColumn("r", F.row_number().over(list_of.orderBy(F.col("s").desc(), "v"))).where(F.col("r") <= LIST)
    last = F.when(F.count("*").over(list_of) >= LIST, F.min("s").over(list_of)).otherwise(F.lit(float("-inf")))
    return ranked.withColumn("last", last.cast("float"))


def _around(graph: DataFrame, turn: int) -> DataFrame:
    """(u, v, fresh): each node's list, and nodes that list it, new ones first and then by chance."""
    rank = Window.partitionBy("v").orderBy(F.col("fresh").desc(), F.xxhash64(F.lit(turn), "u", "v"))
    back = graph.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= REVERSE).select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    return graph.select("u", "v", "fresh").unionByName(back).repartition("u").groupBy("u", "v").agg(F.max("fresh").alias("fresh"))


def _meet(batches):
    """Pairs of neighbours of one node that may enter each other's lists; input is ordered by node."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = [batch.column("u").to_numpy(), batch.column("v").to_numpy(), batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("last").to_numpy(), _packed(batch.column("vec"), np.float32)]
        if held is not None:
            table = [np.concatenate(p) for p in zip(held, table)]
        last = np.searchsorted(table[0], table[0][-1])
        held = [c[last:] for c in table]
        yield from _neighbour_pairs(*(c[:last] for c in table))
    if held is not None:
        yield from _neighbour_pairs(*held)


def _neighbour_pairs(u, v, fresh, last, vec):
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(u)))
    width = LIST + REVERSE
    for g in range(0, len(start), 128):
        n = size[g : g + 128]
        at = start[g]
        rows = slice(at, at + n.sum())
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = np.zeros((len(n), width, vec.shape[1]), np.float32)
        x[group, place] = vec[rows]
        ids = np.full((len(n), width), -1, np.int64)
        ids[group, place] = v[rows]
        new = np.zeros((len(n), width), bool)
        new[group, place] = fresh[rows]
        bar = np.full((len(n), width), np.inf, np.float32)
        bar[group, place] = last[rows]
        filled = np.zeros((len(n), width), bool)
        filled[group, place] = True
        near = np.matmul(x, x.transpose(0, 2, 1))
        good = (near > bar[:, :, None]) & filled[:, None, :] & (new[:, :, None] | new[:, None, :])
        good[:, np.arange(width), np.arange(width)] = False
        i, a, b = np.nonzero(good)
        if len(i):
            pair = np.stack([ids[i, a], ids[i, b]], 1)
            pair, first = np.unique(pair, axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(near[i, a, b][first])], ["u", "v", "s"])


def build_graph(nodes: DataFrame) -> DataFrame:
    """(u, v) edges of the neighbour graph, both ways, from ``nodes`` (node, embedding array<float>, grp)."""
    spark = nodes.sparkSession
    groups = _groups(nodes)
    n, longest = sum(c for c, _ in groups.values()), {g: m for g, (_, m) in groups.items()}
    none = spark.createDataFrame([], "u bigint, v bigint")
    if n < 2:
        return none
    pivots, directions = [], []
    for i in range(ORDERS):
        drawn = nodes.orderBy(F.xxhash64(F.lit(SEED + i), "node"), "node").limit(min(PIVOTS, max(1, n // 64))).select("embedding", "grp").collect()
        pivots.append(_lifted(np.array([r[0] for r in drawn], np.float64), np.array([longest[r[1]] for r in drawn])))
        directions.append(np.random.default_rng(SEED + i).standard_normal(pivots[-1].shape[1]).astype(np.float32))
    shared = spark.sparkContext.broadcast(pivots), spark.sparkContext.broadcast(directions)
    vectors = stage(nodes.mapInArrow(_extended(longest, *shared), "node bigint, grp int, vec binary, cells array<int>, places array<float>"), "vectors")
    # all orders are dealt out together
    turns = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(ORDERS - 1)).alias("turn"), "cells", "places")).alias("o")
    order = ("turn", "grp", "cell", "place")
    dealt = vectors.select("node", "vec", "grp", turns).select("node", "vec", "grp", F.col("o.turn").alias("turn"), F.col("o.cells").alias("cell"), F.col("o.places").alias("place"))
    runs = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "turn", "grp", "vec").mapInArrow(_compare_runs, EDGES)
    graph = stage(_merged(runs.withColumn("fresh", F.lit(True))), "graph")
    for turn in range(DESCENTS):
        bars = graph.where("r = 1").select("u", "last")
        none_yet = F.lit(float("-inf")).cast("float")
        listed = vectors.select("node", "vec").join(bars, F.col("node") == F.col("u"), "left").select(F.col("node").alias("v"), "vec", F.coalesce("last", none_yet).alias("last"))
        lively = F.max("fresh").over(Window.partitionBy("u"))
        around = _around(graph, turn).withColumn("lively", lively).where("lively").drop("lively")
        met = around.join(listed, "v").select("u", "v", "fresh", "last", "vec")
        pairs = met.repartition("u").sortWithinPartitions("u").mapInArrow(_meet, EDGES)
        both = graph.select("u", "v", "s", F.lit(False).alias("fresh")).unionByName(pairs.withColumn("fresh", F.lit(True)))
        seen = Observation()
        after = stage(_merged(both).observe(seen, F.count(F.when(F.col("fresh"), 1)).alias("n")), "graph")
        changed = seen.get["n"]
        drop_staged(graph)
        graph = after
        if changed <= SETTLED * LIST * n:
            break
    edges = stage(_around(graph.withColumn("fresh", F.lit(True)), DESCENTS).select("u", "v"), "graph")
    drop_staged(graph, vectors)
    return edges


def _inner(names: list[str], kind):
    """Inner products of the lists in columns a and b, next to the named columns."""

    def run(batches):
        for batch in batches:
            if len(batch):
                a, b = (_rows(batch.column(c)).astype(kind) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.einsum("ij,ij->i", a, b).astype(np.float64))], [*names, "s"])

    return run


def _enter(seeds, k: int):
    """(q, grp, node, followed): the ``k`` best seeds of each group; of groups that are seeds only, all a beam holds."""

    def run(batches):
        groups = seeds.value
        for batch in batches:
            if not len(batch):
                continue
            x = _rows(batch.column("embedding")).astype(np.float64)
            near = [x @ s.T for _, _, s, _, _ in groups]
            everything = np.concatenate(near, 1)
            least = np.full(len(x), -np.inf)
            if everything.shape[1] >= BEAM:
                least = np.partition(everything, everything.shape[1] - BEAM, axis=1)[:, everything.shape[1] - BEAM]
            length = np.sqrt((x * x).sum(1)) * (1 + 1e-9)
            for (grp, ids, _, longest, whole), s in zip(groups, near):
                asks = np.flatnonzero(length * longest >= least)
                if len(asks):
                    row, column = _best_pairs(s[asks], BEAM if whole else k)
                    q = batch.column("q").to_numpy()[asks[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), grp, np.int32)), pa.array(ids[column]), pa.array(np.full(len(q), whole))], ["q", "grp", "node", "followed"])

    return run


def search_graph(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, node, s): up to ``BEAM`` near nodes of every group for every query (q, embedding, node and grp: its own or null)."""
    spark = nodes.sparkSession
    groups = _groups(nodes)
    if not groups:
        return spark.createDataFrame([], "q bigint, node bigint, s double")
    # groups of up to 2 * PIVOTS nodes are drawn whole, others by chance
    share = F.create_map(*(F.lit(x) for g, (n, _) in groups.items() for x in (g, min(1.0, 2 * PIVOTS / n))))
    chance = F.pmod(F.xxhash64(F.lit(SEED - 1), "node"), F.lit(1 << 30)) / float(1 << 30)
    drawn: dict[int, list] = {}
    for r in nodes.where(chance < share[F.col("grp")]).select("grp", "node", "embedding").collect():
        drawn.setdefault(r["grp"], []).append(r)
    seeds = spark.sparkContext.broadcast([(g, np.array([r["node"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32), groups[g][1], len(rows) == groups[g][0]) for g, rows in drawn.items()])
    queries = stage(queries, "queries")
    vectors = nodes.select("node", F.col("embedding").alias("b"))
    asked = queries.select("q", F.col("embedding").alias("a"))
    columns = ("q", "grp", "node", "followed")
    kind = "q bigint, grp int, node bigint, followed boolean"
    best = Window.partitionBy("q", "grp")

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(vectors, "node").join(asked, "q").select(*columns, "a", "b")
        return met.mapInArrow(_inner(list(columns), np.float64), f"{kind}, s double")

    def kept(pairs: DataFrame) -> DataFrame:
        """The ``BEAM`` best; of those not followed yet, the best ``FOLLOW`` are next."""
        top = pairs.withColumn("r", F.row_number().over(best.orderBy(F.col("s").desc(), "node"))).where(F.col("r") <= BEAM)
        turn = F.row_number().over(best.orderBy("followed", "r"))
        return stage(top.withColumn("next", ~F.col("followed") & (turn <= FOLLOW)).drop("r"), "beam")

    own = queries.where(F.col("node").isNotNull()).select("q", "grp", "node", F.lit(False).alias("followed"))
    start = own.unionByName(queries.select("q", "embedding").mapInArrow(_enter(seeds, 4), kind)).groupBy("q", "grp", "node").agg(F.max("followed").alias("followed"))
    beam = kept(scored(start))
    for _ in range(ROUNDS):
        front = beam.where("next").select("q", "grp", "node")
        reached = front.join(edges, F.col("node") == F.col("u")).select("q", "grp", F.col("v").alias("node"))
        # a node is in one group, so (q, node) tells the same pairs apart
        unknown = reached.repartition("q", "node").dropDuplicates(["q", "node"]).join(beam.select("q", "node"), ["q", "node"], "left_anti")
        known = beam.withColumn("followed", F.col("followed") | F.col("next")).select(*columns, "s")
        after = kept(known.unionByName(scored(unknown.withColumn("followed", F.lit(False)))))
        drop_staged(beam)
        beam = after
    return beam.select("q", "node", "s")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest other rows found for every row that ``is_query`` picks.

    Rank 1 has the largest inner product, ties go to the smaller vec_id. Vectors that cannot take part (see
    ``usable_vectors``) are neither queries nor candidates. Of rows with one vec_id and different vectors each counts; equal
    rows count once. A table of one vector gives no rows, an empty table neither.
    """
    ship_package(vectors.sparkSession)
    rows = stage(_nodes(usable_vectors(vectors)).dropDuplicates(["vec_id", "k1", "k2"]), "rows")
    nodes = stage(rows.groupBy("k1", "k2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("least")).withColumn("node", F.xxhash64("k1", "k2")), "nodes")
    keyed = rows.select("vec_id", is_query.alias("asks"), F.xxhash64("k1", "k2").alias("node"))
    plain = stage(_by_length(nodes.select("node", "embedding")), "plain")
    edges = build_graph(plain)
    asking = keyed.where("asks").select("node").distinct()
    queries = plain.join(asking, "node", "left_semi").select(F.col("node").alias("q"), "embedding", "node", "grp")
    near = search_graph(plain, edges, queries)
    # the first k + 1 rows of every vector: one of them may be the query itself
    first = Window.partitionBy("node").orderBy("vec_id")
    members = keyed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("node", "vec_id")
    order = (F.col("s").desc(), F.col("vec_id"))
    listed = near.join(members, "node").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    salted = listed.select("q", "vec_id", "s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    askers = keyed.where("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = askers.join(salted, ["q", "salt"]).where(F.col("vec_id") != F.col("query_id"))
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s").alias("score"))
