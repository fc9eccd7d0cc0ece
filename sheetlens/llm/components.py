"""Connected components of an edge table, by alternating star steps over Spark joins and contraction inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sheetlens.session import drop_staged, ship_package, stage

SALTS = 8
MAX_ROUNDS = 60
#: edges that one task contracts when there are no more left
CONTRACTED = 1 << 18


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours, spread over ``SALTS`` copies so that hubs do not meet one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))


def _with_least(edges: DataFrame) -> DataFrame:
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(_least_neighbour(edges), ["u", "s"]).select("u", "v", "m")


def _contract(batches):
    """Edges of a task to edges from each of its nodes to the smallest one that it reaches by them."""
    ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for held, column in zip(ends, batch.columns, strict=True):
            held.append(column.to_numpy())
    ids, local = np.unique(np.concatenate(ends[0] + ends[1]), return_inverse=True)
    u, v = np.split(local, 2)
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[u], least[v])
        after = least.copy()
        for end in (u, v):
            np.minimum.at(after, end, low)
            np.minimum.at(after, least[end], low)
        after = after[after]
        if np.array_equal(after, least):
            break
        least = after
    moved = np.flatnonzero(least != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[least[moved]], pa.int64())], ["u", "v"])


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a written table, and their number and a sum over their hashes: the same for the same edges only."""
    seen = Observation()
    checked = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s"))
    return stage(checked, "edges"), tuple(seen.get.values())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (two long columns); component is the smallest node reached.

    Tasks first replace their edges by stars, which keeps components as they are and holds no more than a task's own edges.
    Up to ``CONTRACTED`` edges that are left are contracted by one task, without joins. Of more, each round links a node's
    larger neighbours to its smallest one, then its smaller neighbours likewise, and writes the new edges to the shared
    folder, until they stay the same. Rounds grow with the logarithm of a component's diameter. No node's neighbours are
    gathered in one place. Edges with a null end and loops are left out.
    """
    ship_package(edges.sparkSession)
    a, b = (F.col(f"`{c}`").cast("bigint") for c in edges.columns[:2])
    own = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, seen = _staged(own.mapInArrow(_contract, "u bigint, v bigint").distinct())
    for _ in range(MAX_ROUNDS):
        if seen[0] <= CONTRACTED:
            after = stage(now.coalesce(1).mapInArrow(_contract, "u bigint, v bigint"), "edges")
            drop_staged(now)
            now = after
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _with_least(large)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, state = _staged(small.unionByName(stars.select("u", F.col("m").alias("v"))).distinct())
        drop_staged(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
