"""Neighbour lists of the vector search: what they keep, and how often their edges are dealt out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sheetlens.llm import neighbours


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lists_are_merged_in_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 3)
    rng = random.Random(4)
    rows = [(rng.randrange(6), v := rng.randrange(8), v / 8, rng.random() < 0.5) for _ in range(90)]
    merged = neighbours._merged(spark.createDataFrame(rows + [(9, 1, 0.5, True)], "u bigint, v bigint, s float, fresh boolean"))
    assert _exchanges(merged) == 1
    want = []
    for u in {r[0] for r in rows}:
        best = sorted({r[1] for r in rows if r[0] == u}, reverse=True)[:3]
        want += [(u, v, v / 8, all(r[3] for r in rows if r[:2] == (u, v)), i + 1, best[-1] / 8) for i, v in enumerate(best)]
    assert sorted(map(tuple, merged.collect())) == sorted([*want, (9, 1, 0.5, True, 1, float("-inf"))])


def test_nodes_around_need_two_exchanges(spark):
    graph = spark.createDataFrame([(1, 2, False), (2, 3, True), (3, 2, False)], "u bigint, v bigint, fresh boolean")
    around = neighbours._around(graph, 0)
    assert _exchanges(around) == 2
    assert sorted(map(tuple, around.collect())) == [(1, 2, False), (2, 1, False), (2, 3, True), (3, 2, True)]


def test_runs_compare_nodes_of_one_order_and_group():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((12, 4)).astype(np.float32)
    turn, grp = np.repeat([0, 1], 6).astype(np.int32), np.tile([1, 1, 1, 2, 2, 3], 2).astype(np.int32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.tile(np.arange(6), 2)), pa.array(turn), pa.array(grp), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "turn", "grp", "vec"]
    )
    found = {(u, v) for b in neighbours._compare_runs(iter([batch])) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist())}
    assert found == {(a, b) for part in ((0, 1, 2), (3, 4)) for a in part for b in part if a != b}
