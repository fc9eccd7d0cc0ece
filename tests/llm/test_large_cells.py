"""Sets outside the largest component of a large cell: what is copied to find their links, and that none is lost."""

import numpy as np
from pyspark.sql import functions as F

from sheetlens.llm import ngram_join
from sheetlens.llm.components import connected_components

NUM, DEN = 80, 100


def _cell():
    """One cell of 240 sets of 20 to 2,300 elements: 120 unrelated ones, and one near copy of each."""
    rng, sets = np.random.default_rng(5), []
    for i in range(120):
        own = rng.choice(1 << 40, int(20 * 1.04**i), replace=False)
        sets += [own, own[: -(-len(own) * 85 // 100)]]
    return [np.sort(s).astype(np.int64).tolist() for s in sets]


def test_others_of_a_cell_meet_only_sets_that_they_could_link_with(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SECOND_BLOCK", 16, raising=False)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    seen, search = spark.sparkContext.accumulator(0), ngram_join._search

    def counted(num, den):
        run = search(num, den)

        def count(table):
            seen.add(table.num_rows)
            return run(table)

        return count

    monkeypatch.setattr(ngram_join, "_search", counted)
    sets = _cell()
    members = spark.createDataFrame([(0, len(sets), i, s) for i, s in enumerate(sets)], "cell bigint, m bigint, node bigint, elements array<bigint>")
    found = {(r["node"], r["component"]) for r in connected_components(ngram_join._join_cells(members, NUM, DEN)).collect()}
    # brute force: a set and its near copy link, and nothing else does
    pairs = [(i, j) for i, a in enumerate(map(set, sets)) for j, b in enumerate(map(set, sets)) if i < j and DEN * len(a & b) >= NUM * len(a | b)]
    assert found == {(n, i) for i, j in pairs for n in (i, j)} and len(pairs) == 120
    # 240 sets once, two leaders in 15 blocks; then few copies of each, where all blocks of the cell would be 30 of each
    assert 0 < seen.value < 10 * len(sets)


def test_kinds_of_size_keep_links_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    # 4 of 5, 16 of 20, 64 of 80 elements: exactly the threshold, in a cell whose largest component is another
    sets = [list(range(k * 1000, k * 1000 + n)) for k, most in ((1, 5), (2, 20), (3, 80)) for n in (most, most * 4 // 5)]
    sets += [[*range(9000, 9050), 9100 + i] for i in range(6)]
    members = spark.createDataFrame([(0, len(sets), i, s) for i, s in enumerate(sets)], "cell bigint, m bigint, node bigint, elements array<bigint>")
    found = connected_components(ngram_join._join_cells(members, NUM, DEN)).where(F.col("node") <= 5)
    assert {(r["node"], r["component"]) for r in found.collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)}
