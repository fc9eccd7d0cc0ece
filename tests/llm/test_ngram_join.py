"""The n-gram Jaccard join and its parts against brute force."""

import random

import numpy as np
import pytest
from brute import ODD, components, odd_documents, shingle_set, tokens

from sheetlens.llm import ngram_join, trie
from sheetlens.llm.components import connected_components
from sheetlens.llm.texts import as_texts, chunks, distinct_per_row, shingles, words


def _near_copies(seed: int, groups: int, copies: int, edits: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 90, 200]))]
        if g % 3 == 0:
            base += passage.split()
        for _ in range(rng.randint(1, copies)):
            words_ = list(base)
            for _ in range(rng.randint(0, edits)):
                words_[rng.randrange(len(words_))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words_)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "small", "block"), [(4, 85, 16, 256), (5, 80, 2, 8)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, small, block):
    # small limits send the same table through stars, the second look, leaders and blocks
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    rows = _near_copies(n, 25, 6, 6) + [(1000 + i, t) for i, (_, t) in enumerate(_near_copies(99, 1, 40, 5) * 3)]
    rows = [(i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(docs, n, num, 100).collect()}
    want = components(rows, n, num, 100)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingle_set(t, n)) for i, t in rows)


def test_odd_rows(spark):
    out = ngram_join.ngram_jaccard_join(odd_documents(spark, ODD), 4, 85, 100).collect()
    assert len(out) == len(ODD)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 6)] == [1, 2, 3, 6]
    assert (by_id[1]["n_shingles"], by_id[4]["n_shingles"]) == (0, 1)
    assert (by_id[5]["component_id"], by_id[8]["component_id"], by_id[11]["component_id"]) == (4, 7, 10)
    assert all(r["component_id"] is None for r in out if r["doc_id"] is None)


def test_empty_table(spark):
    assert ngram_join.ngram_jaccard_join(odd_documents(spark, []), 5, 80, 100).count() == 0


def test_words_and_shingles_of_columns():
    texts = [t for _, t in ODD]
    column = as_texts(__import__("pyarrow").array(texts))
    seen = {}
    for at, part in chunks(column, 1000):
        found = words(part)
        row, value = distinct_per_row(*shingles(found, 4))
        for i in range(len(part)):
            want = tokens(texts[at + i])
            mine = found.hash[found.row == i]
            assert len(mine) == len(want)
            for w, h in zip(want, mine.tolist()):
                assert seen.setdefault(w, h) == h
            assert (row == i).sum() == len(shingle_set(texts[at + i], 4))
    assert len(set(seen.values())) == len(seen)


def test_trie_search_equals_pairwise_comparison():
    rng = np.random.default_rng(3)
    base = [np.sort(rng.choice(300, rng.integers(1, 150), replace=False)) for _ in range(6)]
    sets = [np.zeros(0, int)]
    for _ in range(70):
        b = base[rng.integers(6)]
        sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], rng.choice(300, rng.integers(0, 4))])))
    flat, bounds = np.concatenate(sets).astype(np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    p, s = trie.links(flat, bounds, np.arange(len(sets)), 80, 100)
    want = {
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets)
        if len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    }
    assert set(zip(p.tolist(), s.tolist())) == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, None), (7, 3)]
    out = dict(connected_components(spark.createDataFrame(edges, "x bigint, y bigint")).collect())
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("contracted", [1 << 18, 40])
def test_components_of_few_edges_need_no_rounds(spark, monkeypatch, contracted):
    rounds, star = [], connected_components.__globals__["_with_least"]
    monkeypatch.setitem(connected_components.__globals__, "_with_least", lambda edges: rounds.append(1) or star(edges))
    monkeypatch.setitem(connected_components.__globals__, "CONTRACTED", contracted)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 160) if i % 41] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    out = dict(connected_components(spark.createDataFrame(edges, "x bigint, y bigint").repartition(7)).collect())
    kept = [e for e in edges if e[0] != e[1]]
    nodes = sorted({x for e in kept for x in e})
    least = {x: x for x in nodes}
    for _ in nodes:
        for a, b in kept:
            least[a] = least[b] = min(least[a], least[b])
    assert out == least
    assert bool(rounds) == (contracted == 40)


def test_pieces_of_a_large_element_stay_one_star(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "HELD_ROWS", 20)
    # two elements: one of 200 classes whose last batch holds six, then one of three classes
    element, sig = np.r_[np.full(200, 5), np.full(3, 9)], np.r_[np.arange(200), 300, 301, 302]
    columns = [pa.array(element), pa.array(sig), pa.array(np.full(203, 100, np.int32))]
    cuts = [0, 50, 120, 194, 203]
    batches = [pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in columns], ["element", "sig", "n"]) for a, b in zip(cuts, cuts[1:])]
    out = pa.Table.from_batches(ngram_join._meet(85, 100, 0)(batches)).to_pylist()
    assert {(r["a"], r["b"]) for r in out if r["star"]} == {(0, i) for i in range(200)}
    assert {(r["a"], r["b"]) for r in out if not r["star"]} == {(300, 301), (300, 302), (301, 302)}
