"""Spelling variants against all pairs, and odd rows."""

import random
import re
import zlib
from collections import Counter

from brute import LOWER, ODD, odd_documents

from sheetlens.llm import spelling


def plain(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += len(run) >= 7
    words = {w: n for w, n in words.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {w: (forms[w], root(w), n, len(beside[w]), words.get(forms[w])) for w, n in words.items()}


def got(spark, rows):
    out = spelling.spelling_variants(odd_documents(spark, rows)).collect()
    assert len({r.word for r in out}) == len(out)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


def test_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.2)), 59)]
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÀ×") + w[k:], w[:k] + rng.choice("abcd") + w[k + 1 :]])
            words.append(w.capitalize() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    want = plain(rows)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] != v[1] for v in want.values() if v[0])
    assert got(spark, rows) == want


def test_repeated_letters_and_shared_ends(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaa", "baaaaaa", "aaaaaab", "abababa", "babababa", "abababab", "aabababa", "abcdefgh", "bcdefgh", "abcdefg", "xabcdefgh"]
    rows = [(i, f"{w} {w}") for i, w in enumerate(words)]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [*ODD, (None, "Wordless wordless"), (20, "x" * 50_000 + " " + "x" * 49_999), (20, "x" * 50_000 + " " + "x" * 49_999), (21, "wörtlich ŵörtlich日wörtlich")]
    assert got(spark, rows) == plain(rows)
    assert spelling.spelling_variants(odd_documents(spark, [(1, None), (2, "")])).count() == 0
    assert spelling.spelling_variants(odd_documents(spark, ODD).where("doc_id = -1")).count() == 0


def test_pivots_are_disjoint_and_cheapest():
    assert spelling.least_disjoint([0, 1, 2, 3], [5, 1, 1, 9], 2, 2) == [0, 2]
    assert spelling.least_disjoint([0, 1, 5], [3, 2, 1], 2, 2) == [1, 2]
    order = {g: (i, i + 1) for i, g in enumerate(sorted({a + b for a in "abcd" for b in "abcd"}))}
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(7, 12)))
        places, pivots, last = spelling.prefix_and_pivots(word, order)
        assert len(pivots) == 2 and pivots[1] - pivots[0] >= 2 and set(pivots) <= set(places) and len(places) >= 3
        assert places == [i for i in range(len(word) - 1) if order[word[i : i + 2]][0] <= last]
