"""Plain versions of the operators, and small tables with the cases that break things."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig bigint, cell string, node int"


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text: str | None, n: int) -> frozenset:
    w = tokens(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(docs: list[tuple[int, str | None]], n: int, num: int, den: int) -> dict[int, int]:
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for j, inter in shared.items():
            if den * inter >= num * (len(s) + len(sets[j][1]) - inter):
                a, b = find(sets[k][0]), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(k)
    return {i: find(i) for i, _ in docs}


def odd_documents(spark, rows: list[tuple[int | None, str | None]]):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, None if k % 3 else "en", "src0", None if t is None else len(t), 7, "x", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


LONG = " ".join(f"word{i % 977} Tail{i % 31}." for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "One"), (6, "two words"), (7, LONG), (8, LONG + " more"), (9, "é à ß 中文   x"),
    (10, "a b c d e f g h"), (10, "a b c d e f g h"), (11, "A b c d e f g h"), (None, "no id here at all"), (None, None), (12, "a  b\n\nc"),
]
