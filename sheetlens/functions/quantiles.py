"""Exact quantiles whose memory stays bounded however many values a column has.

A small column goes to the built-in ``percentile``, whose value map is then short. A large one is
narrowed first: one histogram pass over all columns finds, for every wanted rank, the bin it falls
in and the exact number of values before it. Bins that still hold too many values (heavy tails) are
narrowed on by a sketch whose bracket is verified by counting. At the end each bracket holds at
most ``PICK_LIMIT`` values, or copies of a single one, and the ranks are picked from those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.counts import one_row
from sheetlens.functions.names import quoted
from sheetlens.functions.values import col

DIRECT_LIMIT = 50_000
PICK_LIMIT = 500_000
HISTOGRAM_BINS = 1024
SKETCH_ACCURACY = 10_000
INFINITE = float("inf")


@dataclass
class _Bracket:
    """Where one rank of one column can still lie."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int

    def settled(self, limit: int) -> bool:
        return self.low == self.high or self.inside <= limit

    def holds(self) -> Column:
        c = col(self.column)
        return (c >= F.lit(self.low)) & (c <= F.lit(self.high))

    def values(self) -> Column:
        return F.when(self.holds(), col(self.column))


def _narrow(df: DataFrame, open_: list[_Bracket]) -> None:
    """One sketch pass and one counting pass for all open brackets."""
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, b in enumerate(open_):
        at = (b.rank - b.below + 0.5) / b.inside
        probes = [F.lit(max(0.0, at - margin)), F.lit(min(1.0, at + margin))]
        sketches.append(F.percentile_approx(b.values(), F.array(*probes), SKETCH_ACCURACY).alias(f"s{i}"))
    found = df.agg(*sketches).first()
    bounds = [(float(found[i][0]), float(found[i][1])) for i in range(len(open_))]
    counts = []
    for i, (b, (lo, hi)) in enumerate(zip(open_, bounds)):
        v = b.values()
        counts.append(F.count(F.when(v < F.lit(lo), 1)).alias(f"u{i}"))
        counts.append(F.count(F.when(v == F.lit(lo), 1)).alias(f"l{i}"))
        counts.append(F.count(F.when((v > F.lit(lo)) & (v < F.lit(hi)), 1)).alias(f"m{i}"))
        counts.append(F.count(F.when((v == F.lit(hi)) & (v > F.lit(lo)), 1)).alias(f"h{i}"))
    seen = df.agg(*counts).first()
    for i, (b, (lo, hi)) in enumerate(zip(open_, bounds)):
        under, at_low, between, at_high = (seen[f"{k}{i}"] for k in "ulmh")
        # the five stretches of the bracket, in order, with their sizes
        stretches = [
            (b.low, math.nextafter(lo, -math.inf), under),
            (lo, lo, at_low),
            (math.nextafter(lo, math.inf), math.nextafter(hi, -math.inf), between),
            (hi, hi, at_high),
            (math.nextafter(hi, math.inf), b.high, b.inside - under - at_low - between - at_high),
        ]
        for low, high, size in stretches:
            if b.rank - b.below < size:
                b.low, b.high, b.inside = low, high, size
                break
            b.below += size


def _histogram(df: DataFrame, columns: list[str], ends: dict[str, tuple[float, float]]) -> dict[str, list[tuple]]:
    """Per column the filled bins in order, as (smallest value, largest value, count).

    Rows are combined map-side, so the shuffle carries at most ``HISTOGRAM_BINS`` rows per column and task.
    """
    lows = F.array(*[F.lit(ends[c][0]) for c in columns])
    widths = F.array(*[F.lit((ends[c][1] / HISTOGRAM_BINS - ends[c][0] / HISTOGRAM_BINS) or 1.0) for c in columns])
    long = df.select(F.posexplode(F.array(*[col(c) for c in columns])).alias("c", "v")).where(F.col("v").isNotNull())
    inside = F.floor((F.col("v") - F.get(lows, F.col("c"))) / F.get(widths, F.col("c")))
    at = F.when(F.abs("v") < INFINITE, inside).when(F.col("v") > 0, HISTOGRAM_BINS + 1).otherwise(-1)
    bins = long.withColumn("b", at).groupBy("c", "b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    out: dict[str, list[tuple]] = {c: [] for c in columns}
    for r in bins.collect():
        out[columns[r["c"]]].append((r["lo"], r["hi"], r["n"]))
    return {c: sorted(rows) for c, rows in out.items()}


def _pick(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Values at the ranks of settled brackets, from the few rows inside them."""
    inside = df.where(reduce(or_, [b.holds() for b in brackets]))
    picks = [
        F.expr(
            f"percentile_disc({(b.rank - b.below + 0.5) / b.inside!r}D) WITHIN GROUP (ORDER BY "
            f"CASE WHEN {quoted(b.column)} >= {b.low!r}D AND {quoted(b.column)} <= {b.high!r}D "
            f"THEN {quoted(b.column)} END)"
        ).alias(f"p{i}")
        for i, b in enumerate(brackets)
    ]
    row = inside.agg(*picks).first()
    return {(b.column, b.rank): float(row[i]) for i, b in enumerate(brackets)}


def _order_statistics(df: DataFrame, wanted: dict[str, tuple[int, set[int]]], limit: int) -> dict:
    """Values at 0-based ranks; ``wanted`` maps a column to (number of values, ranks)."""
    columns = list(wanted)
    finite = [F.when(F.abs(col(c)) < INFINITE, col(c)) for c in columns]
    ends = [f(v).alias(f"{k}{i}") for i, v in enumerate(finite) for k, f in (("lo", F.min), ("hi", F.max))]
    row = one_row(df, ends)
    spans = {c: (float(row[f"lo{i}"] or 0.0), float(row[f"hi{i}"] or 0.0)) for i, c in enumerate(columns)}
    bins = _histogram(df, columns, spans)
    brackets = []
    for c in columns:
        for rank in sorted(wanted[c][1]):
            below = 0
            for low, high, size in bins[c]:
                if rank < below + size:
                    brackets.append(_Bracket(c, rank, float(low), float(high), below, size))
                    break
                below += size
    while open_ := [b for b in brackets if not b.settled(limit)]:
        _narrow(df, open_)
    out = {(b.column, b.rank): b.low for b in brackets if b.low == b.high}
    batch: list[_Bracket] = []
    for b in [b for b in brackets if b.low != b.high]:
        if batch and sum(x.inside for x in batch) + b.inside > 2 * limit:
            out |= _pick(df, batch)
            batch = []
        batch.append(b)
    return out | (_pick(df, batch) if batch else {})


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    counts: dict[str, int] | None = None,
    direct: int = DIRECT_LIMIT,
    pick: int = PICK_LIMIT,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of double columns, NULLs left out."""
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: row[i] for i, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns if counts[c] == 0}
    filled = [c for c in columns if counts[c] > 0]
    small = [c for c in filled if counts[c] <= direct]
    if small:
        wanted = [F.percentile(col(c), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}") for i, c in enumerate(small)]
        row = df.agg(*wanted).first()
        out.update({c: [float(v) for v in row[i]] for i, c in enumerate(small)})
    large = [c for c in filled if counts[c] > direct]
    if large:
        ranks = {}
        for c in large:
            spots = [(counts[c] - 1) * p for p in probs]
            ranks[c] = (counts[c], {math.floor(s) for s in spots} | {math.ceil(s) for s in spots})
        found = _order_statistics(df, ranks, pick)
        for c in large:
            result = []
            for p in probs:
                spot = (counts[c] - 1) * p
                before, after = math.floor(spot), math.ceil(spot)
                lo, hi = found[(c, before)], found[(c, after)]
                result.append(lo if lo == hi else (after - spot) * lo + (spot - before) * hi)
            out[c] = result
    return out


def exact_ranks(df: DataFrame, column: str, n: int, ranks: list[int], pick: int = PICK_LIMIT) -> list[float]:
    """Values at 0-based ranks of one column with ``n`` values, by the same bracketing."""
    found = _order_statistics(df, {column: (n, set(ranks))}, pick)
    return [found[(column, r)] for r in ranks]
