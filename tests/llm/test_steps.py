"""Gradient steps of the language model, against the plain form."""

from __future__ import annotations

import numpy as np
import pytest

from sheetlens.llm import maxent


@pytest.mark.parametrize("spread", [1, 3, 40, 5000])
def test_sums_are_those_of_every_row_on_its_own(spread):
    rng = np.random.default_rng(spread)
    r = rng.integers(0, spread, 700)
    gradient = rng.standard_normal((700, 8)).astype(np.float32)
    order = np.argsort(r, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(r[order]) != 0]))
    times = np.diff(np.append(first, len(r)))
    assert np.array_equal(maxent._sums(gradient, order, first, times), np.add.reduceat(gradient[order], first, axis=0))


def test_a_step_is_the_plain_step():
    rng = np.random.default_rng(5)
    start = rng.standard_normal((300, maxent.SLOTS)).astype(np.float32)
    start[7] = 90  # scores above the bound
    rows = [np.zeros(400, np.int64), rng.integers(1, 300, 400), np.minimum(rng.geometric(0.05, 400), 299)]
    target = rng.integers(0, maxent.SLOTS, 400)
    got, power, seen = start.copy(), np.ones(300, np.float32), np.zeros(300, np.int64)
    maxent._descend(got, power, seen, rows, target)
    want, held, times = start.astype(np.float64), np.ones(300), np.zeros(300, np.int64)
    gradient = np.exp(np.minimum(sum(want[r] for r in rows), 80))
    gradient /= gradient.sum(1, keepdims=True)
    gradient[np.arange(400), target] -= 1
    for r in rows:
        total = np.zeros((300, maxent.SLOTS))
        np.add.at(total, r, gradient)
        hit = np.bincount(r, minlength=300)
        held[hit > 0] += np.square(total).max(1)[hit > 0]
        times += hit
        want -= maxent.RATE * total / np.sqrt(held + 1)[:, None]
    assert np.array_equal(seen, times)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(power, held, rtol=1e-4)
