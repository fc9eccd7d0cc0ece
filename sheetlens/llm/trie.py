"""A prefix tree of ordered sets, and the search of it for sets that overlap enough.

Sets are increasing integer arrays, so sets that begin alike share a path. A search carries all probes at once: an entry
is (probe, edge of the tree, overlap so far). The overlap of a shared path is counted once for all sets below, and an
entry goes no further when even the best set below cannot reach the threshold with the elements that are left.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

EDGE_LENGTH = 48
ENTRIES = 1 << 14


class Trie(NamedTuple):
    """Edges in arrays: element span, depth at the end, children span, set ending here, sizes of the sets below."""

    elements: np.ndarray
    start: np.ndarray
    length: np.ndarray
    depth: np.ndarray
    child_at: np.ndarray
    children: np.ndarray
    set_at: np.ndarray
    sets: np.ndarray
    least: np.ndarray
    most: np.ndarray
    top: np.ndarray


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def build(flat: np.ndarray, bounds: np.ndarray) -> Trie:
    """Tree of the non-empty sets ``flat[bounds[i]:bounds[i + 1]]``; equal sets end at one edge."""
    sizes = np.diff(bounds)
    keys = flat.astype(">u4").tobytes()
    order = sorted(np.flatnonzero(sizes > 0).tolist(), key=lambda i: keys[4 * bounds[i] : 4 * bounds[i + 1]])
    start, length, depth, parent, ends = [], [], [], [], []

    def edge(of: int, frm: int, to: int, above: int) -> int:
        while frm < to:
            step = min(to, frm + EDGE_LENGTH)
            start.append(int(bounds[of]) + frm)
            length.append(step - frm)
            depth.append(step)
            parent.append(above)
            ends.append([])
            above, frm = len(start) - 1, step
        return above

    path: list[int] = []  # edges from the root to the previous set's end
    before = None
    for i in order:
        here = flat[bounds[i] : bounds[i + 1]]
        common = 0 if before is None else _shared(before, here)
        while path and depth[path[-1]] > common:
            last = path[-1]
            if depth[last] - length[last] >= common:
                path.pop()
                continue
            # the paths part inside this edge: cut it in two; the lower half keeps the number and what hangs below
            upper = len(start)
            head = common - (depth[last] - length[last])
            start.append(start[last])
            length.append(head)
            depth.append(common)
            parent.append(parent[last])
            ends.append([])
            start[last] += head
            length[last] -= head
            parent[last] = upper
            path[-1] = upper
        above = path[-1] if path else -1
        first_new = len(start)
        tip = edge(i, common, len(here), above)
        path.extend(range(first_new, len(start)))
        ends[tip].append(i)
        before = here
    n = len(start)
    parent_, depth_ = np.array(parent, np.int64), np.array(depth, np.int64)
    least, most = np.full(n, 1 << 40), np.zeros(n, np.int64)
    for e in np.argsort(-depth_, kind="stable"):
        if ends[e]:
            least[e], most[e] = min(least[e], depth_[e]), max(most[e], depth_[e])
        if parent_[e] >= 0:
            least[parent_[e]] = min(least[parent_[e]], least[e])
            most[parent_[e]] = max(most[parent_[e]], most[e])
    below = np.argsort(parent_, kind="stable")
    counts = np.bincount(parent_[parent_ >= 0], minlength=n) if n else np.zeros(0, np.int64)
    n_top = int((parent_ < 0).sum())
    return Trie(
        flat, np.array(start, np.int64), np.array(length, np.int64), depth_,
        np.concatenate([[0], np.cumsum(counts)]) + n_top, below,
        np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int64),
        np.array([i for e in ends for i in e], np.int64), least, most, below[:n_top],
    )


def _spans(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... (counts[0] of them), at[1], ..."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - at, counts)


def search(tree: Trie, flat: np.ndarray, bounds: np.ndarray, probes: np.ndarray, num: int, den: int, universe: int):
    """(probe, set) pairs with den * intersection >= num * union; probes are numbers of sets in ``flat``."""
    found_p, found_s = [], []
    size = np.diff(bounds)[probes]
    held = np.zeros((len(probes), universe), bool)
    slots = np.repeat(np.arange(len(probes)), size)
    own = flat[_spans(bounds[:-1][probes], size)]
    held[slots, own] = True
    ranked = slots * np.int64(universe) + own
    first = np.cumsum(size) - size
    stack = [(np.repeat(np.arange(len(probes)), len(tree.top)), np.tile(tree.top, len(probes)), np.zeros(len(probes) * len(tree.top), np.int64))]
    while stack:
        probe, edge, overlap = stack.pop()
        if len(probe) > ENTRIES:
            stack.append((probe[ENTRIES:], edge[ENTRIES:], overlap[ENTRIES:]))
            probe, edge, overlap = probe[:ENTRIES], edge[:ENTRIES], overlap[:ENTRIES]
        if not len(probe):
            continue
        count = tree.length[edge]
        elements = tree.elements[_spans(tree.start[edge], count)]
        hit = held[np.repeat(probe, count), elements]
        overlap = overlap + np.add.reduceat(hit, np.cumsum(count) - count, dtype=np.int64)
        last = tree.elements[tree.start[edge] + count - 1]
        left = size[probe] - (np.searchsorted(ranked, probe * np.int64(universe) + last, "right") - first[probe])
        depth = tree.depth[edge]
        # the set below that fares best has as many elements left as the probe, if there is one
        best = np.clip(depth + left, tree.least[edge], tree.most[edge])
        alive = (overlap + np.minimum(left, best - depth)) * (num + den) >= num * (size[probe] + best)
        probe, edge, overlap, depth = probe[alive], edge[alive], overlap[alive], depth[alive]
        ending = tree.set_at[edge + 1] - tree.set_at[edge]
        linked = (ending > 0) & (overlap * (num + den) >= num * (size[probe] + depth))
        found_p.append(np.repeat(probe[linked], ending[linked]))
        found_s.append(tree.sets[_spans(tree.set_at[edge[linked]], ending[linked])])
        fan = tree.child_at[edge + 1] - tree.child_at[edge]
        if fan.any():
            stack.append((np.repeat(probe, fan), tree.children[_spans(tree.child_at[edge], fan)], np.repeat(overlap, fan)))
    if not found_p:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return probes[np.concatenate(found_p)], np.concatenate(found_s)


def links(flat: np.ndarray, bounds: np.ndarray, probes: np.ndarray, num: int, den: int):
    """Linked (probe, set) pairs of the sets of 64-bit elements in ``flat``; elements need only be ordered alike."""
    universe, local = np.unique(flat, return_inverse=True)
    local = local.astype(np.int64)
    tree = build(local, bounds)
    at_once = max(1, (32 << 20) // max(1, len(universe)))
    out_p, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(probes), at_once):
        p, s = search(tree, local, bounds, probes[i : i + at_once], num, den, len(universe))
        out_p.append(p)
        out_s.append(s)
    return np.concatenate(out_p), np.concatenate(out_s)
