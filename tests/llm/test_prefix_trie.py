"""Conversation trie against a plain one, with small shards and queues, and odd rows."""

import hashlib
import random
import zlib

import pytest

from sheetlens.llm import prefix_trie

KIND = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, own bigint"


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    out = {}
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in inside if paths[c] == node)
        out[inside[0], len(node)] = (
            members[node[:-1]][0] if node else None, len(inside), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[:-1] == n and m for m in members) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        if rng.random() < 0.1:
            continue
        start = rng.choice(["hi", "hello é", ""])
        for t in range(rng.randint(1, 14)):
            text = start if t == 0 else rng.choice(["a", "bb", "ccc"]) if t < 3 or rng.random() < 0.2 else "same"
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user", text))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    return [*rows, (None, 1, "user", "nobody"), *((500, t, "user", "same") for t in range(300)), *((501, t, "user", "same") for t in range(300))]


@pytest.mark.parametrize("members,entries", [(1 << 14, 200_000), (3, 4)])
def test_trie_equals_the_plain_one(spark, monkeypatch, members, entries):
    monkeypatch.setattr(prefix_trie, "SHARD_MEMBERS", members)
    monkeypatch.setattr(prefix_trie.SpillingQueue.__init__, "__defaults__", (entries,))
    rows = conversations(members)
    table = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], KIND).repartition(5)
    got = {}
    for r in prefix_trie.prefix_trie(table).collect():
        assert (r.conv_id, r.depth) not in got
        got[r.conv_id, r.depth] = (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
    assert got == plain_trie(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 1)], KIND)).count() == 0


def test_only_turnless_conversations(spark):
    # 1 takes its first turns from 0, which is not there, and has fewer turns of its own than it gives away
    assert zlib.crc32(b"1") % 9 > 1
    (root,) = prefix_trie.prefix_trie(spark.createDataFrame([(1, 1, "a", "b", 1, "x", 1)], KIND)).collect()
    assert root.asDict() == {
        "conv_id": 1, "depth": 0, "parent_conv_id": None, "n_convs": 1, "n_children": 0, "n_leaves": 1, "saved_tokens": 0,
        "ends_sha256": hashlib.sha256(b"1").hexdigest(),
    }


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, held = prefix_trie.SpillingQueue(10), []
    for _ in range(500):
        key = (rng.randint(0, 60), rng.randint(0, 3))
        queue.push(key, (len(held),))
        held.append((key, (len(held),)))
    assert queue.runs
    assert list(queue.pop_all((-1, 0))) == []
    for key in sorted({k for k, _ in held}):
        assert sorted(queue.pop_all(key)) == [p for k, p in held if k == key]


def test_ids_of_one_end_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    ends = spark.createDataFrame([(i % 3 // 2, 0, i) for i in range(400)], "k1 bigint, k2 bigint, conv_id bigint").repartition(6)
    got = {r.k1: r.ends_sha256 for r in prefix_trie.end_hashes(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(400) if i % 3 // 2 == k).encode()).hexdigest() for k in (0, 1)}
