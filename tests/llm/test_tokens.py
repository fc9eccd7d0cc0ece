"""Encoding, token files and packing against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from brute import ODD, odd_documents
from tokenizers import Tokenizer

from sheetlens.llm import encoding, packing, token_files
from sheetlens.llm.texts import as_texts
from sheetlens.session import new_path

TEXTS = [
    None, "", " ", "a  b", "a \n b\n", "x's 'll it's", " a b  c　 d", "é ́x", "ΑΣ Σ", "<|endoftext|> x", "12 345",
    "a\tb\x1cc d", " lead", "trail ", "é ê è", " x   y", "it's we've I'LL", "a" * 5000,
]


def ids_of(name: str, text: str | None) -> list[int]:
    tool = Tokenizer.from_file(public_tokenizers.path(name))
    tool.encode_special_tokens = True
    return tool.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_IDS", 300)  # the memo fills up and starts anew
    tool = encoding.Encoder(public_tokenizers.path(name))
    for _ in range(2):
        ids, bounds = tool.encode(as_texts(pa.array(TEXTS)))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(name, t) for t in TEXTS]


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_files.token_digests(odd_documents(spark, ODD), path).collect()
    rows = sorted(out, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter()
    for i, t in ODD:
        x = ids_of("byte_bpe_50k.json", t)
        want[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.token_digests(odd_documents(spark, []), path).count() == 0


def test_token_files_are_read_in_parts(spark):
    path = new_path(spark, "parts")
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 50) AS text")
    token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    rows = token_files.read_tokens(spark, path)
    assert rows.where("doc_id = 123").select("ids").first()[0][-1] == 0
    plan = rows.select("doc_id", "start").where("doc_id > 490")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,490)" in plan
    assert "ids:" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_packing_holds_every_piece_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = ODD + [(100 + i, "word " * (i * 37 % 900)) for i in range(120)]
    out = packing.pack_documents(odd_documents(spark, rows), path, capacity=256).collect()
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want, total = Counter(), 0
    for i, t in rows:
        x = ids_of("word_bpe_49k.json", t)
        total += len(x)
        for k in range(0, len(x), 256):
            want[i, k // 256, k, len(x[k : k + 256]), zlib.crc32(np.array(x[k : k + 256], "<u4").tobytes())] += 1
    assert got == want
    assert len(sequences) <= 1.03 * -(-total // 256) + 1
    assert packing.pack_documents(odd_documents(spark, []), path).count() == 0


def _fewest(sizes: tuple[int, ...], capacity: int) -> int:
    """Smallest number of bins, by trying all placements."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best and k < len(sizes):
            return
        if k == len(sizes):
            best = min(best, len(rooms))
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        sizes = tuple(sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist(), reverse=True))
        left = np.bincount(sizes, minlength=capacity + 1)
        slots = packing._Slots(capacity)
        fixed = packing.reduce(left, capacity, slots)
        rest = tuple(s for s in range(capacity, 0, -1) for _ in range(left[s]))
        assert fixed + (_fewest(rest, capacity) if rest else 0) == _fewest(sizes, capacity), (capacity, sizes)
        assert packing.plan(Counter(sizes), capacity)[1] >= _fewest(sizes, capacity)
