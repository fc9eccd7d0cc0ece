"""Decontamination, secrets and quality against plain versions."""

import random
import re
import string
import zlib

import pyarrow as pa
import pytest
from brute import LONG, ODD, odd_documents

from sheetlens.llm import decontaminate, quality, secrets
from sheetlens.llm.decontaminate import Shard, build_postings, find_leaks, plain_words, question_and_answer, retrieve

ITEM = "doc_item bigint, item_id bigint, text string, score double"


def _sentence(rng, n):
    return " ".join("".join(rng.choice("aeiou" if k % 2 else "bcdlmnrst") for k in range(rng.randint(3, 8))) for _ in range(n))


def _benchmark(rng):
    return {i: _sentence(rng, n) for i, n in enumerate([8, 15, 30, 45, 60, 150])}


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    items = _benchmark(rng)
    rows, want = [], set()
    for i, text in items.items():
        rows.append((100 + i, _sentence(rng, 90) + " " + text + " " + _sentence(rng, 120)))
        rows.append((200 + i, text.upper().replace(" ", "!! ")))
        rows.append((300 + i, _sentence(rng, 80) + " " + " ".join(text.split()[: len(text.split()) // 4])))
        rows.append((400 + i, " ".join(sorted(text.split()))))
        want |= {(100 + i, i), (200 + i, i)}
    frame = spark.createDataFrame([(9, i, t, 0.0) for i, t in [*items.items(), (50, None), (51, ""), (None, "x y z"), (0, items[0])]], ITEM)
    found = find_leaks(odd_documents(spark, rows + ODD), question_and_answer(frame)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert len(found) == len(want)
    assert find_leaks(odd_documents(spark, rows), question_and_answer(frame.limit(0))).count() == 0


def test_block_max_search_loses_nothing(spark):
    rng = random.Random(8)
    items = {i: _sentence(rng, rng.randint(5, 70)) for i in range(40)}
    frame = spark.createDataFrame([(i, t) for i, t in items.items()], "item_id bigint, text string")
    wanted = question_and_answer(frame)
    shard = Shard(build_postings(wanted).collect(), wanted.collect())
    pool = " ".join(items.values()).split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for _ in range(30)] + [items[3], "", LONG[:3000]]
    found = plain_words(pa.array(texts))
    weight = {}
    for t, h in enumerate(shard.terms.tolist()):
        for k in range(shard.at[t * (shard.blocks + 1)], shard.at[(t + 1) * (shard.blocks + 1)]):
            weight[h, int(shard.entry[k])] = shard.weight[k]
    for threshold in (0.2, 0.5):
        got = {(r, e): s for r, e, s in zip(*(x.tolist() for x in retrieve(found, shard, threshold)))}
        best = {}
        for r in range(len(texts)):
            own = found.hash[found.row == r].tolist()
            for j in range(0, max(1, len(own)), decontaminate.STRIDE):
                terms = set(own[j : j + 2 * decontaminate.STRIDE])
                for e in range(len(shard.item)):
                    s = sum(weight.get((t, e), 0.0) for t in terms)
                    if s >= threshold + 1e-9:
                        best[r, e] = max(s, best.get((r, e), 0.0))
        assert set(best) <= set(got)
        assert all(got[k] >= threshold for k in got)


TEXTS = [
    'token = "abcdef1234"', "PASSWORD: short", "password: token: abcdefgh1", "api-key=x api_key='Zz0/+=_-.aa' apikey:12345678", "AKIA123 AKIAABCDEFGHIJKL0 xAKIA0000000000000",
    "é " * 5 + "0123456789abcdef" * 2 + " x", "0123456789abcdef" * 4, "secret=deadbeefdeadbeefdeadbeefdeadbeef", "paſſword: abcdefgh1", None, "", "plain words only",
]


def _plain_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return [(s, k, e) for s, _, k, e in sorted(out)]


def test_secret_spans(spark):
    rng = random.Random(2)
    key = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40))
    prose = "the nation has an organisation for international relations and realizes things in all of its stations " * 40
    rows = list(enumerate(TEXTS)) + [(49, prose), (50, f"é some {key} here"), (51, "internationalizationofthings and http example"), (52, LONG)]
    found = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(odd_documents(spark, rows)).collect()}
    for i, text in rows:
        assert [s for s in found[i] if s[1] != "markov"] == _plain_spans(text), text
    assert (7, "markov", 47) in found[50]
    assert found[51] == found[52] == []
    assert secrets.find_secrets(odd_documents(spark, [])).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = odd_documents(spark, [(1, 'a token = "0123456789abcdef0123456789abcdef" b'), (2, "clean"), (None, None), (2, "")])
    out = secrets.redact_secrets(docs)
    assert out.schema == docs.schema
    assert sorted(str(r["text"]) for r in out.collect()) == ["", "None", 'a [secret]" b', "clean"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 5 > 0
        words = _sentence(rng, rng.randint(5, 120)).split()
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark, labelled):
    rows, labels = labelled
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (900, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = odd_documents(spark, rows + [(1000, None), (1001, ""), (None, "text without id")])
    out = quality.score_quality(docs, known).collect()
    assert len(out) == len(rows) + 3
    by_id = {r["doc_id"]: r for r in out}
    want = dict((i, q) for i, q, _ in labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in want]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by_id.items() if i is not None)
    assert sum(r["predicted"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert by_id[1000]["score"] == by_id[1001]["score"]


def test_quality_without_labels_or_documents(spark, labelled):
    docs = odd_documents(spark, labelled[0][:5])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0
