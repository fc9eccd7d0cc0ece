"""The language model, vector search, archives, conversations and the pipeline."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from brute import LONG, ODD, odd_documents, tokens
from pyspark.sql import functions as F

import corpus_pipeline
from sheetlens.llm import maxent, neighbours, warc
from sheetlens.llm.quotes import reply_ordered
from sheetlens.session import new_path


def _two_languages(n):
    rng = random.Random(1)
    words = [[f"{p}{i}" for i in range(60)] for p in ("aa", "bb")]
    return [(i, " ".join(rng.choice(words[i % 2]) for _ in range(40))) for i in range(n)]


@pytest.mark.parametrize("known", [1 << 20, 30])
def test_language_model(spark, monkeypatch, known):
    monkeypatch.setattr(maxent, "KNOWN", known)  # a small table sends words through the join
    rows = _two_languages(300) + [(500 + i, t) for i, (_, t) in enumerate(ODD)]
    out = {r["doc_id"]: r for r in maxent.score_documents(odd_documents(spark, rows)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        own = [*tokens(t), None]
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(own), n)
        assert r["n_known"] == sum(w in counts for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
    fresh = [r for i, r in out.items() if held[i] and i < 500]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)


def test_untrained_scores_by_hand(spark, monkeypatch):
    monkeypatch.setattr(maxent, "ROUNDS", 0)  # the model's start: frequencies of classes, of slots, of words in a shared slot
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 40) + "zz" for _ in range(30))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "unseen words zz")]
    out = {r["doc_id"]: r["score"] for r in maxent.score_documents(odd_documents(spark, rows)).collect()}
    seen = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*tokens(t), None])
    found = maxent.Tokens(pa.array([w or "" for w in sorted({w for _, t in rows for w in tokens(t)})]))
    place = dict(zip(sorted({w for _, t in rows for w in tokens(t)}), zip(found.cls[::2].tolist(), found.hash[::2].view(np.int64).tolist())))
    place[None] = (0, int(maxent.END.astype(np.int64)))
    classes = Counter()
    for w, n in seen.items():
        classes[place[w][0]] += n
    heads = {c: sorted((w for w in seen if place[w][0] == c), key=lambda w: (-seen[w], place[w][1]))[: maxent.HEAD] for c in range(maxent.CLASSES)}
    assert any(len([w for w in seen if place[w][0] == c]) > maxent.HEAD for c in heads)

    def log_p(w):
        c = place[w][0]
        p = math.log10((classes[c] + 0.1) / (sum(classes.values()) + 0.1 * maxent.CLASSES))
        whole = classes[c] + 0.1 * maxent.SLOTS
        if w in heads[c]:
            return p + math.log10((seen[w] + 0.1) / whole)
        rest = [seen[o] for o in seen if place[o][0] == c and o not in heads[c]]
        return p + math.log10((sum(rest) + 0.1) / whole) + math.log10((seen[w] + 0.1) / (sum(rest) + 0.1 * (len(rest) + 1)))

    for i, t in rows:
        assert out[i] == pytest.approx(sum(log_p(w) for w in [*tokens(t), None]), rel=1e-4)


def test_words_beyond_the_heads_are_told_apart_in_a_history(spark, monkeypatch):
    # all words are of one class; 200 words that are no head words foretell which of 20 frequent words follows
    rng = random.Random(4)
    texts = []
    for i in range(600):
        picks = [rng.randrange(200) for _ in range(40)]
        texts.append((i, " ".join(f"w{p}zz h{p % 20}zz" for p in picks)))
    scores = {}
    for words in (0, 1 << 16):
        monkeypatch.setattr(maxent, "WORDS", words)
        held = maxent.score_documents(odd_documents(spark, texts)).where("held_out").collect()
        scores[words] = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert scores[1 << 16] > scores[0] + 0.1


def test_counts_beyond_31_bits():
    table = maxent.HashTable(np.array([7, 9], np.uint64), np.array([2**31 + 5, 2**40], np.int64))
    assert table.get(np.array([9, 7, 8], np.uint64), -1).tolist() == [2**40, 2**31 + 5, -1]


def test_changes_of_many_tasks_merge_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pieces, total, weight = [], np.zeros((maxent.BLOCK_ROWS, 4)), np.zeros(maxent.BLOCK_ROWS)
    for task in range(700):
        rows = np.sort(rng.choice(maxent.BLOCK_ROWS, 20, replace=False))
        seen, change = rng.integers(1, 9, 20), rng.standard_normal((20, 4)).astype(np.float16)
        total[rows] += change * seen[:, None]
        weight[rows] += seen
        pieces.append(maxent._piece(1, 2048, task // maxent.FAN_IN, rows, seen, change))
    frame = spark.createDataFrame(pa.Table.from_batches(pieces), maxent.CHANGES)
    (row,) = maxent.merged(frame, 700).collect()
    assert (row["number"], row["at"]) == (1, 2048)
    rows = np.frombuffer(row["rows"], np.int16)
    assert rows.tolist() == np.flatnonzero(weight).tolist() and np.frombuffer(row["seen"], np.int64).tolist() == weight[rows].tolist()
    change = np.frombuffer(row["change"], np.float16).reshape(-1, 4)
    assert np.allclose(change, total[rows] / weight[rows][:, None], atol=5e-3)


def test_language_model_on_nothing(spark):
    assert maxent.score_documents(odd_documents(spark, [])).count() == 0


def test_probabilities_of_a_history_sum_to_one():
    rng = np.random.default_rng(2)
    table = rng.standard_normal((50, maxent.SLOTS)).astype(np.float32)
    rows = [rng.integers(0, 50, 9), rng.integers(0, 50, 9)]
    each = [maxent.log_probability(table, rows, np.full(9, slot)) for slot in range(maxent.SLOTS)]
    assert np.allclose(np.exp(each).sum(0), 1, atol=1e-5)


def _vectors(n, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, 16)) * np.linspace(1, 3, n)[:, None]
    return [(i, [float(v) for v in row.astype(np.float32)], 0) for i, row in enumerate(x)]


def _brute(rows, k=20):
    ids = np.array([i for i, _, _ in rows])
    x = np.array([e for _, e, _ in rows], np.float64)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_nearest_vectors_with_copies_and_odd_rows(spark):
    rows = _vectors(900)
    rows += [(1000 + i, rows[5][1], 0) for i in range(60)]  # many copies of one vector
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0), (None, rows[0][1], 0), (2100, [float("inf")] * 16, 0), (2120, [], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad + rows[:3]], "vec_id bigint, embedding array<float>, label int, node string").repartition(3)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = _brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = [got[q][k] for k in range(1, 21)]
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0])) and len(got[q]) == 20
        hits += len({i for i, _ in mine} & {i for i, _ in best})
    assert hits >= 0.95 * 20 * len(want)
    assert [i for i, _ in (got[1000][k] for k in range(1, 6))] == [i for i, _ in want[1000][:5]]


@pytest.mark.parametrize("usual", ["unit", "lognormal"])
def test_nearest_vectors_among_some_far_longer_ones(spark, usual):
    rng = np.random.default_rng(3)
    n, d = 6000, 64
    x = rng.standard_normal((150, d))[rng.integers(0, 150, n)] + 0.7 * rng.standard_normal((n, d))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if usual == "lognormal":
        x *= rng.lognormal(0, 0.3, n)[:, None]
    x[[7, 1111, 2222, 3333, 4444]] *= [[100], [100], [300], [1000], [1000]]
    rows = [(i, [float(v) for v in row.astype(np.float32)], 0) for i, row in enumerate(x)]
    frame = spark.createDataFrame([r[:2] for r in rows], "vec_id bigint, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _brute(rows)
    assert set(got) == set(want)
    assert sum(len(got[q] & {i for i, _ in best}) for q, best in want.items()) >= 0.95 * 20 * len(want)


def test_few_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0]), (20, [-1.0, 2.0])], kind)
    out = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 0.5), (0, 2, 0.5), (0, 20, -1.0), (20, 1, 1.5), (20, 2, 1.5), (20, 0, -1.0)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], "page_id bigint, url string, html string, digest string, row int").repartition(3)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    rows = [(i, f"http://x/{i}", f"<p>{i % 40}</p>" * (1 + i % 7)) for i in range(300)] + [(900, None, None), (901, "u", ""), (902, "long", LONG), (None, "n", "alone"), (903, "é", "é\r\n\r\nWARC/1.1")]
    out = {r["page_id"]: r for r in warc.archive_pages(_pages(spark, rows)).collect()}
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        payload, first = (h or "").encode(), top[h or ""]
        first = None if first < 0 else first
        want = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
        r = out[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert len(out) == len(rows)
    assert warc.archive_pages(_pages(spark, [])).count() == 0


def test_archives_are_seekable_and_plain_zstandard(spark):
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(_pages(spark, [(i, "u", f"page {i} " * 9000) for i in range(30)]), folder)
    one = warc.read_archives(index.where("page_id = 17"), folder).first()
    assert bytes(one["payload"]) == ("page 17 " * 9000).encode()
    whole = b""
    system, path = warc._file_system(folder)
    frames = 0
    for info in system.get_file_info(pafs.FileSelector(path)):
        with system.open_input_file(info.path) as file:
            table = warc.seek_table(file)
            file.seek(0)
            data = file.read()
        frames += len(table)
        assert sum(packed for _, packed, _ in table) < len(data)
        whole += zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert frames > 1 and whole.count(b"WARC-Type: response") == 30


MESSAGES = "conv_id bigint, turn bigint, role string, text string, key string, level int"


def _talk(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], MESSAGES).repartition(2)


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?\n\nBye now"), (1, 1, "b", "On Monday A wrote:\n> Hello there.\n> How are you?\n\nFine"),
        (1, 2, "c", "> > How are you?\n> Fine\nMe too"), (1, 3, "d", "> bye NOW\nAnswer to the first"), (1, 4, "e", "no quote"),
        (2, 0, "a", None), (2, 1, "a", "> unknown text\nx"), (None, 0, "z", "alone"), (3, None, "q", "n"), (3, 1, "q", "> n"),
        (4, 0, "a", "ok"), (4, 1, "b", "ok"), (4, 2, "c", ">ok"), (4, 3, "d", "> ok\n>> Hello there."), (5, 7, "x", ""), (5, 9, "x", "a > b"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in reply_ordered(_talk(spark, rows)).collect()}
    assert len(got) == len(rows)
    link = {k: (r["reply_to"], r["quoted"], r["thread"], r["depth"]) for k, r in got.items()}
    assert [link[1, t] for t in range(5)] == [(None, False, 0, 0), (0, True, 0, 1), (1, True, 0, 2), (0, True, 0, 1), (3, False, 0, 2)]
    assert [got[1, t]["text"] for t in (1, 2, 3)] == ["Fine", "Me too", "Answer to the first"]
    assert link[2, 1] == (0, False, 0, 1) and got[2, 1]["text"] == "x" and got[2, 0]["text"] == ""
    assert link[None, 0] == (None, False, 0, 0) and link[3, 1][1] is True
    assert link[4, 2] == (1, True, 0, 2) and link[4, 3] == (1, True, 0, 2)
    assert link[5, 9] == (7, False, 7, 1) and got[5, 9]["text"] == "a > b"
    assert reply_ordered(_talk(spark, [])).count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_some_paragraphs_quoted_and_wrapped_anew(spark, end):
    first = "The harvest was late\nthis year in the north.\n\nPrices rose all summer\nand fell in autumn.\n\nNobody\nknows why."
    reply = "On Monday A wrote:\n> The harvest was\n> late this year in\n> the north.\n>\n> Prices rose all\n> summer and fell in autumn.\n\nI see"
    part = "> Prices rose all\n> summer and fell\n> in autumn.\n> \t\n> I see\n> \n> never said\n\nYes"
    rows = [(1, 0, "a", first), (1, 1, "b", "Something else"), (1, 2, "c", reply), (1, 3, "d", "I doubt it"), (1, 4, "e", part)]
    got = {r["turn"]: r for r in reply_ordered(_talk(spark, [(*r[:3], r[3].replace("\n", end)) for r in rows])).collect()}
    assert [(got[t]["reply_to"], got[t]["quoted"], got[t]["text"]) for t in (2, 3, 4)] == [(0, True, "I see"), (2, False, "I doubt it"), (0, True, "Yes")]


def test_quotations_run_without_python(spark):
    plan = reply_ordered(_talk(spark, [(1, 0, "a", "x"), (1, 1, "b", "> x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_threads(spark):
    out = reply_ordered(_talk(spark, [(1, t, "a", f"m{t}") for t in range(0, 6000, 3)])).orderBy("turn").collect()
    assert [(r["reply_to"], r["depth"]) for r in out[:2]] == [(None, 0), (0, 1)]
    assert all(r["depth"] == k and (k == 0 or r["reply_to"] == 3 * (k - 1)) for k, r in enumerate(out))


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [(i, text(120)) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in text(80).split())) for i in range(30)]
    item = text(30)
    copy = clean[0][1]
    docs = clean + junk + [(200, copy), (201, copy + " end"), (202, text(60) + " " + item + " " + text(60)), (203, text(50) + ' token = "0123456789abcdef" ' + text(50)), (204, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "packing"]
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, apply in corpus_pipeline.STAGES[:-1]:
        columns = table.dtypes
        table = spark.createDataFrame(apply(spark, table, str(tmp_path)).collect(), table.schema)
        assert table.dtypes == columns
    kept = {r["doc_id"]: r for r in table.collect()}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(kept) == packed
    assert {i for i, _ in clean} <= packed and not packed & ({i for i, _ in junk} | {200, 201, 202})
    assert "[secret]" in kept[203]["text"] and kept[203]["n_chars"] == len(kept[203]["text"])
    assert all(kept[i]["text"] == t for i, t in clean)
