"""Language of spans: the search against a plain one, held-out accuracy, scripts, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from brute import ODD, odd_documents

from sheetlens.llm import language


def plain_viterbi(score, penalty):
    now, back = np.zeros(score.shape[1]), []
    for own in score:
        k = int(now.argmax())
        back.append(np.where(now >= now[k] - penalty, np.arange(len(now)), k))
        now = np.maximum(now, now[k] - penalty) + own
    at, out = int(now.argmax()), []
    for step in reversed(back):
        out.append(at)
        at = step[at]
    return out[::-1]


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_equals_the_plain_search(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 1500)), int(rng.integers(2, 20))
    score = -rng.exponential(3, (n, k))
    score -= score.max(1, keepdims=True)
    row = np.sort(rng.integers(0, 5, n))
    got = language.viterbi(score, row, 4.0)
    for i in range(5):
        assert list(got[row == i]) == plain_viterbi(score[row == i], 4.0)


def test_words_are_runs_of_one_script():
    text = "Straße 12 naïve-абв中文 x"
    (_, points, bounds), *_ = language.pieces(pa.array([text, ""]))
    found = language.find_words(points, bounds)
    assert [text[a:b] for a, b in zip(found.start, found.end)] == ["Straße", "naïve", "абв", "中", "文", "x"]
    assert [language.NAMES[s] for s in found.script] == ["latin", "latin", "cyrillic", "han", "han", "latin"]


EN, DE, RU = "the cat was sitting on that old thing and thinking ", "der Hund schläft über dem großen Tisch nicht ", "кошка сидит на старом столе и думает "


def training(spark, extra=()):
    rows = [(i, t * (1 + i % 3), lang) for i in range(60) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    return spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, lang string").repartition(4)


def test_spans_of_mixed_text(spark):
    mixed = EN + DE + RU + EN
    rows = [(1001, mixed, None), (1002, RU, "en"), (1003, "12 34 -- !", "en"), (1004, None, "en"), (1005, "", None), (1006, "αβγ δεζ", None)]
    got = {r.doc_id: r for r in language.identify_languages(training(spark, rows)).where("doc_id > 1000").collect()}
    assert [(mixed[s.start : s.end].strip(), s.lang) for s in got[1001].spans] == [(EN.strip(), "en"), (DE.strip(), "de"), (RU.strip(), "ru"), (EN.strip(), "en")]
    assert got[1001].lang_pred == "en" and 0 < got[1001].score < 0.7
    # the script leaves one candidate only
    assert got[1002].lang_pred == "ru" and got[1002].score > 0.95
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (1003, 1004, 1005)] == [("und", 0.0, [])] * 3
    assert got[1006].lang_pred in ("en", "de", "ru") and got[1006].score == pytest.approx(1 / 3)


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    wrong = [(i, "zzyx qqvw zzyx", "xx") for i in range(5000, 5200) if zlib.crc32(str(i).encode()) % 5 == 0]
    out = language.identify_languages(training(spark, [*wrong, (None, "zzyx", "yy")]))
    assert {r.lang_pred for r in out.select("lang_pred").distinct().collect()} == {"en", "de", "ru"}
    assert all(r.held_out for r in out.where("doc_id >= 5000").collect())


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify_languages(docs).where("held_out").join(docs, "doc_id").where("text rlike '[a-z]'")
    right, n = out.selectExpr("sum(cast(lang = lang_pred as int)) r", "count(*) n").first()
    assert n > 150 and right >= 0.98 * n


def test_odd_rows(spark):
    docs = odd_documents(spark, ODD)
    out = language.identify_languages(docs)
    assert out.count() == len(ODD)
    assert {r.lang_pred for r in out.collect()} <= {"en", "und"}
    none = language.identify_languages(docs.where("doc_id = -1"))
    assert none.columns == ["doc_id", "held_out", "lang_pred", "score", "spans"] and none.count() == 0
    # nothing to learn from
    assert {(r.lang_pred, r.score) for r in language.identify_languages(docs.where("lang IS NULL")).collect()} == {("und", 0.0)}
