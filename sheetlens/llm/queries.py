"""Registered queries of this subpackage, each over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of at least 85 % of their distinct 4-word shingles."""
    from sheetlens.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "class_id", "component_id")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    import public_tokenizers

    from sheetlens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to Parquet list columns in document order and read back."""
    import public_tokenizers

    from sheetlens.llm.token_files import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learnt from the labelled ones that are not held out."""
    from sheetlens.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    from sheetlens.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in seekable bundles, read back."""
    from sheetlens.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


@query
def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, with the items."""
    from sheetlens.llm.decontaminate import find_leaks, question_and_answer

    return find_leaks(table(spark, sf_dir, "documents"), question_and_answer(table(spark, sf_dir, "benchmark")))


@query
def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the maximum-entropy model and under smoothed word counts."""
    from sheetlens.llm.maxent import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query
def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of every row of the embeddings whose vec_id is divisible by 20."""
    from sheetlens.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotations, with the message each one answers."""
    from sheetlens.llm.quotes import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


# the tables quote nothing, so every message answers the one before; quotations are tested against brute force
ORACLE["op2_quote_linking"] = """
SELECT conv_id, turn, role, text, lag(turn) OVER w AS reply_to, false AS quoted, first(turn) OVER w AS thread,
       row_number() OVER w - 1 AS depth
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated words of at least seven letters with their more frequent spelling."""
    from sheetlens.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")




@query
def op11_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, and its spans, learnt from the documents that are not held out."""
    from sheetlens.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations, with their subtree totals."""
    from sheetlens.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of a text's UTF-8 bytes, four bits at a time. Fixed values of that check sum: the remainders of the sixteen four-bit values.
CRC32 = """xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, 2 * octet_length(encode({0}))),
      lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode({0})), CAST(i + 2 - 2 * (i % 2) AS INTEGER), 1)) - 1 AS BIGINT))),
    lambda crc, four: xor(crc >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(crc, four) & 15)])
  ), 4294967295)"""

ORACLE["op13_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, n, {CRC32.format("(doc_id || ':' || run)")} AS h FROM counted),
thinned AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM summed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.spot = b.spot AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), walk(word, root) AS (
  SELECT word, word FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT walk.word, walk.root FROM walk JOIN forms g ON g.word = walk.root WHERE g.form IS NULL) r ON r.word = f.word
"""

ORACLE["op12_conversation_trie"] = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, own, conv_id - conv_id % 5 AS base, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM (SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id)
), rebuilt AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.own, 0)) + t.place - c.h, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN convs b ON b.conv_id = c.base
), prefixes AS MATERIALIZED (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS key, CAST(0 AS BIGINT) AS bytes FROM convs
  UNION ALL
  SELECT conv_id, CAST(place AS BIGINT), sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY place)), octet_length(encode(text))
  FROM rebuilt
), lengths AS (SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY conv_id),
nodes AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, max(len) = depth AS is_leaf,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY depth, key
), above AS MATERIALIZED (
  SELECT p.depth, p.key, n.depth AS below, n.key AS below_key, n.n_convs, n.bytes, n.is_leaf
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), totals AS (
  SELECT depth, key, count(*) FILTER (below = depth + 1) AS n_children, count(*) FILTER (is_leaf) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM above GROUP BY depth, key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t USING (depth, key) LEFT JOIN above a ON a.below = n.depth AND a.below_key = n.key AND a.depth = n.depth - 1
LEFT JOIN nodes p ON p.depth = a.depth AND p.key = a.key
"""
