"""Secrets in texts: set patterns, and random-looking strings told apart by two character Markov models.

The models give the probability of a character after the one before. One is trained on labelled random strings (what the
set patterns match in all documents, and ``MADE`` strings derived from hashes so that every usual alphabet is known), the
other on ordinary identifiers and words (runs of the same characters outside those matches, in all documents). Both are
tables of 67 x 67 counts. A run of at least ``LEAST`` characters is a secret when the log-likelihood ratio per character
reaches ``RATIO``. Spans count code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.texts import as_texts, chunks, raw
from sheetlens.session import ship_package

KINDS = ("assign", "access", "hex", "markov")
LEAST = 20
RATIO = 0.6
WORD_LEAST = 6
MADE = 2000

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = "(?i)passw|secret|token|api_?key"
PLACEHOLDER = "[secret]"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIGNS = len(ALPHABET)
_SIGN = np.full(256, -1, np.int16)
_SIGN[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIGNS)
_IS_HEX = np.zeros(256, bool)
_IS_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def base_spans(text: str) -> list[tuple[int, str, int, tuple[int, int]]]:
    """(start, kind, end, span of the secret itself) of the set patterns, by start and kind."""
    out = [(m.start(), "assign", m.end(), m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end(), m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end(), m.span()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _runs(inside: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of at least ``least`` true bytes; a run ends with its text."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    filled = bounds[1:] > bounds[:-1]
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    long = end - start >= least
    return start[long], end[long]


class _Scan:
    """One chunk of texts: which hold a set pattern, and the runs of secret-like characters outside those."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.data, self.bounds = raw(texts)
        maybe = pc.match_substring_regex(texts, KEYWORDS).to_numpy(zero_copy_only=False) | pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
        hex_start, _ = _runs(_IS_HEX[self.data], self.bounds, 32)
        maybe[np.searchsorted(self.bounds[1:], hex_start, "right")] = True
        self.base: dict[int, list] = {}
        self.held = np.zeros(len(self.data), bool)  # bytes of base spans
        self.values: list[bytes] = []
        for i in np.flatnonzero(maybe).tolist():
            text = texts[i].as_py()
            found = base_spans(text)
            if not found:
                continue
            self.base[i] = found
            for start, _, end, (a, b) in found:
                first = int(self.bounds[i]) + len(text[:start].encode())
                self.held[first : first + len(text[start:end].encode())] = True
                self.values.append(text[a:b].encode())
        self.sign = _SIGN[self.data]

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        return _runs((self.sign >= 0) & ~self.held, self.bounds, least)

    def steps(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(step from sign to sign as one number, first step of each run)."""
        counts = end - start - 1
        first = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) - np.repeat(first - start, counts)
        return self.sign[at].astype(np.int64) * SIGNS + self.sign[at + 1], first


def _count(batches):
    random, ordinary = np.zeros(SIGNS * SIGNS, np.int64), np.zeros(SIGNS * SIGNS, np.int64)
    for batch in batches:
        for _, texts in chunks(as_texts(batch.column("text"))):
            scan = _Scan(texts)
            step, _ = scan.steps(*scan.runs(WORD_LEAST))
            ordinary += np.bincount(step, minlength=SIGNS * SIGNS)
            random += _steps_of(scan.values)
    used = np.flatnonzero(random + ordinary)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(random[used]), pa.array(ordinary[used])], ["step", "random", "ordinary"])


def _steps_of(strings: list[bytes]) -> np.ndarray:
    total = np.zeros(SIGNS * SIGNS, np.int64)
    for s in strings:
        sign = _SIGN[np.frombuffer(s, np.uint8)].astype(np.int64)
        both = (sign[:-1] >= 0) & (sign[1:] >= 0)
        total += np.bincount(sign[:-1][both] * SIGNS + sign[1:][both], minlength=SIGNS * SIGNS)
    return total


def made_strings() -> list[bytes]:
    """Random strings of the usual alphabets: base64, its URL form, base32 and hexadecimal."""
    out = []
    for i in range(MADE):
        digest = hashlib.sha256(f"random string {i}".encode()).digest()
        out.append((base64.b64encode, base64.urlsafe_b64encode, base64.b32encode, lambda d: d.hex().encode())[i % 4](digest).rstrip(b"="))
    return out


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of every step from character to character; counts cover all documents."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "step bigint, random bigint, ordinary bigint")
    rows = counted.groupBy("step").agg(F.sum("random"), F.sum("ordinary")).collect()
    random, ordinary = _steps_of(made_strings()).astype(float), np.zeros(SIGNS * SIGNS)
    found = np.zeros(SIGNS * SIGNS)
    for step, r, o in rows:
        found[step], ordinary[step] = r, o
    # found and made samples weigh the same, however many were found
    random += found * (random.sum() / max(found.sum(), random.sum()))

    def log(counts: np.ndarray) -> np.ndarray:
        table = counts.reshape(SIGNS, SIGNS) + 0.5
        return np.log(table / table.sum(1, keepdims=True)).ravel()

    return log(random) - log(ordinary)


def _spans(scan: _Scan, ratio: np.ndarray) -> dict[int, list[tuple[int, str, int]]]:
    """All spans of a chunk's texts, by start and kind."""
    spans = {i: [(s, k, e) for s, k, e, _ in found] for i, found in scan.base.items()}
    start, end = scan.runs(LEAST)
    if len(start):
        step, first = scan.steps(start, end)
        likely = np.add.reduceat(ratio[step], first) >= RATIO * (end - start - 1)
        rows = np.searchsorted(scan.bounds[1:], start[likely], "right")
        for i, a, b in zip(rows.tolist(), start[likely].tolist(), end[likely].tolist()):
            head = bytes(scan.data[scan.bounds[i] : a]).decode()
            spans.setdefault(i, []).append((len(head), "markov", len(head) + b - a))
    return {i: sorted(s, key=lambda x: (x[0], KINDS.index(x[1]))) for i, s in spans.items()}


SPANS = "array<struct<kind: string, start: int, end: int>>"


def _find(ratio):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            for at, texts in chunks(as_texts(batch.column("text"))):
                spans = _spans(_Scan(texts), ratio.value)
                rows = [[{"kind": k, "start": s, "end": e} for s, k, e in spans.get(i, ())] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end) by start and kind.

    Null and empty texts have none. Markov spans never overlap those of the set patterns. Rows are independent of each
    other but for the trained models. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train(docs) if ratio is None else ratio)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_find(model), f"doc_id bigint, spans {SPANS}")


def without_spans(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with every span replaced by the placeholder; spans that overlap become one."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(ratio):
    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            column = batch.column(place)
            found = {at + i: s for at, texts in chunks(as_texts(column)) for i, s in _spans(_Scan(texts), ratio.value).items()}
            if found:
                texts = column.to_pylist()
                for i, spans in found.items():
                    texts[i] = without_spans(texts[i], spans)
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))
            yield batch

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; all rows and the other columns stay as they are, null texts too."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(_redact(model), docs.schema)
