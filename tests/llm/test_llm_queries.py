"""Registered queries of the subpackage: columns, rows and, where there is one, their SQL."""

import __spark_entry__ as entry_points
import pytest
from compare import compare, connect

from sheetlens.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op2": {"conv_id": "bigint", "turn": "bigint", "text": "string", "reply_to": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op12": {
        "conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint",
        "saved_tokens": "bigint", "ends_sha256": "string",
    },
    "op13": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    n = out.count()
    if name.split("_")[0] in ("op3", "op7", "op8", "op9", "op10", "op11"):
        assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert n > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir) == []


def test_all_are_registered():
    names = entry_points.queries()
    assert {"pipeline", *QUERIES} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
