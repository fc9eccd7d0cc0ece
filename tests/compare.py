"""Run registered queries beside their SQL and compare rows.

Usage: python tests/compare.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


#: Queries beyond SQL, with what must hold of their rows.
PROPERTIES = {
    "dashboard_bundle": lambda rows, con: all(r[0] for r in rows) and len(rows) > 3,
}


def compare(spark, con, name, fn, sql, sf_dir) -> list[str]:
    """Differences between a query and its SQL; empty when they agree exactly."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        check = PROPERTIES.get(name)
        if check is None:
            return ["neither SQL nor a property to check"]
        return [] if got and check(got, con) else ["property does not hold" if got else "EMPTY RESULT"]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    faults = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for c, t in df.dtypes:
        if TYPES.get(t) != kinds[c]:
            faults.append(f"type of {c}: {t} != {kinds[c]}")
    if len(got) != len(want):
        faults.append(f"rows {len(got)} != {len(want)}")
    a, b = _rows(df.columns, got), _rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        faults.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    if not got:
        faults.append("EMPTY RESULT")
    return faults


def main() -> None:
    from sheetlens import build_session
    from sheetlens.plans.queries import ORACLE, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            faults = compare(spark, con, name, fn, ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            faults = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(faults)
        state = "ok " if not faults else "BAD"
        print(f"{state} {time.time() - t:6.2f}s {name} {'' if name in ORACLE else '(rows only)'} {faults or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
