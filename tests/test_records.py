"""CSV records from byte ranges: state functions, and rows equal to those of a reader of whole files."""

import random

import pytest

from sheetlens.sources import records
from sheetlens.sources.csv import read_csv


@pytest.mark.parametrize(
    "line,from_outside,from_inside",
    [
        (b"a,b", 0, 1), (b'"a,b', 1, 0), (b'a","b"', 0, 0), (b'5" pipe,x', 0, 0), (b'x,5"', 0, 0), (b'"a""b"', 0, 0), (b'"a""', 1, 0), (b'""', 0, 1), (b'","', 0, 1), (b'"', 1, 0), (b"", 0, 1), (b'x"y,"z\r', 1, 1),
    ],
)
def test_state_after_a_line(line, from_outside, from_inside):
    assert (records.line_end(line, 0), records.line_end(line, 1)) == (from_outside, from_inside)


def _write(path, rows, sep="\n"):
    def value(v):
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') or v == "" else v

    path.write_bytes(sep.join(",".join(map(value, r)) for r in rows).encode() + sep.encode())


@pytest.mark.parametrize("split", [250, 1 << 20])
def test_rows_equal_those_of_whole_files(spark, tmp_path, split):
    rng = random.Random(split)
    words = ["a", "b,c", 'say "hi"', "line\nbreak", '"\n"', "é\n\n", "x" * 600 + "\n" + "y" * 90, '",\n",', "5\" pipe", "plain text"]
    folder = tmp_path / "t.csv"
    folder.mkdir()
    files = []
    for k in range(3):
        rows = [[f"k{k}", str(i), rng.choice(words) + str(i), rng.choice(words)] for i in range(60)]
        _write(folder / f"part-{k}.csv", [["file", "id", "one", "two"], *rows])
        files.append(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        back = read_csv(spark, str(folder)).orderBy("_row_id").collect()
        plain = spark.read.options(header="true", quote='"', escape='"', multiLine="true").csv(str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["file"], r["id"], r["one"], r["two"]) for r in back] == [(r[0], int(r[1]), r[2], r[3]) for rows in files for r in rows]
    assert sorted((r["file"], r["id"], r["one"], r["two"]) for r in back) == sorted((r["file"], int(r["id"]), r["one"], r["two"]) for r in plain)
    assert len({r["_row_id"] for r in back}) == 180


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    _write(path, [["id", "text"], *([str(i), f'line "one"\nline two of {i}'] for i in range(4000))])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        cut = records.csv_records(spark, str(path))
        assert cut.count() == 4001
        assert cut.select("_from").distinct().count() >= 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_windows_line_ends_latin1_and_an_open_quote(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("id,name\r\n1,café\r\n\r\n2,\"x\r\ny\"\r\n3,\"open\r\nto the end".encode("latin-1"))
    got = [(r["id"], r["name"]) for r in read_csv(spark, str(path)).orderBy("_row_id").collect()]
    assert got[0] == (1, "café") and got[1][0] == 2 and got[1][1].split() == ["x", "y"] and got[2][0] == 3 and len(got) == 3
