"""WARC archives as seekable Zstandard bundles.

An archive is a row of independent frames, each holding whole records of about ``FRAME_BYTES``, and ends with a
skippable frame that lists the compressed and plain size of every frame (the public seekable format: its footer holds
the number of frames, a descriptor byte and the magic number). Any Zstandard reader can read the file through; with the
table a reader goes to one frame. The index names, for each record, archive, frame, place and length in the frame.

Payloads that several pages share are kept once: the page with the largest id has the response record, the others have
revisit records that name it. A task writes one archive under a name of its own attempt; the index lists only archives
of attempts that ended well, so a task that runs again leaves nothing behind that is read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.session import new_path, ship_package, stage

FRAME_BYTES = 256 << 10
LEVEL = 3
SALTS = 16
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20

INDEX = "archive string, frame int, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint, record_id string, page_id bigint"
RECORDS = "page_id bigint, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _file_system(path: str):
    """(file system, path in it) of a shared path, by its scheme; a plain path is a shared mount."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(record_id: str, kind: str, uri: str, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; ``size`` is that of the full payload, also where the payload itself is left out."""
    http = b"" if kind == "resource" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    body = http + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Type, ids, digest, payload size and payload of the record that ``data`` holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    return {
        "record_id": fields["WARC-Record-ID"][1:-1],
        "record_type": fields["WARC-Type"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "size": size,
        "refers_to": fields.get("WARC-Refers-To", "<>")[1:-1] or None,
        "payload": payload,
    }


def record_id(page_id: int | None, row: str) -> str:
    """Page ids make record ids; rows that share a page id differ in the second part."""
    return f"urn:page:{'' if page_id is None else page_id}:{row}"


def page_of(record_id: str | None) -> int | None:
    page = record_id.split(":")[2] if record_id else ""
    return int(page) if page else None


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, sink):
        self.sink, self.at, self.table = sink, 0, []
        self.open_records: list[tuple[str, int | None, bytes]] = []
        self.open_bytes = 0
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, record_id: str, page_id: int | None, data: bytes):
        """Index rows of the frame that ``data`` fills, if it does."""
        self.open_records.append((record_id, page_id, data))
        self.open_bytes += len(data)
        return self.flush() if self.open_bytes >= FRAME_BYTES else []

    def flush(self):
        if not self.open_records:
            return []
        frame = self.press.compress(b"".join(d for _, _, d in self.open_records))
        self.sink.write(frame)
        rows, place = [], 0
        for name, page, data in self.open_records:
            rows.append((len(self.table), self.at, len(frame), place, len(data), name, page))
            place += len(data)
        self.table.append((len(frame), place))
        self.at += len(frame)
        self.open_records, self.open_bytes = [], 0
        return rows

    def finish(self):
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of every frame of an open bundle, read from its end."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def _write(folder: str):
    def run(batches):
        system, path = _file_system(folder)
        task = TaskContext.get()
        names = [f.split()[0] for f in INDEX.split(", ")]
        archive = writer = None

        def table(rows):
            columns = list(zip(*[(archive, *r) for r in rows]))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    archive = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{path}/{archive}", compression=None))
                payload = r["payload"]
                own = record_id(r["page_id"], r["row"])
                revisit = r["first"] is not None and r["first"] != own
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = record(own, "revisit" if revisit else "response", r["url"], digest, len(payload), r["first"], b"" if revisit else payload)
                if rows := writer.add(own, r["page_id"], data):
                    yield table(rows)
                if writer.at >= ARCHIVE_BYTES:
                    if rows := writer.finish():
                        yield table(rows)
                    writer.sink.close()
                    writer = None
        if writer is not None:
            if rows := writer.finish():
                yield table(rows)
            writer.sink.close()

    return run


def _first_of_copies(pages: DataFrame) -> DataFrame:
    """``pages`` with ``first``, the record id of the response for payloads that more than one row holds.

    Counting combines in the map tasks, and the few numbers of each repeated payload are copied over salts before the
    join, since one payload may fill a third of the table. Only digests and ids are joined by payload.
    """
    ids = pages.select("page_id", "row", "digest", "payload_bytes")
    order = F.struct("page_id", "row")
    repeated = ids.groupBy("digest", "payload_bytes").agg(F.max(order).alias("top"), F.count("*").alias("n")).where("n > 1")
    salted = repeated.select("digest", "payload_bytes", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(salted, ["digest", "payload_bytes", "salt"], "left")
    page = F.coalesce(F.col("top.page_id").cast("string"), F.lit(""))
    return joined.withColumn("first", F.when(F.col("top").isNotNull(), F.concat(F.lit("urn:page:"), page, F.lit(":"), F.col("top.row"))))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) into bundles in ``folder``; returns the staged index.

    Payloads are the html in UTF-8, null as empty. Of equal payloads of at least ``least_bytes`` bytes the largest page_id
    is the response. Null page_ids come before all others; rows that share page_id
    and payload are told apart by their url, and rows equal in all three are one record written twice.
    """
    spark = pages.sparkSession
    ship_package(spark)
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.xxhash64("url").alias("at"))
    numbered = rows.withColumn("row", F.hex("at"))
    shared = _first_of_copies(numbered.where(F.col("payload_bytes") >= least_bytes))
    small = numbered.where(F.col("payload_bytes") < least_bytes).withColumn("first", F.lit(None).cast("string"))
    columns = ["page_id", "url", "payload", "row", "first"]
    records = shared.select(columns).unionByName(small.select(columns)) if least_bytes else shared.select(columns)
    return stage(records.mapInArrow(_write(folder), INDEX), "index")


def _read(folder: str):
    def run(batches):
        system, path = _file_system(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        open_name = file = frames = None
        at, plain = None, b""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["archive"] != open_name:
                    if file is not None:
                        file.close()
                    open_name, at = r["archive"], None
                    file = system.open_input_file(f"{path}/{open_name}")
                    frames = seek_table(file)
                if r["frame"] != at:
                    at = r["frame"]
                    place, packed, size = frames[at]
                    file.seek(place)
                    plain = unpack.decompress(file.read(packed), max_output_size=size)
                found = parse(plain[r["record_at"] : r["record_at"] + r["record_bytes"]])
                if found["record_id"] != r["record_id"]:
                    raise ValueError(f"{r['record_id']} is not where the index says")
                if found["record_type"] == "response" and base64.b32encode(hashlib.sha1(found["payload"]).digest()).decode() != found["digest"]:
                    raise ValueError(f"payload of {r['record_id']} does not match its digest")
                out.append(
                    {
                        "page_id": page_of(found["record_id"]), "record_id": found["record_id"], "record_type": found["record_type"],
                        "payload_bytes": len(found["payload"]) if found["record_type"] == "response" else found["size"],
                        "payload_digest": found["digest"], "refers_to": page_of(found["refers_to"]), "payload": found["payload"],
                    }
                )
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if file is not None:
            file.close()

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (all of it, or rows picked from it) points to; only their frames are read."""
    ship_package(index.sparkSession)
    dealt = index.repartition("archive", "frame").sortWithinPartitions("archive", "frame", "record_at")
    return dealt.mapInArrow(_read(folder), RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per input row. Digest and size are those of the full payload for revisits as well; they come from the
    record's header. An empty table gives no archives and no rows. Other columns are not read.
    """
    folder = new_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
