"""Session set-up and the shared folder that intermediate tables go to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_shipping = threading.Lock()


def build_session(app: str = "sheetlens", cpus: str | int = "*") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a session inside one JVM gets a folder of its own when the setting is missing; a cluster must name one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="sheetlens-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/sheetlens/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    This cuts the lineage: a lost executor costs a re-read of its splits, not the
    shuffles before them. Parquet also keeps later passes column-pruned.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def publish_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content in one step; False, and nothing changed, if it is there already.

    A local file is linked into place. Elsewhere a finished file is renamed, which must fail where the target exists,
    as it does in HDFS.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".draft-{uuid.uuid4().hex}")
    if system.getScheme() == "file":
        source, target = draft.toUri().getPath(), where.toUri().getPath()
        with open(source, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    out = system.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not system.exists(where) and system.rename(draft, where):
        return True
    system.delete(draft, False)
    return False


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/sheetlens/" in folder:
                drop_folder(spark, folder)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that their Python functions can import it."""
    sc = spark.sparkContext
    # operators that run side by side may both ask
    with _shipping:
        if sc.applicationId in _shipped:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(package):
            archive = os.path.join(tempfile.mkdtemp(prefix="sheetlens-ship-"), f"sheetlens-{sc.applicationId}.zip")
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
                for folder, _, names in os.walk(package):
                    for name in sorted(n for n in names if n.endswith(".py")):
                        file = os.path.join(folder, name)
                        out.write(file, os.path.join("sheetlens", os.path.relpath(file, package)))
            sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


ROWS_PER_TASK = 5_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` over more cores, when it has fewer splits than the work on its ``rows`` rows is worth."""
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_TASK)
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


#: Bytes of a batch of rows on its way to Python; a number below 2**31 - 1 has them added up after every row.
BATCH_BYTES_KEY, UNMEASURED = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)
_unmeasured: list[str] = []
_measuring = threading.Lock()


@contextmanager
def unmeasured_rows(spark: SparkSession):
    """Inside, batches of rows for Python end by their number of rows alone: for rows of a few numbers, whose bytes take longer to add up than to send."""
    # operators that run side by side share the session's settings: the last one to leave puts the old one back
    with _measuring:
        _unmeasured.append(_unmeasured[0] if _unmeasured else spark.conf.get(BATCH_BYTES_KEY))
        spark.conf.set(BATCH_BYTES_KEY, UNMEASURED)
    try:
        yield
    finally:
        with _measuring:
            before = _unmeasured.pop()
            if not _unmeasured:
                spark.conf.set(BATCH_BYTES_KEY, before)


def run_together(tasks: dict[str, Callable[[], Any]]) -> dict[str, Any]:
    """Submit independent jobs at once, so that short stages of one fill the cores another leaves idle."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(max_workers=6) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(task)) for name, task in tasks.items()}
        return {name: job.result() for name, job in running.items()}


def small_frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """DataFrame of a few driver-side rows (column profiles, bounds, k-row reports)."""
    schema = StructType.fromDDL(ddl)
    data = [{f.name: r.get(f.name) for f in schema.fields} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(schema)), schema=schema)
