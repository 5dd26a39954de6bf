"""What the operators share: column picking, shared storage and bounded batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, where the session has Spark's default: ten thousand texts would be tens of megabytes at once.
BATCH = "1000"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` rows, unless the session asks for another number."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """``new_name=exact_old_name`` columns only.

    Columns are addressed by position, so others whose names differ only in
    case, hold dots or clash with an operator's own names do no harm.
    """
    small_batches(df.sparkSession)  # every operator picks its columns first
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{df.columns.index(old)}").alias(new) for new, old in cols.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; our own only where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    at = sc.getCheckpointDir()
    if at is None:
        own = tempfile.mkdtemp(prefix="evidencelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    _remove(df.sparkSession, df._evl_path)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch space
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/evl-{uuid.uuid4().hex}/{name}"
    atexit.register(_at_exit, spark, path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evl_path = path
    return out


def give_back() -> None:
    """Freed memory back to the system: Spark keeps Python workers, and their allocators keep what they once held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:  # a platform without one to ask
        return None


def lean(run: Callable) -> Callable:
    """A function of one or two Arrow tables that gives memory back when it is done."""

    def one(table):
        try:
            return run(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return one if len(inspect.signature(run).parameters) == 1 else two  # Spark counts them


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` of text (one row at least), so a worker's memory stays bounded."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        at = 0
        while at < n:
            base = int(size[at - 1]) if at else 0
            to = max(at + 1, int(size.searchsorted(base + max_bytes, side="right")))
            yield b.slice(at, min(to, n) - at)
            at = to
    give_back()
