"""Helpers that several operators share: shared-folder tables and sizing.

Intermediate results that are read more than once, or that end an iteration,
are written as Parquet below ``spark.checkpoint.dir``: a folder that the
driver and every executor see, so that losing an executor loses nothing.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is
    unset, a local session (tests) gets a temporary one; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparktally-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths that this driver has handed out, for forget().
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/sparktally/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def forget(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Delete this driver's intermediate tables, but for the first `since` and
    that at `keep`. Results that were not written elsewhere can't be read after
    that."""
    for x in _WRITTEN[since:]:
        if x != keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _WRITTEN.remove(x)


def written() -> int:
    """How many tables there are, for forget()."""
    return len(_WRITTEN)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and
    what is read twice is computed once."""
    return stored_at(df, new_path(df.sparkSession, name))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Within, a query's shuffle files go when it ends (since Spark 4.1), not when
    the driver happens to collect its garbage. A query that runs again shuffles
    again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """Within, rows go to Python in Arrow batches of about BATCH_BYTES: both the
    executor and its worker hold a batch, and 10,000 texts are any size."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with shuffles_removed(spark), small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows (one cheap scan)."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def parts_for(spark: SparkSession, amount: int, per_part: int) -> int:
    """So many partitions that none gets more than about per_part."""
    return max(partitions(spark), -(-amount // per_part), 1)


def tidy(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows, and when they end the worker gives its free memory back: workers
    are kept for the next task, which may be another operator's."""
    yield from rows
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, work: Callable, schema) -> DataFrame:
    """mapInArrow of a generator function, tidied."""
    return df.mapInArrow(lambda batches: tidy(work(batches)), schema)
