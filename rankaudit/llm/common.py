"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_dir

#: Rows per Arrow batch; with texts of some kilobytes a batch holds a few megabytes.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch takes to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@dataclass(frozen=True)
class Stored:
    """A table written to the shared folder, and where it is."""

    df: DataFrame
    path: str

    def discard(self) -> None:
        """Delete the files, once everything made from them is written."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_WRITTEN: list[str] = []


def new_path(spark: SparkSession) -> str:
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(docs: DataFrame) -> None:
    """Delete the intermediate tables that this process has written, but for those that `docs` reads.

    For the start of a stage whose input is written: nothing that earlier stages kept for themselves is needed then.
    """
    spark = docs.sparkSession
    needed = docs.inputFiles()
    for name in list(_WRITTEN):
        if not any(name.rsplit("/", 1)[1] in file for file in needed):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _WRITTEN.remove(name)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them has ended, not when the driver collects its garbage.

    Not for `toLocalIterator` over a shuffle: its query has ended before its tasks run.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame) -> Stored:
    """Write `df` to the shared folder and read it back, so a lost executor costs no more than its own tasks."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def store_bucketed(df: DataFrame, key: str) -> Stored:
    """Like `store`, bucketed by `key`: later joins on the key move only their other side."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return Stored(spark.table(name), path)


def give_back() -> None:
    """Return what a task has freed to the system: Python workers wait for further tasks beside the JVM, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_schema(df_schema) -> pa.Schema:
    return to_arrow_schema(df_schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Batches joined into chunks of whole rows with about `limit` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def total_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text: one row to the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
