"""SHA-256 of files too large for one task: the hash goes on from span to span of a file, each in a task of its own.

The hash is a chain over the bytes of a file, so its spans follow one another; but reading and cutting a file is the work
of many tasks, and no task that hashes holds more than a span of it.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir

#: Bytes of a file that one task hashes, and of one block (a row).
SPAN_BYTES, BLOCK_BYTES = 256 << 20, 256 << 10
MARK = b"\xef\xbb\xbf"


@cache
def _crypto() -> ctypes.CDLL:
    """The library that `hashlib` uses; `hashlib` itself cannot hand on the state of a hash."""
    import _hashlib

    library = ctypes.CDLL(getattr(_hashlib, "__file__", None))
    library.SHA256_Init.argtypes = [ctypes.c_void_p]
    library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    library.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    return library


class Sha256:
    """A SHA-256 whose state (OpenSSL's SHA256_CTX, 112 bytes) can be taken out and taken up in another task."""

    def __init__(self, state: bytes = b""):
        self._state = ctypes.create_string_buffer(state, 112) if state else ctypes.create_string_buffer(112)
        if not state:
            _crypto().SHA256_Init(self._state)

    def update(self, data: bytes) -> None:
        _crypto().SHA256_Update(self._state, data, len(data))

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        copy, out = ctypes.create_string_buffer(self._state.raw, 112), ctypes.create_string_buffer(32)
        _crypto().SHA256_Final(out, copy)
        return out.raw.hex()


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _cut(limit: int):
    """The lines of each split, each with its line feed again, as numbered blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            values = [(last[0], pa.string()), (last[1], pa.int64()), (number, pa.int64()), (bytes(held), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["path", "start", "number", "bytes"])

        last, number, held = None, 0, bytearray()
        for batch in batches:
            for path, start, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, start) != last:
                    if held:
                        yield row()
                    last, number, held = (path, start), 0, bytearray()
                held += value
                held += b"\n"
                if len(held) >= limit:
                    yield row()
                    number, held = number + 1, bytearray()
        if held:
            yield row()

    return cut


def _hash_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each file a row with its state (start -1), which comes first, and what the blocks after it make of it."""

    def row() -> pa.RecordBatch:
        values = [(path, pa.string()), (-1, pa.int64()), (-1, pa.int64()), (left, pa.int64()), (chain.state(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["path", "start", "number", "left", "bytes"])

    path, left, chain = None, 0, None
    for batch in batches:
        for own, start, _, rest, value in zip(*(c.to_pylist() for c in batch.columns)):
            if start < 0:
                if chain:
                    yield row()
                path, left, chain = own, rest, Sha256(value)
                continue
            value = value[:left]  # the last line of a file need not end in a line feed
            chain.update(value)
            left -= len(value)
    if chain:
        yield row()


def _closed(state):
    return Sha256(bytes(state)).hexdigest()


def chained_digests(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, sha256) of `files` (path, length), whose `lines` (path, start, value) come from a reader that cuts at line feeds.

    `start` is where the split of a line begins; the lines of a split are in order. The reader drops a byte order mark, which
    the length of the file tells. Everything is written to the shared folder; only states go from one span to the next.
    """
    spark, folder = files.sparkSession, f"{scratch_dir(files.sparkSession)}/{uuid.uuid4().hex}"
    with _batches_of(spark, 2000):
        blocks = lines.select("path", "start", F.col("value").cast("binary")).mapInArrow(_cut(BLOCK_BYTES), "path string, start bigint, number bigint, bytes binary")
        blocks = blocks.withColumn("span", F.floor(F.col("start") / SPAN_BYTES))
        blocks.write.partitionBy("span").option("compression", "zstd").parquet(folder)
    blocks = spark.read.schema("path string, start bigint, number bigint, bytes binary, span bigint").parquet(folder)
    sums = blocks.groupBy("path").agg(F.sum(F.octet_length("bytes")).alias("total"))
    marked = Sha256()
    marked.update(MARK)
    # Each line counts a line feed, so the lines of a whole file are never shorter than it.
    dropped = F.col("length") - F.coalesce("total", F.lit(0)) > 1
    states = materialize(files.join(sums, "path", "left").select(
        "path", F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("number"),
        F.when(dropped, F.col("length") - len(MARK)).otherwise(F.col("length")).alias("left"),
        F.when(dropped, F.lit(marked.state())).otherwise(F.lit(Sha256().state())).alias("bytes"),
    ))
    spans = sorted(r["span"] for r in blocks.select("span").distinct().collect())
    tasks = 2 * files.count()  # apart, so that files seldom meet in a task
    with _batches_of(spark, 100):
        for span in spans:
            here = blocks.where(F.col("span") == span).withColumn("left", F.lit(None).cast("bigint"))
            rows = states.unionByName(here.select(*states.columns)).repartition(tasks, "path")
            states = materialize(rows.sortWithinPartitions("path", "start", "number").mapInArrow(_hash_on, states.schema))
    whole = F.when(F.col("left") == 0, F.udf(_closed, "string")("bytes")).otherwise(F.raise_error(F.concat(F.lit("bytes were not read of "), "path")))
    return states.select("path", whole.alias("sha256"))
