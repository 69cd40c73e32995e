"""Whole documents in packed chunks, and exchanges between chunks by the hash of what they hold.

A chunk is one row with the texts of some whole documents, stored in a table bucketed by chunk. What all chunks must
agree on (which windows recur, how often a word occurs) is sent once per chunk and value, packed by hash bucket, and
the answers come back packed by chunk. So a value that a third of all rows hold is one value per chunk, and texts move
only once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, arrow_schema, batches_of, give_back, grouped, store_bucketed, utf8

CHUNK_BYTES = 8 << 20
#: Chunks that one Arrow batch takes to a Python worker.
CHUNKS_PER_BATCH = 16


def packed(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_strings(strings: list[bytes]) -> bytes:
    return packed(np.array([len(strings), *map(len, strings)], "<u4").tobytes() + b"".join(strings))


def unpack_strings(data: bytes) -> list[bytes]:
    raw = unpacked(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends)]


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of `values` with these starts and lengths, one after the other."""
    return values[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]


def write_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Stored:
    """The documents as rows (chunk, ids, sizes, data); a null text is empty."""
    batches_of(docs.sparkSession)
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType()),
    ])
    arrow = arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, held in enumerate(grouped(batches, "_text", chunk_bytes)):
            texts = utf8(held["_text"].combine_chunks())
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), held["_id"].combine_chunks())
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 32 | number], pa.int64()), ids.cast(arrow.field("ids").type),
                pa.array([packed(sizes)], pa.binary()), pa.array([packed(b"".join(texts))], pa.binary()),
            ], schema=arrow)
            del held, texts, sizes, ids
        give_back()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stored = store_bucketed(rows.mapInArrow(pack, schema), "chunk")
    batches_of(docs.sparkSession, CHUNKS_PER_BATCH)
    return stored


def texts_of(row: dict) -> list[bytes]:
    data, sizes = unpacked(row["data"]), np.frombuffer(unpacked(row["sizes"]), "<i8")
    ends = np.cumsum(sizes).tolist()
    return [data[b - n : b] for b, n in zip(ends, sizes.tolist())]


def each_chunk(chunks: DataFrame, work: Callable[[dict], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`work` on every chunk; the row's `ids` is an Arrow array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
                if "ids" in batch.schema.names:
                    row["ids"] = batch.column("ids")[i].values
                yield from work(row)
                del row
                give_back()

    return chunks.mapInArrow(run, schema)


def with_answers(chunks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Each chunk with the list of rows that came back for it; only the answers are moved.

    The hint builds the hash table from the answers of a bucket of chunks, which are smaller than the chunks.
    """
    for name, rows in answers.items():
        own = [c for c in rows.columns if c != "chunk"]
        listed = rows.groupBy("chunk").agg(F.collect_list(F.struct(*own)).alias(name))
        chunks = chunks.join(listed.hint("shuffle_hash"), "chunk", "left")
    return chunks


def by_bucket(values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Places of the values of every bucket, by the upper half of the 64-bit hash."""
    own = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    return [(int(own[part[0]]), part) for part in np.split(order, cuts) if len(part)]
