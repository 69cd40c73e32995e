"""Removal of lines that many documents share, as one compressed keep bitmap per document.

Hashes of the lines are range-partitioned together with the document and the place, and sorted by them inside each
partition, so the lines of one key stand next to each other from the largest document id down and a key that a third of
all documents hold is spread over many partitions. One pass over each partition decides every key that lies inside it.
A key at the edge of a partition may go on in the next one: its first lines stay open, and a summary of at most three
documents tells the others about it, two summaries a partition at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import each_chunk, texts_of, with_answers, write_chunks
from .common import arrow_schema, store

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Hashed lines of one sorted partition, about.
PARTITION_LINES = 4 << 20
#: Documents that one batch returns.
BATCH_DOCUMENTS = 500
_KEY, _PLACE = ("high", "low"), ("chunk", "at")


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(WHITE).lower()


def _hashed(row: dict, min_chars: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for every distinct key of every document, with the places of its lines: row of the chunk << 32 | line."""
    owners, digests, places, ends = [], [], [], [0]
    for number, text in enumerate(texts_of(row)):
        own: dict[bytes, list[int]] = {}
        for line, content in enumerate(text.split(b"\n")):
            key = line_key(content)
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                own.setdefault(xxhash.xxh3_128_digest(key), []).append(number << 32 | line)
        for digest, at in own.items():
            owners.append(number)
            digests.append(digest)
            places += at
            ends.append(len(places))
    halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int64()))
    yield pa.RecordBatch.from_arrays([
        pa.array(halves[:, 0]), pa.array(halves[:, 1]), row["ids"].take(pa.array(owners, pa.int64())).cast(schema.field("id").type),
        pa.repeat(pa.scalar(row["chunk"], pa.int64()), len(owners)), pa.array([places[x] for x in ends[:-1]], pa.int64()), lists.cast(schema.field("lines").type),
    ], schema=schema)


class _Stream:
    """Runs of rows of one key and document, one run after the other; what is held are the runs of a few documents of one key."""

    def __init__(self, least: int):
        self.least, self.key, self.first = least, None, True
        self.edges: list[tuple] = []

    def start(self, key: tuple) -> None:
        self.first = self.key is None
        self.key, self.count, self.documents, self.held = key, 0, [], []

    def close(self, last: bool) -> list:
        """The runs that the rest of the table has to decide, where the key is the first or the last one here."""
        if not (self.first or last):
            return []
        self.edges.append((*self.key, self.documents))
        return [run for _, run in self.held]

    def take(self, document, run) -> list:
        """The runs that are known to go now that this one has come."""
        if not self.count or self.last != document:
            self.count, self.last = self.count + 1, document
            if self.count <= self.least:
                self.documents.append(document)
        if self.count >= self.least:
            gone = [x for place, x in self.held if place > 1]
            self.held = [x for x in self.held if x[0] == 1]
            return [*gone, run]
        if self.count > 1 or self.first:
            self.held.append((self.count, run))
        return []


def _decided(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that go (`open` false), rows still open, and a summary (`documents`) of each key at an edge."""
    stream = _Stream(least)

    def made(runs: list[tuple[pa.RecordBatch, int, int]], is_open: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches([batch.slice(a, b - a) for batch, a, b in runs]).combine_chunks().to_batches()[0]
        columns = {name: rows.column(name) for name in ("high", "low", "id", "chunk", "lines")}
        columns |= {"open": pa.repeat(pa.scalar(is_open), rows.num_rows), "documents": pa.nulls(rows.num_rows, schema.field("documents").type)}
        return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        gone, still = [], []
        rows = list(zip(*(batch.column(name).to_pylist() for name in ("high", "low", "id"))))
        starts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            high, low, document = rows[a]
            if stream.key != (high, low):
                still += stream.close(False) if stream.key else []
                stream.start((high, low))
            gone += stream.take(document, (batch, a, b))
        if gone:
            yield made(gone, False)
        if still:
            yield made(still, True)
        # What stays held is copied, so that it does not keep its batch in memory.
        stream.held = [(place, (x.take(pa.array(range(a, b), pa.int64())), 0, b - a) if x is batch else (x, a, b)) for place, (x, a, b) in stream.held]
    if stream.key:
        if rest := stream.close(True):
            yield made(rest, True)
        yield pa.RecordBatch.from_pylist(
            [{"high": high, "low": low, "documents": documents, "open": False} for high, low, documents in stream.edges], schema=schema
        )


def dropped_lines(chunks: DataFrame, id_type: T.DataType, min_chars: int, min_documents: int) -> DataFrame:
    """Places of the lines that go: (chunk, at)."""
    hashed = T.StructType([
        T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("id", id_type),
        T.StructField("chunk", T.LongType()), T.StructField("at", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())),
    ])
    arrow = arrow_schema(hashed)
    lines = store(each_chunk(chunks, lambda row: _hashed(row, min_chars, arrow), hashed)).df
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // PARTITION_LINES + 1)
    order = [*map(F.col, _KEY), F.desc_nulls_last("id"), *map(F.col, _PLACE)]
    placed = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    decided = T.StructType([
        *(f for f in hashed if f.name != "at"), T.StructField("open", T.BooleanType()), T.StructField("documents", T.ArrayType(id_type)),
    ])
    out = arrow_schema(decided)
    rows = store(placed.mapInArrow(lambda it: _decided(it, min_documents, out), decided)).df

    edges = rows.where("documents is not null").groupBy(*_KEY).agg(F.flatten(F.collect_list("documents")).alias("documents"))
    edges = edges.where(F.size(F.array_distinct("documents")) >= min_documents).select(*_KEY, F.array_max("documents").alias("keeper"))
    # Two rows a partition at most, so the table is bounded by the number of partitions.
    open_rows = rows.where("documents is null and open").join(F.broadcast(edges), [*_KEY])
    gone = rows.where("documents is null and not open").select("chunk", "lines").unionByName(
        open_rows.where(~F.col("id").eqNullSafe(F.col("keeper"))).select("chunk", "lines")
    )
    return gone.select("chunk", F.explode("lines").alias("at"))


# ---- bitmaps ---------------------------------------------------------------------------


def packed_bitmap(keep: np.ndarray) -> bytes:
    """One bit a line, the first line in the highest bit, compressed with zstandard where that is shorter."""
    bits = np.packbits(keep).tobytes()
    small = zstandard.ZstdCompressor(level=3).compress(bits)
    return b"\x01" + small if len(small) < len(bits) else b"\x00" + bits


def unpacked_bitmap(data: bytes, n_lines: int) -> np.ndarray:
    bits = zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"\x01" else data[1:]
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n_lines).astype(bool)


def kept_lines(text: bytes, bitmap: bytes) -> bytes:
    lines = text.split(b"\n")
    return b"\n".join([x for x, keep in zip(lines, unpacked_bitmap(bitmap, len(lines)).tolist()) if keep])


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: id, n_lines, n_dropped and `keep`, the compressed bitmap of the lines that stay.

    Lines are what \\n separates; a null or empty text is one empty line. The key of a line is the line without ASCII
    white space at its ends and with A-Z in lower case; keys are told apart by 128-bit hashes. A key of `min_chars`
    characters or more that `min_documents` ids or more hold loses all its lines but those of the largest id. A null id
    is one id, below all others. Rows with the same id count as one document when keys are counted and stay separate
    rows in the result. Other columns are ignored, whatever their names; an empty table gives no rows. With `with_text`
    a column `kept_text` holds the text after its bitmap is applied.
    """
    if min_documents < 2:
        raise ValueError("a line is shared by two documents at least")
    id_type = docs.schema[id_col].dataType
    chunks = write_chunks(docs, id_col, text_col).df
    gone = dropped_lines(chunks, id_type, min_chars, min_documents)
    packed = gone.groupBy("chunk").agg(F.collect_list("at").alias("at"))
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("keep", T.BinaryType()), *([T.StructField("kept_text", T.StringType())] if with_text else []),
    ])
    arrow = arrow_schema(schema)

    def marked(row: dict) -> Iterator[pa.RecordBatch]:
        at = np.sort(np.array((row["dropped"] or [{"at": []}])[0]["at"], np.int64))
        texts = texts_of(row)
        cuts = np.searchsorted(at >> 32, np.arange(len(texts) + 1))
        for a in range(0, len(texts), BATCH_DOCUMENTS):
            some, n_lines, n_dropped, keep = texts[a : a + BATCH_DOCUMENTS], [], [], []
            for number, text in enumerate(some, a):
                lines = text.count(b"\n") + 1
                stays = np.ones(lines, bool)
                stays[at[cuts[number] : cuts[number + 1]] & 0xFFFFFFFF] = False
                n_lines.append(lines)
                n_dropped.append(lines - int(stays.sum()))
                keep.append(packed_bitmap(stays))
            columns = [row["ids"][a : a + BATCH_DOCUMENTS].cast(arrow.field(id_col).type), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())]
            if with_text:
                columns.append(pa.array([kept_lines(t, k) for t, k in zip(some, keep)], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return each_chunk(with_answers(chunks, dropped=packed), marked, schema)
