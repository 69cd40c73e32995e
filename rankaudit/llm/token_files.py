"""Token ids in binary files of independent zstandard frames.

Layout of a file, after the public seekable zstandard format: frames of token ids (little endian, 2 or 4
bytes each, cut at the end of a document or, inside a long one, at `FRAME_IDS`), one frame with the index of
documents, then a skippable frame with the seek table: compressed size, size and checksum of every frame.
A reader fetches the table and the index, and then decompresses only the frames that hold what it wants.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CHUNKS_PER_BATCH, by_bucket, each_chunk, gathered, pack_strings, packed, unpack_strings, unpacked, with_answers
from .common import arrow_schema, batches_of, grouped, new_path, store, store_bucketed, total_bytes, utf8

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_IDS = 1 << 16
FILE_SCHEMA = "file string, part bigint, rows bigint, tokens bigint"
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 16 << 20


def _checksum(data: bytes) -> int:
    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


class FrameWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, out, width: int, level: int = 3):
        self.out, self.kind, self.compressor = out, np.dtype("<u2" if width == 2 else "<u4"), zstandard.ZstdCompressor(level=level)
        self.table, self.lengths, self.held, self.n_held, self.tokens = [], [], [], 0, 0

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.table.append((len(packed), len(data), _checksum(data)))
        self.out.write(packed)

    def _flush(self) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            for i in range(0, len(ids), FRAME_IDS):
                self._frame(ids[i : i + FRAME_IDS].tobytes())
        self.held, self.n_held = [], 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(self.kind).max):
            raise ValueError(f"an id does not fit in {self.kind.itemsize} bytes: {ids.min()} to {ids.max()}")
        self.held.append(ids.astype(self.kind))
        self.lengths.append(len(ids))
        self.n_held += len(ids)
        self.tokens += len(ids)
        if self.n_held >= FRAME_IDS:
            self._flush()

    def close(self, names: pa.Array) -> None:
        self._flush()
        sink = pa.BufferOutputStream()
        index = pa.table({"id": names, "n": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        self._frame(struct.pack("<B", self.kind.itemsize) + sink.getvalue().to_pybytes())
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(foot)) + rows + foot)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        frames, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        head = self._frame(frames - 1)
        self.kind = np.dtype("<u2" if head[0] == 2 else "<u4")
        self.index = pa.ipc.open_stream(head[1:]).read_all()
        self.starts = np.concatenate([[0], np.cumsum(self.index["n"].to_numpy())])
        self.firsts = np.concatenate([[0], np.cumsum(self.table[:-1, 1])]) // self.kind.itemsize
        self._last = (-1, b"")

    def _frame(self, i: int) -> bytes:
        self.source.seek(int(self.offsets[i]))
        data = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
        if _checksum(data) != self.table[i, 2]:
            raise ValueError(f"frame {i} fails its checksum")
        return data

    def ids(self, row: int) -> np.ndarray:
        """Token ids of the document at `row` of the index."""
        a, b = int(self.starts[row]), int(self.starts[row + 1])
        if a == b:
            return np.empty(0, self.kind)
        lo, hi = int(np.searchsorted(self.firsts, a, "right")) - 1, int(np.searchsorted(self.firsts, b, "left"))
        parts = []
        for i in range(lo, hi):
            if self._last[0] != i:
                self._last = (i, self._frame(i))
            parts.append(np.frombuffer(self._last[1], self.kind))
        whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
        base = int(self.firsts[lo])
        return whole[a - base : b - base]


#: Between characters that are no white space, a space or a line break always begins a token of the byte-level pattern,
#: so what stands between two of them is encoded alike wherever it occurs. A unit gets back the space before it, unless
#: it starts with a line break or with one of two bytes that no text holds: the first unit of a text, a text as a whole.
FIRST, WHOLE = b"\xff", b"\xfe"
_RARE_SPACE = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_DOUBLE = (b"  ", b" \n", b"\n ", b"\n\n")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Punctuation after a letter or digit begins a token, so it is split off before units are encoded.
_TAIL = string.punctuation.encode()
_TAILS = frozenset(_TAIL[i : i + 1] for i in range(len(_TAIL)))


def _even(text: bytes) -> bool:
    """Whether all white space is single spaces and line breaks inside the text; other texts are cut more carefully."""
    if text[:1] in b" \n" or text[-1:] in b" \n" or len(text.translate(None, _RARE_SPACE)) < len(text):
        return False
    return not any(x in text for x in _DOUBLE) and (text.isascii() or not any(x in text for x in _WIDE_SPACE))


def units(text: bytes, special: tuple[bytes, ...]) -> list[bytes]:
    """Parts of a text that can be encoded each for itself."""
    if not text:
        return []
    if any(x in text for x in special):
        return [WHOLE + text]
    if _even(text):
        parts = text.replace(b"\n", b" \n").split(b" ")
    else:
        parts = [p.encode("utf-8") for p in _CUT.split(text.decode("utf-8"))]
        parts[1:] = [WHOLE + b" " + p for p in parts[1:]]
    parts[0] = FIRST + parts[0]
    return parts


def stem(unit: bytes) -> bytes:
    """The unit without the punctuation that follows its last letter or digit."""
    if unit[-1:] not in _TAILS or not unit[:1].isalnum():
        return unit
    short = unit.rstrip(_TAIL)
    return short if short[-1:].isalnum() else unit


def spelling(unit: bytes) -> str:
    return (unit[1:] if unit[0] in (FIRST[0], WHOLE[0]) else unit if unit[:1] == b"\n" else b" " + unit).decode("utf-8")


class Encoder:
    """Ids of distinct units with the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())

    def encode(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and all ids one after the other."""
        number: dict[str, int] = defaultdict(count().__next__)
        parts = np.full((len(own), 2), -1, np.int64)  # of each unit: its stem and, where there is any, the punctuation after it
        for i, unit in enumerate(own):
            short = stem(unit)
            parts[i, 0] = number[spelling(short)]
            if len(short) < len(unit):
                parts[i, 1] = number[unit[len(short):].decode()]
        texts, lengths, flat = list(number), [], []
        for i in range(0, len(texts), 20_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
            lengths.extend(map(len, ids))
            flat.append(np.fromiter(chain.from_iterable(ids), "<u4"))
        lengths = np.array([*lengths, 0], np.int64)  # the last one stands for no punctuation
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[parts]
        return sizes.sum(axis=1), gathered(np.concatenate([*flat, np.empty(0, "<u4")]), starts[parts].ravel(), sizes.ravel())


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(path)


def _number_units(texts: list[bytes], special: tuple[bytes, ...], buckets: int) -> tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]:
    """The distinct units of a chunk packed by bucket, the units of its texts by number, and how many each text has.

    Units are numbered in the order of the packed buckets, so answers that come back in that order need no lookup.
    """
    known: dict[bytes, int] = defaultdict(count().__next__)
    documents = []
    for text in texts:
        own = units(text, special)
        documents.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
    names = list(known)
    hashes = np.fromiter((xxhash.xxh64_intdigest(stem(u)) for u in names), np.uint64, len(names))
    sent, number, n = [], np.zeros(len(names), np.int32), 0
    for bucket, at in by_bucket(hashes, buckets):
        sent.append((bucket, pack_strings([names[i] for i in at])))
        number[at] = np.arange(n, n + len(at))
        n += len(at)
    return sent, number[np.concatenate([*documents, np.empty(0, np.int32)])], np.fromiter(map(len, documents), np.int64, len(documents))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, width: int = 2
) -> DataFrame:
    """Encode every text, in ascending order of the id, into files of the shared folder; return their manifest.

    Null texts are empty, null ids come first, rows of one id are ordered by their text. Distinct units of all texts are
    encoded once, in hash buckets, and return to the chunks of documents. Each chunk becomes a file under a name of its
    own, and only files of the manifest are ever read, so a repeated task leaves no trace. An id beyond the width fails: 2 bytes
    hold vocabularies up to 65,536. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    batches_of(spark)
    folder = new_path(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total_bytes(docs, text_col)[1] // BUCKET_BYTES + 1)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keys = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "_text")
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("sizes", T.BinaryType()),
        T.StructField("sequence", T.BinaryType()),
        T.StructField("sent", T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("units", T.BinaryType())]))),
    ])
    arrow = arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, special = TaskContext.get().partitionId(), encoder_of(tokenizer).special
        for k, held in enumerate(grouped(batches, "_text", CHUNK_BYTES)):
            sent, sequence, sizes = _number_units(utf8(held["_text"].combine_chunks()), special, buckets)
            ids = pa.ListArray.from_arrays(pa.array([0, held.num_rows], pa.int32()), held["_id"].combine_chunks())
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 32 | k], pa.int64()), ids.cast(arrow.field("ids").type), pa.array([packed(sizes.tobytes())], pa.binary()),
                pa.array([packed(sequence.tobytes(), 1)], pa.binary()), pa.array([[{"bucket": x, "units": y} for x, y in sent]], arrow.field("sent").type),
            ], schema=arrow)

    chunks = store_bucketed(placed.mapInArrow(number, schema), "chunk").df
    batches_of(spark, CHUNKS_PER_BATCH)

    def encode(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = defaultdict(count().__next__)
        places = []
        for data in group["units"].to_pylist():
            own = unpack_strings(data)
            places.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        sizes, ids = encoder_of(tokenizer).encode(list(known))
        starts = np.cumsum(sizes) - sizes
        out = [(packed(sizes[p].astype("<u4").tobytes()), packed(gathered(ids, starts[p], sizes[p]).tobytes())) for p in places]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "lengths": pa.array([a for a, _ in out], pa.binary()),
                         "ids": pa.array([b for _, b in out], pa.binary())})

    sent = chunks.select("chunk", F.inline("sent"))
    answers = store(sent.groupBy("bucket").applyInArrow(encode, "chunk bigint, bucket int, lengths binary, ids binary")).df

    def write(row: dict) -> Iterator[pa.RecordBatch]:
        back = sorted(row["answers"] or (), key=lambda x: x["bucket"])
        lengths = np.concatenate([*(np.frombuffer(unpacked(x["lengths"]), "<u4") for x in back), np.empty(0, "<u4")]).astype(np.int64)
        ids = np.concatenate([*(np.frombuffer(unpacked(x["ids"]), "<u4") for x in back), np.array([end_id or 0], "<u4")])
        starts = np.cumsum(lengths) - lengths
        sequence, sizes = np.frombuffer(unpacked(row["sequence"]), np.int32), np.frombuffer(unpacked(row["sizes"]), np.int64)
        limits = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        fs, root = _filesystem(folder)
        fs.create_dir(root)
        name = f"chunk-{row['chunk']:020d}-{uuid.uuid4().hex}.zst"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            writer = FrameWriter(out, width)
            for document in (sequence[a:b] for a, b in zip(limits, limits[1:])):
                own_ids = gathered(ids, starts[document], lengths[document])
                writer.add(own_ids if end_id is None else np.append(own_ids, ids[-1]))
            writer.close(row["ids"])
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([f"{folder}/{name}"]), "part": pa.array([row["chunk"]], pa.int64()),
            "rows": pa.array([len(writer.lengths)], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64()),
        })

    return store(each_chunk(with_answers(chunks.drop("sent"), answers=answers), write, FILE_SCHEMA)).df


def read_token_files(manifest: DataFrame, id_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """Documents of the files: id, start (ids of all documents before it), n_tokens, crc32, and the ids if asked.

    The running start has one row per file. Every file is read by one task, frame by frame.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = files.repartition("file")
    fields = [T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                fs, path = _filesystem(file)
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    names = reader.index["id"].combine_chunks()
                    lengths = reader.index["n"].to_numpy()
                    for a in range(0, len(lengths), 1000):
                        b = min(a + 1000, len(lengths))
                        ids = [reader.ids(i) for i in range(a, b)]
                        columns = [
                            names[a:b].cast(arrow.field("id").type), pa.array(base + reader.starts[a:b], pa.int64()),
                            pa.array(lengths[a:b], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ]
                        columns += [pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))] if with_ids else []
                        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spread.mapInArrow(read, schema)
