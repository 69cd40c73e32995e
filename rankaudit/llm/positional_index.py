"""Benchmark decontamination over a distributed positional inverted index.

Whole documents are gathered into segments; a segment row stores the sorted positions of each of its terms.
Test items are searched per segment: of each window the terms are taken from the rarest one on, by counts over
the whole index, and their position lists, shifted by the place of the term, are intersected. A segment holds
all postings of its documents, so a frequent term is spread over all segments and nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, arrow_schema, batches_of, grouped, store, utf8

#: Letters A-Z become a-z; all ASCII characters but digits and letters separate words.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(x if (x := bytes([i]).lower()[0]) in _KEPT else 32 for i in range(256))

WINDOW = 10
#: Words by which a term may lie off its place in a near match.
SLOP = 2
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i4").tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i4")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Stored:
    """Segments of about `segment_bytes` of text: ids and starts of their documents, terms, counts and position gaps.

    Null texts have no words and stay in the index as documents without postings.
    """
    batches_of(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("starts", T.BinaryType()),
        T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("gaps", T.BinaryType()),
    ])
    arrow = arrow_schema(schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(grouped(batches, "_text", segment_bytes)):
            known: dict[bytes, int] = defaultdict(count().__next__)
            at, starts, found = 0, [0], []
            for text in utf8(chunk["_text"].combine_chunks()):
                own = words(text)
                found.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                at += len(own)
                starts.append(at)
            terms = np.concatenate(found)
            places = np.argsort(terms, kind="stable").astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, chunk.num_rows], pa.int32()), chunk["_id"].combine_chunks()).cast(arrow.field("ids").type),
                pa.array([_pack(np.array(starts))], pa.binary()),
                pa.array([zstandard.ZstdCompressor(level=1).compress(b" ".join(known))], pa.binary()),
                pa.array([_pack(np.bincount(terms, minlength=len(known)))], pa.binary()),
                pa.array([_pack(np.diff(places, prepend=np.int32(0)))], pa.binary()),
            ], schema=arrow)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return store(rows.mapInArrow(segments, schema))


class Segment:
    """One segment, opened for the terms of a test set."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        self.ids, self.starts = row["ids"], _unpack(row["starts"])
        self.n = len(self.starts) - 1
        terms = zstandard.ZstdDecompressor().decompress(row["terms"]).split()
        counts = _unpack(row["counts"])
        ends = np.cumsum(counts)
        self.places = np.cumsum(_unpack(row["gaps"]), dtype=np.int32)
        self.at = {}
        for i, term in enumerate(terms):
            if (k := wanted.get(term)) is not None:
                self.at[k] = (int(ends[i] - counts[i]), int(ends[i]))

    def postings(self, term: int) -> np.ndarray:
        a, b = self.at.get(term, (0, 0))
        return self.places[a:b]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class TestSet:
    """Distinct windows of a block of test items, their items, and the terms numbered."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int):
        self.terms: dict[bytes, int] = defaultdict(count().__next__)
        self.windows: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.items = []
        for name, text in items:
            own = [self.terms[w] for w in words(text or b"")]
            if not own:
                continue
            for i in range(max(1, len(own) - window + 1)):
                owners = self.windows[tuple(own[i : i + window])]
                if not owners or owners[-1] != len(self.items):
                    owners.append(len(self.items))
            self.items.append(name)
        self.terms = dict(self.terms)
        self.rarest: list[list[int]] = []

    def order(self, frequency: dict[bytes, int]) -> None:
        """Places of each window from its rarest term on."""
        of = np.array([frequency.get(t, 0) for t in self.terms], np.int64)
        self.rarest = [sorted(range(len(w)), key=lambda k, w=w: (of[w[k]], k)) for w in self.windows]


def phrase_starts(segment: Segment, window: tuple[int, ...], order: list[int]) -> np.ndarray:
    """Positions at which the window occurs inside one document."""
    if any(t not in segment.at for t in window):
        return np.empty(0, np.int32)
    starts = segment.postings(window[order[0]]) - order[0]
    for k in order[1:]:
        if not len(starts):
            return starts
        lists = segment.postings(window[k])
        at = np.searchsorted(lists, starts + k)
        starts = starts[(at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == starts + k)]
    starts = starts[starts >= 0]
    return starts[segment.document(starts) == segment.document(starts + len(window) - 1)]


def near_starts(segment: Segment, window: tuple[int, ...], order: list[int], slop: int) -> np.ndarray:
    """Positions of the rarest term with every other term no more than `slop` away from its place, in one document."""
    if any(t not in segment.at for t in window):
        return np.empty(0, np.int32)
    anchors, first = segment.postings(window[order[0]]), order[0]
    for k in order[1:]:
        lists, want = segment.postings(window[k]), anchors + (k - first)
        own = segment.document(anchors)
        low = np.maximum(want - slop, segment.starts[own])
        high = np.minimum(want + slop, segment.starts[own + 1] - 1)
        anchors = anchors[np.searchsorted(lists, high, "right") > np.searchsorted(lists, low, "left")]
    return anchors


def _frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole index of the terms of a test set: at most one row per term goes to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for packed, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term, n in zip(zstandard.ZstdDecompressor().decompress(packed).split(), _unpack(counts).tolist()):
                    if term in terms:
                        total[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(local, "term binary, n bigint")
    return {bytes(r["term"]): r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The test items in blocks of bounded size, which are read one after the other."""
    rows = items.select(F.col(id_col), F.encode(F.col(text_col), "UTF-8"))
    block, size = [], 0
    for name, text in rows.toLocalIterator():
        block.append((name, bytes(text) if text is not None else None))
        size += len(text or b"") + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def search(index: DataFrame, test_set: TestSet, item_type: T.DataType, slop: int | None = None) -> DataFrame:
    """One row per document of the index: n_words, matches (start, length, items) and n_hit of this test set.

    Without `slop`, exact phrases; with it, also near matches: the rarest term of a window with all others within
    `slop` words of their place, in any order (`kind` = 'near', start at the rarest term, length 1, never a hit).
    """
    id_type = index.schema["ids"].dataType.elementType
    match = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
                          T.StructField("kind", T.StringType()), T.StructField("items", T.ArrayType(item_type))])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("covered", T.BinaryType()),
                           T.StructField("matches", T.ArrayType(match))])
    arrow = arrow_schema(schema)
    windows = list(zip(test_set.windows, test_set.windows.values(), test_set.rarest))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
                row["ids"] = batch.column("ids")[i].values
                segment = Segment(row, test_set.terms)
                matches, covered = [[] for _ in range(segment.n)], {}
                for window, owners, order in windows:
                    names = None
                    found = [("phrase", len(window), phrase_starts(segment, window, order))]
                    if slop is not None:
                        found.append(("near", 1, near_starts(segment, window, order, slop)))
                    for kind, length, starts in found:
                        for d, p in zip(segment.document(starts).tolist(), starts.tolist()) if len(starts) else ():
                            names = names or [test_set.items[x] for x in owners]
                            at = p - int(segment.starts[d])
                            matches[d].append({"start": at, "length": length, "kind": kind, "items": names})
                            if kind == "phrase":
                                covered.setdefault(d, []).append((at, length))
                sizes = np.diff(segment.starts)
                masks, hits = [None] * segment.n, np.zeros(segment.n, np.int64)
                for d, spans in covered.items():
                    mask = np.zeros(sizes[d], bool)
                    for at, length in spans:
                        mask[at : at + length] = True
                    masks[d], hits[d] = np.packbits(mask).tobytes(), mask.sum()
                yield pa.RecordBatch.from_arrays([
                    segment.ids.cast(arrow.field("id").type), pa.repeat(pa.scalar(row["segment"], pa.int64()), segment.n),
                    pa.array(np.arange(segment.n), pa.int32()), pa.array(sizes, pa.int64()), pa.array(hits), pa.array(masks, pa.binary()),
                    pa.array(matches, arrow.field("matches").type),
                ], schema=arrow)

    return index.mapInArrow(find, schema)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside an occurring window), item_ids (sorted as text), matches.

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null texts and items
    have no words. Items are taken in blocks of at most `block_bytes`, each searched in the whole index, so what
    goes to a task is bounded whatever the test set; several blocks are merged per document. An empty index gives
    no rows, an empty test set rows without hits. Repeated ids stay separate rows.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    index = build_index(docs, id_col, text_col).df
    index.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    found = None
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        test_set = TestSet(block, window)
        test_set.order(_frequencies(index, set(test_set.terms)))
        own = search(index, test_set, items.schema[item_col].dataType, slop)
        found = own if found is None else found.unionByName(own)
        several = found is not own
    if several:
        covered = F.udf(_count_covered, "bigint")
        found = found.groupBy("segment", "row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_list("covered").alias("covered"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        ).withColumn("n_hit", covered("covered"))
    phrases = F.filter("matches", lambda m: m["kind"] == "phrase")
    names = F.array_distinct(F.flatten(F.transform(phrases, lambda m: m["items"])))
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit",
        F.array_sort(F.transform(names, lambda x: x.cast("string"))).alias("item_ids"), "matches",
    )


def _count_covered(masks: list[bytes]) -> int:
    """Words covered in any of the masks, which are as long as the document."""
    arrays = [np.frombuffer(bytes(m), np.uint8) for m in masks]
    return int(np.bitwise_count(np.bitwise_or.reduce(arrays)).sum()) if arrays else 0
