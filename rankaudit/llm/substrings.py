"""Removal of word sequences that occur more than once, with difference-cover anchors.

Only windows that start at cover positions modulo a period are hashed at first. Whatever the places of two equal
windows of full length, some shift below the period puts both on the cover, so they share an aligned anchor. Around
shared anchors the full windows are hashed and compared over the whole corpus; recurring ones extend to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_bucket, each_chunk, texts_of, with_answers, write_chunks
from .common import arrow_schema, mix64, store, total_bytes

WINDOW = 35
#: Perfect difference sets; every difference modulo the period occurs in its set.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
#: Values of one hash bucket, about.
BUCKET_VALUES = 1 << 20
_STEP, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SENT = "bucket int, chunk bigint, high binary, low binary"


def period_for(window: int) -> int:
    """The longest period that leaves anchors of two fifths of the window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)


def window_hashes(words: np.ndarray, window: int, step: int) -> np.ndarray:
    """Hash of the `window` values from each place on, put together from windows of doubling length."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, done, part, size, power = np.zeros(n, np.uint64), 0, words, 1, step
    while True:
        if window & size:
            total = total * np.uint64(power) + part[done : done + n]
            done += size
        if size * 2 > window:
            return mix64(total)
        part = part[:-size] * np.uint64(power) + part[size:]
        power, size = power * power % 2**64, size * 2


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Chunk:
    """Words of the documents of a chunk, hashed, one after the other."""

    def __init__(self, row: dict, window: int, buckets: int):
        self.row, self.window, self.buckets = row, window, buckets
        self.words = [t.split() for t in texts_of(row)]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        known = _WordHashes()
        self.hashes = np.fromiter((known[w] for own in self.words for w in own), np.uint64, int(sizes.sum()))
        self.place = np.arange(len(self.hashes)) - np.repeat(self.starts, sizes)
        self.left = np.repeat(sizes, sizes) - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions, and the hash of the anchor at each."""
        period = period_for(self.window)
        size = self.window - period + 1
        hashed = window_hashes(self.hashes, size, _STEP)
        cover = np.isin(np.arange(period), COVERS[period])
        at = np.flatnonzero(cover[self.place[: len(hashed)] % period] & (self.left[: len(hashed)] >= size))
        return at, hashed[at]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of full windows with a shared anchor at one of the first `period` places."""
        if len(self.hashes) < self.window:
            return np.empty(0, np.int64)
        edge = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(edge, np.maximum(shared - period_for(self.window) + 1, 0), 1)
        np.add.at(edge, shared + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.window))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the full window at each place."""
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return window_hashes(self.hashes, self.window, _STEP)[at], window_hashes(mix64(self.hashes), self.window, _OTHER)[at]

    def send(self, high: np.ndarray, low: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The distinct values of the chunk, sorted and packed by bucket; the upper half of an anchor names the bucket only."""
        rows = [[], [], [], []]
        for bucket, at in by_bucket(high, self.buckets):
            rows[0].append(bucket)
            rows[1].append(self.row["chunk"])
            rows[2].append((high[at] if low is not None else high[at].astype("<u4")).tobytes())
            rows[3].append(low[at].astype("<u4").tobytes() if low is not None else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
            ["bucket", "chunk", "high", "low"],
        )

    def answered(self, high: np.ndarray, answers: list[dict] | None) -> np.ndarray:
        """For the distinct values that `send` took, whether another chunk has them too."""
        found = np.zeros(len(high), bool)
        masks = {a["bucket"]: a["mask"] for a in answers or ()}
        for bucket, at in by_bucket(high, self.buckets):
            if bucket in masks:
                found[at] = np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=len(at)).astype(bool)
        return found

    def shared_anchors(self, answers: list[dict] | None) -> np.ndarray:
        at, hashed = self.anchors()
        values, where, times = np.unique(hashed, return_inverse=True, return_counts=True)
        return at[(self.answered(values, answers) | (times > 1))[where]]

    def repeated(self, at: np.ndarray, answers: list[dict] | None) -> np.ndarray:
        """Of the candidate windows, those that occur anywhere else."""
        values, where, times = self.distinct(at)
        return at[(self.answered(values[0], answers) | (times > 1))[where]]

    def distinct(self, at: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        high, low = self.windows(at)
        low = low.astype("<u4")
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        number = np.cumsum(new) - 1
        where = np.empty(len(order), np.int64)
        where[order] = number
        first = order[new]
        return (high[first], low[first]), where, np.bincount(where, minlength=len(first))


def _shared(group: pa.Table) -> pa.Table:
    """For every chunk of a bucket, a bit for each of its values: held by another chunk too."""
    highs = group["high"].to_pylist()
    wide = any(x is not None for x in group["low"].to_pylist())
    parts = [np.frombuffer(x, "<u8" if wide else "<u4") for x in highs]
    lows = [np.frombuffer(x, "<u4") for x in group["low"].to_pylist()] if wide else [np.zeros(len(p), np.uint32) for p in parts]
    # A chunk may hold two values alike in what is sent; they are one here.
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    high, low = np.concatenate(parts), np.concatenate(lows)
    order = np.lexsort((owner, low, high))
    a, b, o = high[order], low[order], owner[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    length = np.diff(np.append(start, len(a)))
    several = np.repeat(o[start] != o[start + length - 1], length)
    held = np.empty(len(a), bool)
    held[order] = several
    ends = np.cumsum([len(p) for p in parts])
    masks = [np.packbits(held[e - len(p) : e]).tobytes() for e, p in zip(ends, parts)]
    keep = [i for i, m in enumerate(masks) if any(m)]
    return pa.table({
        "chunk": group["chunk"].take(pa.array(keep, pa.int64())), "bucket": group["bucket"].take(pa.array(keep, pa.int64())),
        "mask": pa.array([masks[i] for i in keep], pa.binary()),
    })


ANSWER = "chunk bigint, bucket int, mask binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans removed (word places, end exclusive) and the kept text.

    A word goes when a window of `window` words over it occurs anywhere else, in the same document included; windows
    are judged on the input. Words are what ASCII white space separates; kept words are joined by one space. Null
    texts have no words. Repeated rows count as separate documents; an empty table gives no rows.
    """
    size = total_bytes(docs, text_col)[1]
    period = period_for(window)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size * len(COVERS[period]) // period // 6 // BUCKET_VALUES + 1)
    chunks = write_chunks(docs, id_col, text_col).df

    def anchors(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(row, window, buckets)
        yield from chunk.send(np.unique(chunk.anchors()[1]), None)

    def windows(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(row, window, buckets)
        yield from chunk.send(*chunk.distinct(chunk.candidates(chunk.shared_anchors(row["anchors"])))[0])

    sent = each_chunk(chunks, anchors, SENT)
    shared = store(sent.groupBy("bucket").applyInArrow(_shared, ANSWER)).df
    sent = each_chunk(with_answers(chunks, anchors=shared), windows, SENT)
    repeated = store(sent.groupBy("bucket").applyInArrow(_shared, ANSWER)).df

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("kept_text", T.StringType()),
    ])
    arrow = arrow_schema(schema)

    def removed(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(row, window, buckets)
        at = chunk.repeated(chunk.candidates(chunk.shared_anchors(row["anchors"])), row["windows"])
        edge = np.zeros(len(chunk.hashes) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for a in range(0, len(chunk.words), 500):
            spans, kept, count, some = [], [], [], chunk.words[a : a + 500]
            for own, start, end in zip(some, chunk.starts[a : a + 500].tolist(), chunk.ends[a : a + 500].tolist()):
                mask = gone[start:end]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])])
                count.append(int(mask.sum()))
                kept.append(b" ".join([w for w, out in zip(own, mask.tolist()) if not out] if count[-1] else own))
            yield pa.RecordBatch.from_arrays([
                row["ids"][a : a + 500].cast(arrow.field(id_col).type), pa.array([len(w) for w in some], pa.int64()), pa.array(count, pa.int64()),
                pa.array(spans, arrow.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string()),
            ], schema=arrow)

    return each_chunk(with_answers(chunks, anchors=shared, windows=repeated), removed, schema)
