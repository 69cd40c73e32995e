"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut where no piece of the vocabulary reaches across, which leaves short words that can be segmented each for
itself. Distinct words explode into their substrings of bounded length, an equi-join with the piece table keeps the
edges of the lattice, edges are grouped by word, and a fold over them finds the path: for unigram models the best one
(Viterbi), for byte-pair models, whose scores are merge ranks and no log probabilities, the one that their merges give.
Ids return to the chunks of documents packed by hash bucket.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CHUNKS_PER_BATCH, by_bucket, each_chunk, gathered, pack_strings, packed, texts_of, unpack_strings, unpacked, with_answers, write_chunks
from .common import arrow_schema, batches_of, give_back, shuffles_dropped, store, total_bytes

MARK = "▁"
#: Text for each bucket of words.
BUCKET_BYTES = 4 << 20
#: Words whose edges a task groups by hashing; the rest of its words is sorted, and spilled where memory is short.
HASHED_WORDS = 20_000
#: What a character without a piece costs beyond the lowest score, before it is spelt in bytes.
UNKNOWN_PENALTY = 10.0
#: Parts between spaces that a chunk cuts into words at a time.
PARTS = 20_000
#: Longer words are folded with a heap in Python, as column folds grow with the square of the length.
LONG = 200


@dataclass
class Pieces:
    """The vocabulary: ordinary pieces with id and score, the ids of the 256 bytes, whether it is a byte-pair one."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes: list[int]
    merges: bool = False

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def by_place(self) -> np.ndarray:
        """Ids from the lowest score up; of equal scores the higher id first."""
        return np.array(sorted(self.ids.values(), key=self._order), np.int64)

    @cached_property
    def ids_of_places(self) -> np.ndarray:
        """The id of every place from 1 on."""
        return np.concatenate([[0], self.by_place])

    def _order(self, number: int) -> tuple[float, int]:
        return self._scores_by_id[number], -number

    @cached_property
    def _scores_by_id(self) -> dict[int, float]:
        return {i: self.scores[p] for p, i in self.ids.items()}

    @property
    def unknown_score(self) -> float:
        return min(self.scores.values()) - UNKNOWN_PENALTY


@cache
def read_pieces(path: str) -> Pieces:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, spelt = {}, {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelt[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], scores[piece] = i, model.get_score(i)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    return Pieces(ids, scores, [spelt[b] for b in range(256)], proto.trainer_spec.model_type == proto.trainer_spec.BPE)


class Cutter:
    """Cuts texts between two characters that stand side by side in no piece."""

    def __init__(self, pieces: Pieces):
        pairs = {p[i : i + 2] for p in pieces.ids for i in range(len(p) - 1)}
        letters = sorted({c for pair in pairs for c in pair})
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joined[self.number[ord(a)], self.number[ord(b)]] = True

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all texts one after the other, and how many each text has."""
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        numbers = self.number[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
        cut = np.empty(len(whole) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = ~self.joined[numbers[:-1], numbers[1:]]
        ends = np.cumsum([len(t) for t in texts])
        cut[ends] = True
        before = np.cumsum(cut[:-1])
        sizes = np.diff(np.concatenate([[0], np.where(ends > 0, before[np.maximum(ends - 1, 0)], 0)]))
        at = np.flatnonzero(cut).tolist()
        return [whole[a:b] for a, b in zip(at, at[1:])], sizes


@cache
def cutter_of(path: str) -> Cutter:
    return Cutter(read_pieces(path))


_SPACED = re.compile(rb" *[^ ]+| +$")


def spaced(text: bytes) -> list[bytes]:
    """Parts of a text that each follow a space, the one that the model puts in front included; further spaces stay."""
    if not text:
        return []
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return [p[1:] for p in _SPACED.findall(b" " + text)]
    return text.split(b" ")


class _Words:
    """Texts of a chunk by numbers: parts between spaces in the documents, words of the lattice in the distinct parts."""

    def __init__(self, row: dict, path: str):
        parts: dict[bytes, int] = defaultdict(count().__next__)
        documents = []
        for text in texts_of(row):
            own = spaced(text)
            documents.append(np.fromiter(map(parts.__getitem__, own), np.int32, len(own)))
        self.sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        self.sequence = np.concatenate([*documents, np.empty(0, np.int32)])
        listed, cutter, known = list(parts), cutter_of(path), defaultdict(count().__next__)
        numbers, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for a in range(0, len(listed), PARTS):
            cut, some = cutter.cut([MARK + p.decode("utf-8", "surrogatepass").replace(" ", MARK) for p in listed[a : a + PARTS]])
            numbers.append(np.fromiter(map(known.__getitem__, cut), np.int32, len(cut)))
            sizes.append(some)
        self.part_words, self.part_sizes = np.concatenate(numbers), np.concatenate(sizes)
        self.words = [w.encode("utf-8", "surrogatepass") for w in known]
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))


#: Bits of an edge that hold the place of its piece; the bits above hold its start and end.
PLACE_BITS = 20


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score, place): as large as the vocabulary, whatever the corpus. Places count from 1 by rising score."""
    if len(pieces.ids) >> PLACE_BITS:
        raise ValueError(f"more than {1 << PLACE_BITS} pieces")
    places = {int(i): k for k, i in enumerate(pieces.by_place, 1)}
    rows = [(p, i, float(pieces.scores[p]), places[i]) for p, i in pieces.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double, place bigint")


def best_path(edges: Column, length: Column) -> Column:
    """Ids along the best path through the edges (end, start, id, score) of one word.

    The fold keeps the best edge into every place up to the present end: highest score, then longest piece, then
    highest id. A second fold walks back from the last place.
    """
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(-1).alias("id")))
    into = lambda best, end: F.array_max(F.transform(
        F.filter(edges, lambda x: x["end"] == end),
        lambda x: F.struct((F.get(best, x["start"])["score"] + x["score"]).alias("score"), (-x["start"]).alias("back"), x["id"].alias("id")),
    ))
    best = F.aggregate(F.sequence(F.lit(1), length), first, lambda done, end: F.concat(done, F.array(into(done, end))))
    start = F.struct(length.alias("at"), F.array().cast("array<int>").alias("ids"))
    step = lambda best: F.aggregate(
        F.sequence(F.lit(1), length), start,
        lambda s, _: F.when(s["at"] > 0, F.struct(
            (-F.get(best, s["at"])["back"]).alias("at"), F.concat(F.array(F.get(best, s["at"])["id"]), s["ids"]).alias("ids")
        )).otherwise(s),
        lambda s: s["ids"],
    )
    return F.get(F.transform(F.array(best), step), F.lit(0))


def edge_key(start: Column, end: Column) -> Column:
    return start * F.lit(LONG + 1) + end


def merged_path(edges: Column, length: Column, word: Column) -> Column:
    """Places of the symbols that remain when neighbours are merged, the best-scored and then leftmost pair first.

    An edge is one number: its start and end above the place of its piece, which is all that merging needs. The fold
    keeps the bounds between symbols; each step looks up the pieces over two neighbours and takes away the bound inside
    the best one. A character without a piece comes out as -1 - its code point.
    """
    low = (1 << PLACE_BITS) - 1
    table = F.map_from_arrays(F.transform(edges, lambda x: F.shiftright(x, PLACE_BITS).cast("int")), F.transform(edges, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))

    def run(known: Column) -> Column:
        piece = lambda start, end: F.try_element_at(known, edge_key(start, end))

        def merge(bounds: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.size(bounds) - 3), lambda i: F.struct(
                piece(F.get(bounds, i), F.get(bounds, i + 2)).alias("place"), (-i).alias("back")))
            taken = lambda m: F.when(m["place"].isNull(), bounds).otherwise(F.array_remove(bounds, F.get(bounds, F.lit(1) - m["back"])))
            return F.when(F.size(bounds) < 3, bounds).otherwise(F.get(F.transform(F.array(F.array_max(pairs)), taken), F.lit(0)))

        def spelled(bounds: Column) -> Column:
            symbol = lambda start, place: F.when(place > 0, place).otherwise(-1 - F.ascii(F.substring(word, start + 1, F.lit(1))))
            return F.transform(F.slice(bounds, F.lit(2), length), lambda end, i: symbol(F.get(bounds, i), piece(F.get(bounds, i), end)))

        steps = F.slice(F.sequence(F.lit(0), length), F.lit(3), length)
        kept = F.aggregate(steps, F.sequence(F.lit(0), length), lambda bounds, _: merge(bounds))
        return F.get(F.transform(F.array(kept), spelled), F.lit(0))

    return F.get(F.transform(F.array(table), run), F.lit(0))


def as_ids(pieces: Pieces, symbols: np.ndarray) -> np.ndarray:
    """Ids of what `segment` gives: they are places for byte-pair models and ids already for others."""
    if not pieces.merges:
        return symbols
    return np.where(symbols > 0, pieces.ids_of_places[np.maximum(symbols, 0)], symbols)


def fold_long(edges: list, length: int, merges: bool) -> list[int]:
    """The same paths for one long word, with a heap of merges or a table of best paths."""
    if not merges:
        into: list[tuple] = [(0.0, 0, -1)] + [None] * length
        for end, start, number, score in sorted(edges, key=lambda x: (x[0], x[1])):
            into[end] = max(filter(None, (into[end], (into[start][0] + score, -start, number))))
        ids, at = [], length
        while at:
            ids.append(into[at][2])
            at = -into[at][1]
        return ids[::-1]
    known = {(start, end): (score, number) for end, start, number, score in edges}
    after, before = {i: i + 1 for i in range(length)}, {i + 1: i for i in range(length)}
    heap = []

    def offer(start: int) -> None:
        middle = after.get(start)
        if middle is not None and middle < length and (pair := known.get((start, after[middle]))):
            heapq.heappush(heap, (-pair[0], start, middle, after[middle]))

    for i in range(length):
        offer(i)
    while heap:
        _, start, middle, end = heapq.heappop(heap)
        if after.get(start) == middle and after.get(middle) == end:
            del after[middle], before[middle]
            after[start], before[end] = end, start
            offer(start)
            if start in before:
                offer(before[start])
    ids, at = [], 0
    while at < length:
        ids.append(known[at, after[at]][1])
        at = after[at]
    return ids


def segment(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(bucket, word, ids) for distinct rows (bucket, word); `as_ids` makes ids of byte-pair symbols.

    A character without a piece has -1 - its code point. The piece table is broadcast: its size is the vocabulary's.
    """
    table, merges = piece_table(words.sparkSession, pieces), pieces.merges
    end = F.col("start") + F.col("width")
    packed_edge = F.shiftleft(edge_key(F.col("start"), end).cast("bigint"), PLACE_BITS).bitwiseOR(F.coalesce("place", F.lit(0).cast("bigint")))
    full_edge = F.struct(
        end.alias("end"), "start", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
    )

    def lattices(some: DataFrame, edge: Column) -> DataFrame:
        spots = some.withColumn("length", F.length("word")).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
        widths = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("length") - F.col("start")))
        spans = spots.withColumn("width", F.explode(widths))
        spans = spans.withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("width")))
        found = spans.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("width") == 1))
        return found.groupBy("bucket", "word").agg(F.collect_list(edge).alias("edges"))

    places = {int(i): k for k, i in enumerate(pieces.by_place, 1)} if merges else {}

    @F.udf("array<int>")
    def fold(edges, length):
        found = fold_long([tuple(e) for e in edges], length, merges)
        return [places.get(i, i) for i in found] if merges else found

    size = F.length("word")
    short = lattices(words.where(size <= LONG), packed_edge if merges else full_edge)
    path = merged_path(F.col("edges"), size, F.col("word")) if merges else best_path(F.col("edges"), size)
    long = lattices(words.where(size > LONG), full_edge)
    return short.select("bucket", "word", path.alias("ids")).unionByName(long.select("bucket", "word", fold("edges", size).alias("ids")))


@contextmanager
def _hash_aggregation(spark: SparkSession):
    """Group edges by hashing for so many words of a task as surely fit in memory."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(HASHED_WORDS))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """One row per row of `docs`: id and the ids of the best segmentation of its text; null and empty texts have none.

    `decoded` names a further column with the text that the ids spell, as `decode` gives it, made in the task that has the ids.

    For unigram models the best segmentation has the highest sum of scores; for byte-pair models it is what the merges
    leave, as their scores only rank merges. Characters without a piece are spelt in bytes. Words of any length are segmented whole; an empty table gives no rows, repeated rows stay.
    """
    spark, pieces = docs.sparkSession, read_pieces(model_path)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total_bytes(docs, text_col)[1] // BUCKET_BYTES + 1)
    chunks = write_chunks(docs, id_col, text_col).df

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        own = _Words(row, model_path)
        sent = [(b, row["chunk"], pack_strings([own.words[i] for i in at])) for b, at in by_bucket(own.hashes, buckets)]
        columns = list(zip(*sent)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "words"]
        )

    def spread(group: pa.Table) -> pa.Table:
        words = sorted({w for data in group["words"].to_pylist() for w in unpack_strings(data)})
        found = pa.table({"bucket": pa.repeat(group["bucket"][0], len(words)), "word": pa.array(words, pa.binary()).cast(pa.string())})
        del words
        give_back()
        return found

    sent = each_chunk(chunks, send, "bucket int, chunk bigint, words binary").repartition(buckets, "bucket")
    distinct = sent.groupBy("bucket").applyInArrow(spread, "bucket int, word string")
    segmented = segment(distinct.repartition(buckets, "bucket"), pieces).select(F.col("bucket").alias("_bucket"), "word", "ids")

    def back(chunk_words: pa.Table, ids: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(ids["word"].cast(pa.binary()).to_pylist())}
        listed = ids["ids"].combine_chunks()
        flat, starts = listed.flatten().to_numpy(), listed.offsets.to_numpy()
        starts = starts - starts[0]
        out = []
        for data in chunk_words["words"].to_pylist():
            words = unpack_strings(data)
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            n = starts[at + 1] - starts[at]
            out.append((packed(n.astype("<u4").tobytes()), packed(as_ids(pieces, gathered(flat, starts[at], n)).astype("<i4").tobytes())))
        del place, listed, flat, starts
        give_back()
        return pa.table({"chunk": chunk_words["chunk"], "bucket": chunk_words["bucket"], "lengths": pa.array([a for a, _ in out], pa.binary()),
                         "ids": pa.array([b for _, b in out], pa.binary())})

    batches_of(spark)  # rows are words here, not chunks
    with _hash_aggregation(spark), shuffles_dropped(spark):
        answers = store(sent.groupBy("bucket").cogroup(segmented.groupBy("_bucket")).applyInArrow(back, "chunk bigint, bucket int, lengths binary, ids binary")).df
    batches_of(spark, CHUNKS_PER_BATCH)

    text_field = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), *text_field])
    arrow, texts = arrow_schema(schema), _spelling(pieces) if decoded else None

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        own = _Words(row, model_path)
        lengths, starts, flat, total = np.zeros(len(own.words), np.int64), np.zeros(len(own.words), np.int64), [np.empty(0, "<i4")], 0
        known = {a["bucket"]: a for a in row["answers"] or ()}
        for bucket, at in by_bucket(own.hashes, buckets):
            n = np.frombuffer(unpacked(known[bucket]["lengths"]), "<u4").astype(np.int64)
            lengths[at], starts[at] = n, total + np.cumsum(n) - n
            flat.append(np.frombuffer(unpacked(known[bucket]["ids"]), "<i4"))
            total += len(flat[-1])
        words, n = own.part_words, lengths[own.part_words]
        ids = gathered(np.concatenate(flat), starts[words], n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(own.part_sizes)]
        part_starts = np.concatenate([[0], ends[:-1]])
        part_lengths, limits = ends - part_starts, np.concatenate([[0], np.cumsum(own.sizes)])
        for a in range(0, len(own.sizes), 500):
            z = min(a + 500, len(own.sizes))
            parts = own.sequence[limits[a] : limits[z]]
            picked = gathered(ids, part_starts[parts], part_lengths[parts])
            cuts = np.concatenate([[0], np.cumsum(part_lengths[parts])])[limits[a + 1 : z + 1] - limits[a]]
            if len(picked) and picked.min() < 0:
                picked, cuts = _spelt(picked, cuts, pieces)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(picked, pa.int32()))
            columns = [row["ids"][a:z].cast(arrow.field(id_col).type), listed.cast(arrow.field("ids").type)]
            yield pa.RecordBatch.from_arrays([*columns, texts(listed)] if texts else columns, schema=arrow)

    return each_chunk(with_answers(chunks, answers=answers), finish, schema)


def _spelt(ids: np.ndarray, cuts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the marked characters spelt in bytes, and the places of the cuts after that."""
    sizes = np.ones(len(ids), np.int64)
    unknown = np.flatnonzero(ids < 0)
    spelt = [[pieces.bytes[b] for b in chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass")] for i in unknown]
    sizes[unknown] = [len(s) for s in spelt]
    out = np.repeat(ids, sizes)
    ends = np.cumsum(sizes)
    for i, s in zip(unknown, spelt):
        out[ends[i] - len(s) : ends[i]] = s
    return out, np.concatenate([[0], ends])[cuts]


def _spelling(pieces: Pieces) -> Callable[[pa.Array], pa.Array]:
    """A function from lists of ids to the texts that they spell; null for null."""
    spell = {i: p.replace(MARK, " ").encode() for p, i in pieces.ids.items()} | {i: bytes([b]) for b, i in enumerate(pieces.bytes)}
    last = max(spell)
    sizes = np.array([len(spell.get(i, b"")) for i in range(last + 1)], np.int64)
    letters, starts = np.frombuffer(b"".join(spell.get(i, b"") for i in range(last + 1)), np.uint8), np.cumsum(sizes) - sizes

    def texts(listed: pa.Array) -> pa.Array:
        flat = listed.flatten().to_numpy()
        lengths = np.asarray(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False), np.int64)
        written = gathered(letters, starts[flat], sizes[flat])
        ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum(lengths)]
        begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
        raw, missing = written.tobytes(), listed.is_null().to_pylist()
        return pa.array([None if no else raw[a + 1 : b].decode("utf-8", "replace") for a, b, no in zip(begins.tolist(), ends.tolist(), missing)], pa.string())

    return texts


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`encoded` with the text that its ids spell; null ids give null.

    Inverse of `encode` for every text without the mark U+2581 itself, which decodes to a space as in the library.
    """
    texts = _spelling(read_pieces(model_path))
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != text_col], T.StructField(text_col, T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = texts(batch.column(ids_col)) if batch.num_rows else pa.array([], pa.string())
            columns = [batch.column(f.name) if f.name != text_col else decoded for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return encoded.mapInArrow(run, schema)
