"""Language-model scores from a subword lattice.

The vocabulary and its scores come from a public tokenizer. The distinct words of the training documents re-estimate the
scores by expected counts over all segmentations. A word's lattice probability is the sum over all its segmentations, by a
forward recursion in log space; pieces that start a word and pieces that continue it share one distribution, so these
probabilities sum to one over all words. Words seen in training are one more way to write themselves: their discounted
share of the corpus is added, and the discounted mass weighs the lattice. A document's probability is the product over
its words and its end. Everything is computed once per distinct word: words are gathered per chunk, exchanged by hash
bucket, and their values return to the chunks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_bucket, each_chunk, packed, texts_of, unpacked, with_answers, write_chunks
from .common import arrow_schema, mix64, store, total_bytes

START = "▁"
ROUNDS = 4
#: Taken from the count of every word seen in training, for the lattice.
DISCOUNT = 0.75
BUCKET_BYTES = 16 << 20
#: Words of one length that are taken together.
BLOCK = 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces, their natural-log scores, and the first id of the 256 single bytes that follow them."""

    pieces: list[str]
    scores: np.ndarray

    @property
    def bytes_at(self) -> int:
        return len(self.pieces)

    @property
    def size(self) -> int:
        return len(self.pieces) + 256


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model, then 256 single bytes.

    Scores of a unigram model are log probabilities. Those of a byte-pair model are ranks with a minus sign; a piece of
    rank r starts with a share of 1 / (r + 2).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    own = [i for i in own if START not in model.id_to_piece(i)[1:]]
    scores = np.array([model.get_score(i) for i in own])
    if scores.min() < -1000:
        scores = -np.log(np.clip(-scores, 0, 1e6) + 2.0)
    scores = np.concatenate([scores, np.full(256, scores.min())])
    scores -= np.log(np.exp(scores - scores.max()).sum()) + scores.max()
    return Vocabulary([model.id_to_piece(i) for i in own], scores)


class Finder:
    """Looks up the pieces that many words of one length hold, by hashes of their characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary.pieces))
        codes = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype(np.uint64) for p in vocabulary.pieces]
        keys = np.zeros(len(codes), np.uint64)
        for k in range(self.longest):
            for i, c in enumerate(codes):
                if k < len(c):
                    keys[i : i + 1] = keys[i : i + 1] * _STEP + c[k] + np.uint64(1)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        self.shift = np.uint64(64 - 18)
        slots = (mix64(self.keys) >> self.shift).astype(np.int64)
        self.first = np.full(1 << 18, -1, np.int32)
        by_slot = np.argsort(slots, kind="stable")
        self.keys, self.ids, slots = self.keys[by_slot], self.ids[by_slot], slots[by_slot]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(slots) != 0]))
        self.first[slots[starts]] = starts
        self.deepest = int(np.diff(np.append(starts, len(slots))).max())
        self.keys = np.append(self.keys, np.zeros(self.deepest, np.uint64))

    def look(self, hashed: np.ndarray) -> np.ndarray:
        """Piece of every hash, or -1."""
        at = self.first[(mix64(hashed) >> self.shift).astype(np.int64)]
        found = np.full(len(hashed), -1, np.int32)
        left = np.flatnonzero(at >= 0)
        for step in range(self.deepest):
            hit = self.keys[at[left] + step] == hashed[left]
            found[left[hit]] = self.ids[at[left[hit]] + step]
            left = left[~hit]
        return found

    def edges(self, chars: np.ndarray) -> list[list[np.ndarray]]:
        """edges[e][k - 1]: piece of each word over its characters e - k .. e."""
        n, length = chars.shape
        wide = chars.astype(np.uint64) + np.uint64(1)
        out: list[list[np.ndarray]] = [[] for _ in range(length + 1)]
        rolling: list[np.ndarray] = []
        for e in range(1, length + 1):
            rolling = [h * _STEP + wide[:, e - 1] for h in rolling[-(self.longest - 1):]] if self.longest > 1 else []
            rolling.append(wide[:, e - 1])
            out[e] = [self.look(h) for h in reversed(rolling)]
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


class Lattice:
    """Sums over all segmentations of words; characters without a piece are spelt in bytes."""

    def __init__(self, finder: Finder, scores: np.ndarray):
        self.finder, self.vocabulary = finder, finder.vocabulary
        self.scores = np.append(scores, -np.inf)  # the last one stands for no piece

    def _spelt(self, char: int) -> list[int]:
        return [self.vocabulary.bytes_at + b for b in chr(char).encode("utf-8", "surrogatepass")]

    def _blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            size = max(1, BLOCK * 10 // max(10, int(lengths[same[0]]) if len(same) else 10))
            for i in range(0, len(same), size):
                some = same[i : i + size]
                if len(some):
                    text = "".join(START + words[k] for k in some)
                    yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), -1)

    def _unknown(self, edges: list, chars: np.ndarray) -> dict[int, np.ndarray]:
        """Score of spelling the character before each end, where it has no piece."""
        out = {}
        for e in range(1, chars.shape[1] + 1):
            missing = edges[e][0] < 0
            if missing.any():
                scores = np.full(len(chars), -np.inf)
                for char in np.unique(chars[missing, e - 1]):
                    scores[missing & (chars[:, e - 1] == char)] = sum(self.scores[i] for i in self._spelt(int(char)))
                out[e] = scores
        return out

    def _forward(self, edges: list, unknown: dict, n: int) -> list[np.ndarray]:
        alpha = [np.zeros(n)]
        for e in range(1, len(edges)):
            terms = [alpha[e - k] + self.scores[piece] for k, piece in enumerate(edges[e], 1)]
            if e in unknown:
                terms.append(alpha[e - 1] + unknown[e])
            alpha.append(_log_sum(terms))
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of the marginal probability of each word, with the mark of its start."""
        out = np.empty(len(words))
        for some, chars in self._blocks(words):
            edges = self.finder.edges(chars)
            out[some] = self._forward(edges, self._unknown(edges, chars), len(some))[-1]
        return out

    def expected_counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations of the words, each taken `times` times."""
        total = np.zeros(self.vocabulary.size + 1)
        for some, chars in self._blocks(words):
            edges = self.finder.edges(chars)
            unknown, n, last = self._unknown(edges, chars), len(some), chars.shape[1]
            alpha = self._forward(edges, unknown, n)
            beta = [None] * last + [np.zeros(n)]
            reach: list[list[np.ndarray]] = [[] for _ in range(last + 1)]
            for e in range(last, 0, -1):
                if e < last:
                    beta[e] = _log_sum(reach[e])
                    reach[e] = []
                for k, piece in enumerate(edges[e], 1):
                    through = self.scores[piece] + beta[e]
                    reach[e - k].append(through)
                    used = np.flatnonzero(piece >= 0)
                    share = np.exp(alpha[e - k][used] + through[used] - alpha[last][used]) * times[some[used]]
                    total += np.bincount(piece[used], share, len(total))
                if e in unknown:
                    through = unknown[e] + beta[e]
                    reach[e - 1].append(through)
                    for i in np.flatnonzero(np.isfinite(through)):
                        share = np.exp(alpha[e - 1][i] + through[i] - alpha[last][i]) * times[some[i]]
                        np.add.at(total, self._spelt(int(chars[i, e - 1])), share)
        return total[:-1]


class _Words:
    """Distinct words of a chunk in order of their first use, and the words of its documents by number."""

    def __init__(self, row: dict):
        known: dict[bytes, int] = defaultdict(count().__next__)
        own = [t.lower().split() for t in texts_of(row)]
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.sequence = np.fromiter((known[w] for words in own for w in words), np.int64, int(self.sizes.sum()))
        self.words = list(known)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.learn = row["ids"].field("learn").to_numpy(zero_copy_only=False).astype(bool)


def _unpack_words(data: bytes) -> list[bytes]:
    return unpacked(data).split()


def _merged(group: pa.Table) -> tuple[dict[bytes, int], np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket, their training counts, and the place in them of each chunk's words."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    places, counts = [], []
    for words, times in zip(group["words"].to_pylist(), group["times"].to_pylist()):
        own = _unpack_words(words)
        places.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        counts.append(np.frombuffer(unpacked(times), "<i8"))
    total = np.bincount(np.concatenate(places), np.concatenate(counts).astype(np.float64), len(known)).astype(np.int64)
    return dict(known), total, places


SENT = "bucket int, chunk bigint, words binary, times binary"


def score_texts(
    docs: DataFrame, learn_from: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of `docs`: id, learn, n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens are words between ASCII white space, A-Z lower-cased, and one end. Counts of all rows where `learn_from` holds
    are learnt from. The base score is an add-half unigram over words. Null texts are empty: their only token is the end.
    Without training rows the scores of the vocabulary stay as they are.
    """
    spark = docs.sparkSession
    size = total_bytes(docs, text_col)[1]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(learn_from, F.lit(False)).alias("learn")).alias("_key"), F.col(text_col).alias("_words"))
    chunks = write_chunks(keyed, "_key", "_words").df

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        own = _Words(row)
        learnt = np.repeat(own.learn, own.sizes)
        times = np.bincount(own.sequence[learnt], minlength=len(own.words))
        rows = [(b, row["chunk"], packed(b" ".join([own.words[i] for i in at])), packed(times[at].astype("<i8").tobytes())) for b, at in by_bucket(own.hashes, buckets)]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "words", "times"]
        )

    sent = store(each_chunk(chunks, send, SENT)).df

    def merge(group: pa.Table) -> pa.Table:
        known, total, _ = _merged(group)
        words = [w for w, n in zip(known, total.tolist()) if n]
        kept = total[total > 0]
        return pa.table({"words": pa.array([packed(b" ".join(words))], pa.binary()),
                         "n": pa.array([int(kept.sum())], pa.int64()), "v": pa.array([len(words)], pa.int64())})

    corpus = store(sent.groupBy("bucket").applyInArrow(merge, "words binary, n bigint, v bigint")).df
    sums = corpus.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    ends = docs.where(learn_from).count()
    n_train, v_train = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    vocabulary = read_vocabulary(model_path)
    finder, scores = Finder(vocabulary), vocabulary.scores
    for _ in range(rounds if ends else 0):
        scores = _reestimated(corpus, finder, scores)
    lattice = Lattice(finder, scores)
    words_seen = int(sums["v"] or 0)
    # Without training words the lattice has half of all mass, the end the other half.
    rest, whole = (np.log(DISCOUNT * words_seen), np.log(n_train)) if words_seen else (np.log(0.5), 0.0)
    end_score = (np.log(ends) - whole if words_seen else np.log(0.5)) / np.log(10.0)

    def value(group: pa.Table) -> pa.Table:
        known, total, places = _merged(group)
        spelt = rest + lattice.log_probabilities([w.decode("utf-8", "surrogatepass") for w in known])
        with np.errstate(divide="ignore"):
            own = (np.logaddexp(np.log(np.maximum(total - DISCOUNT, 0.0)), spelt) - whole) / np.log(10.0)
        return pa.table({
            "chunk": group["chunk"], "bucket": group["bucket"],
            "times": pa.array([packed(total[p].astype("<i8").tobytes()) for p in places], pa.binary()),
            "scores": pa.array([own[p].astype("<f8").tobytes() for p in places], pa.binary()),
        })

    answers = store(sent.groupBy("bucket").applyInArrow(value, "chunk bigint, bucket int, times binary, scores binary")).df
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("learn", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ])
    arrow = arrow_schema(schema)
    scale = np.log10(n_train + 0.5 * (v_train + 1))

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        own = _Words(row)
        times, values = np.zeros(len(own.words), np.int64), np.zeros(len(own.words))
        back = {a["bucket"]: a for a in row["answers"] or ()}
        for bucket, at in by_bucket(own.hashes, buckets):
            times[at] = np.frombuffer(unpacked(back[bucket]["times"]), "<i8")
            values[at] = np.frombuffer(back[bucket]["scores"], "<f8")
        document = np.repeat(np.arange(len(own.sizes)), own.sizes)
        add = lambda x: np.bincount(document, x[own.sequence], len(own.sizes))
        n_tokens = own.sizes + 1
        base = add(np.log10(times + 0.5)) + np.log10(ends + 0.5) - n_tokens * scale
        yield pa.RecordBatch.from_arrays([
            row["ids"].field("id").cast(arrow.field(id_col).type), pa.array(own.learn), pa.array(n_tokens),
            pa.array(add((times > 0).astype(float)).astype(np.int64) + int(ends > 0)), pa.repeat(pa.scalar(n_train, pa.int64()), len(n_tokens)),
            pa.array(base), pa.array(add(values) + end_score),
        ], schema=arrow)

    return each_chunk(with_answers(chunks, answers=answers), finish, schema)


def _reestimated(corpus: DataFrame, finder: Finder, scores: np.ndarray) -> np.ndarray:
    """Scores from the expected counts of all distinct training words; one number per piece goes to the driver."""
    lattice = Lattice(finder, scores)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(finder.vocabulary.size)
        for batch in batches:
            for words in batch.column("words").to_pylist():
                own = [w.decode("utf-8", "surrogatepass") for w in _unpack_words(words)]
                total += lattice.expected_counts(own, np.ones(len(own)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "times"])

    counted = corpus.select("words").mapInArrow(expect, "piece int, times double")
    total = np.full(finder.vocabulary.size, 0.01)
    for row in counted.groupBy("piece").agg(F.sum("times").alias("times")).collect():
        total[row["piece"]] += row["times"]
    return np.log(total / total.sum())
