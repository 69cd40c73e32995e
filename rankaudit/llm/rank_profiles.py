"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of a language. A document gets the language whose profile
has the least out-of-place distance to its own list; an n-gram that a profile lacks costs the profile length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batches_of

PROFILE = 300
#: Code points that are ranked in one go; longer texts are taken in pieces that are added up.
PIECE = 1 << 20
MAX_LANGUAGES = 10_000
_BITS = np.uint64(21)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the n-grams of one to three characters of the words of `text`, and their counts.

    Letters are lower-cased, everything else separates words; a word is seen with a space on either side. A code
    packs code points at 21 bits each. No letters: two empty arrays.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    whole = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes, counts = [], []
    for i in range(0, len(whole), PIECE):
        own = whole[max(0, i - 2) : i + PIECE]
        fresh = 2 if i else 0
        x = np.where(_letters()[own], own, 32).astype(np.uint64)
        if not i:
            x = np.concatenate([[np.uint64(32)], x])
        if i + PIECE >= len(whole):
            x = np.concatenate([x, [np.uint64(32)]])
        letter = x != 32
        two = (x[:-1] << _BITS) | x[1:]
        grams = [x[fresh:][letter[fresh:]], two[max(fresh - 1, 0):][(letter[:-1] | letter[1:])[max(fresh - 1, 0):]]]
        if len(x) > 2:
            grams.append(((two[:-1] << _BITS) | x[2:])[letter[1:-1]])
        a, b = np.unique(np.concatenate(grams), return_counts=True)
        codes.append(a)
        counts.append(b)
    return (codes[0], counts[0]) if len(codes) == 1 else added(codes, counts)


def added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; the lesser code first where counts are equal."""
    if len(codes) > 4 * size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))][:size]


def learn_profiles(docs: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of every language: counts over all rows of `docs`, `size` n-grams each to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
                a, b = gram_counts(text)
                codes, counts = held.setdefault(lang, ([], []))
                codes.append(a)
                counts.append(b)
                if len(codes) > 500:
                    a, b = added(codes, counts)
                    held[lang] = ([a], [b])
        for lang, (codes, counts) in held.items():
            a, b = added(codes, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang), len(a)), pa.array(a.astype(np.int64)), pa.array(b)], ["lang", "gram", "n"]
            )

    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(F.col("_lang").isNotNull())
    counts = rows.mapInArrow(local, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in top.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(row["lang"], []).append(row["gram"])
        if len(profiles) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: the label column does not hold languages")
    return {lang: np.array(grams, np.int64).astype(np.uint64) for lang, grams in sorted(profiles.items())}


class Classifier:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for k, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        ranks = self.ranks[np.where(known, at, len(self.grams))]
        apart = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.size, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the share of the second-best distance in the two best ones; `und` without a letter."""
        own = ranked(*gram_counts(text), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        far = self.distances(own)
        order = np.argsort(far, kind="stable")
        best = float(far[order[0]])
        second = float(far[order[1]]) if len(order) > 1 else float(len(own) * self.size)
        return self.names[order[0]], second / (best + second) if best + second else 1.0


def predict_languages(
    docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE
) -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score. Profiles come from the rows where `learn_from` holds.

    Only text and language are learnt from, only text is looked at in a prediction. Null texts and texts without a
    letter are `und` with score 0, and so is everything when nothing could be learnt. Ties go to the first name.
    """
    batches_of(docs.sparkSession)
    classifier = Classifier(learn_profiles(docs.where(learn_from), text_col, lang_col, size), size)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = arrow_schema(schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classifier.predict(text) for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=arrow
            )

    return rows.mapInArrow(predict, schema)
