"""Toxicity scores: boosted trees over a few dense features of the whole text, calibrated by isotonic regression.

A lexicon of words and word beginnings with their log-odds is counted from labelled rows. Its densities, hits near
a second person, capitals, punctuation and obfuscation are the features. Trees are fitted on one part of the labelled
rows and calibrated on another; a labelled row never counts in its own lexicon weights.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batches_of, store

#: Bound of the sample of labelled rows that the model is fitted on, and of the entries of its lexicon.
FIT_ROWS, LEXICON = 40_000, 20_000
PREFIXES = (3, 4, 5, 6)
MIN_TOXIC = 3
NEAR = 5

#: Pronouns of the second person in the languages of the tables, characters used for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu toi te ton ta tes vous votre vos "
                          "ti tú usted ustedes vosotros tus su".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

_WORD = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"[^\W\d_]++(?:[0-9@$*!]++[^\W\d_]++)+")
_INNER, _ONE_LETTER = re.compile(r"[0-9@$*!]++(?=[^\W\d_])"), re.compile(r"[^\W\d_]")
_SHOUT = re.compile(r"\b[A-Z]{2,}\b")
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_NOT_UPPER, _NOT_LETTER, _NOT_PUNCT = (bytes(set(range(256)) - set(x)) for x in (_UPPER, _LETTER, _PUNCT))

FEATURES = ("strong_hits", "strong_density", "weak_density", "max_weight", "mean_top3", "near_second_person",
            "capitals", "shouting", "punctuation", "exclamations", "disguised", "disguised_hits", "log_words")


def entries(word: str) -> set[str]:
    """A word and its beginnings, which stand with a star."""
    return {word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)}


def disguised(text: str) -> list[str]:
    """Runs of letters with characters used for letters between them, found from those characters: most words have none."""
    found, end = [], 0
    for inner in _INNER.finditer(text):
        start = inner.start()
        if start < end:
            continue
        while start > end and _ONE_LETTER.match(text, start - 1):
            start -= 1
        if start < inner.start():
            whole = _DISGUISED.match(text, start)
            found.append(whole.group())
            end = whole.end()
    return found


class _Weights(dict):
    """Weights of words: the greatest above zero of the entries that hold a word, or zero."""

    def __init__(self, lexicon: Lexicon, own: int | None):
        # An entry of no harmless document stands in none of those that leave themselves out.
        weights = {e: w for e, (a, b) in lexicon.counts.items() if (own != 0 or b) and (w := lexicon.weigh(a, b, own)) > 0.0}
        self.whole = {e: w for e, w in weights.items() if not e.endswith("*")}
        self.beginnings = {e[:-1]: w for e, w in weights.items() if e.endswith("*")}

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        value = self.whole.get(word, 0.0)
        for k in PREFIXES:
            if len(word) >= k and (found := self.beginnings.get(word[:k], 0.0)) > value:
                value = found
        self[word] = value
        return value


class _Entries(dict):
    """Entries of words, all or the known ones."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = tuple(entries(word) if self.known is None else entries(word) & self.known)
        return value


_MEMO: dict[tuple[str, int | None], _Weights] = {}


class Lexicon:
    """Smoothed log-odds of the entries, with or without one document.

    Weights of words are remembered by the Python worker for all its tasks, up to a bound; those of other models, and of the
    fit once texts are scored, are forgotten.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean, self.name = counts, toxic, clean, uuid.uuid4().hex

    def weigh(self, a: int, b: int, own: int | None = None) -> float:
        toxic, clean = self.toxic, self.clean
        if own is not None:
            a, b, toxic, clean = a - own, b - (1 - own), toxic - own, clean - (1 - own)
        return math.log((a + 0.1) / (toxic + 1.0)) - math.log((b + 0.5) / (clean + 1.0)) if a >= 2 else 0.0

    def weights(self, words: list[str], own: int | None) -> np.ndarray:
        if (self.name, own) not in _MEMO:
            for other in [k for k in _MEMO if k[0] != self.name or own is None]:
                del _MEMO[other]
            _MEMO[self.name, own] = _Weights(self, own)
        memo = _MEMO[self.name, own]
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))


def features(text: str | None, lexicon: Lexicon, own: int | None = None) -> list[float]:
    """The dense features of a whole text; zeros for an empty one. `own` is the label to leave out."""
    text = text or ""
    raw, words = text.encode("utf-8", "surrogatepass"), _WORD.findall(text.lower())
    n, size = max(1, len(words)), max(1, len(raw))
    weights = lexicon.weights(words, own)
    strong = np.flatnonzero(weights >= 3.0)
    top = np.sort(weights)[::-1][:3]
    near = 0
    if len(strong):
        persons = np.flatnonzero([w in SECOND_PERSON for w in words])
        if len(persons):
            at = np.searchsorted(persons, strong)
            after = np.abs(persons[np.minimum(at, len(persons) - 1)] - strong)
            before = np.abs(persons[np.maximum(at - 1, 0)] - strong)
            near = int((np.minimum(after, before) <= NEAR).sum())
    letters = max(1, len(raw.translate(None, _NOT_LETTER)))
    hidden = disguised(text)
    plain = lexicon.weights([x.lower().translate(LOOKALIKES) for x in hidden], own)
    return [
        float(np.log1p(len(strong))), 100.0 * len(strong) / n, 100.0 * float((weights >= 1.5).sum()) / n, float(top.max(initial=0.0)),
        float(top.sum()) / 3, near / n * 100.0, len(raw.translate(None, _NOT_UPPER)) / letters, len(_SHOUT.findall(text)) / n,
        len(raw.translate(None, _NOT_PUNCT)) / size, raw.count(b"!") / size, len(hidden) / n,
        float(np.log1p((plain >= 3.0).sum())), float(np.log1p(len(words))),
    ]


def _documents_of(rows: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """Documents that hold each entry: of all entries, or of the known ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, listed = Counter(), _Entries(known)
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                own = set()
                for word in set(_WORD.findall((text or "").lower())):
                    own.update(listed[word])
                total.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["entry", "n"])

    return rows.select("_text").mapInArrow(counted, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def learn_lexicon(fit: DataFrame) -> Lexicon:
    """Entries of at least `MIN_TOXIC` toxic documents that are likelier there, the best `LEXICON` of them.

    `fit` is the bounded sample, so what goes to the driver is bounded too.
    """
    sizes = fit.agg(F.sum("_toxic").alias("a"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(sizes["a"] or 0), sizes["n"] - int(sizes["a"] or 0)
    often = _documents_of(fit.where("_toxic = 1")).where(F.col("n") >= MIN_TOXIC)
    a = {r["entry"]: r["n"] for r in often.collect()}
    b = {r["entry"]: r["n"] for r in _documents_of(fit.where("_toxic = 0"), frozenset(a)).collect()}
    lexicon = Lexicon({e: (n, b.get(e, 0)) for e, n in a.items()}, toxic, clean)
    worth = {e: w * math.sqrt(n) for e, (n, m) in lexicon.counts.items() if (w := lexicon.weigh(n, m)) >= 1.0}
    best = sorted(worth, key=lambda e: (-worth[e], e))[:LEXICON]
    lexicon.counts = {e: lexicon.counts[e] for e in best}
    return lexicon


@dataclass
class Model:
    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    constant: float = 0.0


def _with_features(rows: DataFrame, lexicon: Lexicon, text: str, label: str | None) -> DataFrame:
    """`rows` with the features in front of their columns."""
    schema = T.StructType([*[T.StructField(f"_{n}", T.DoubleType()) for n in FEATURES], *rows.schema.fields])
    arrow = arrow_schema(schema)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(label).to_pylist() if label else [None] * batch.num_rows
            found = [features(t, lexicon, y) for t, y in zip(batch.column(text).to_pylist(), labels)]
            values = np.array(found, np.float64).reshape(-1, len(FEATURES))
            columns = [pa.array(values[:, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], schema=arrow)

    return rows.mapInArrow(extract, schema)


def _assembled(rows: DataFrame) -> DataFrame:
    names = [f"_{n}" for n in FEATURES]
    return VectorAssembler(inputCols=names, outputCol="_vector").transform(rows).drop(*names)


def _margin(rows: DataFrame, trees) -> DataFrame:
    return trees.transform(rows).withColumn("_raw", vector_to_array("_probability")[1]).drop("_rawPrediction", "_probability", "_prediction")


def fit_model(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows where `learn_from` (over the id) holds, on `fit_rows` of them at most.

    The sample is drawn by a hash of the id. Rows without a label, and labels without a document, are left out;
    of several labels of an id the highest counts. With one class only, every score is that class's share.
    """
    usable = labels.where(learn_from & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = usable.groupBy(F.col(id_col).alias("_key")).agg(F.max(label_col).cast("int").alias("_toxic"))
    n = known.count()
    share = F.pmod(F.xxhash64(F.lit("fit"), F.col("_key")), F.lit(1_000_000))
    known = known.where(share < F.lit(int(1_000_000 * fit_rows / n) if n > fit_rows else 1_000_000))
    own = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    fit = store(own.join(F.broadcast(known), "_key"))
    lexicon = learn_lexicon(fit.df)
    if not lexicon.toxic or not lexicon.clean:
        return Model(lexicon, constant=float(lexicon.toxic > 0))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("_key")), F.lit(3))
    rows = _with_features(fit.df.withColumn("_part", part.cast("int")), lexicon, "_text", "_toxic").drop("_text")
    made = store(_assembled(rows))
    fit.discard()
    label = F.col("_toxic").cast("double").alias("label")
    grow = made.df.where("_part < 2").select("_vector", label)
    check = made.df.where("_part = 2").select("_vector", label)
    if grow.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        grow = check = made.df.select("_vector", label)
    grower = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=7)
    grower.setRawPredictionCol("_rawPrediction").setProbabilityCol("_probability").setPredictionCol("_prediction")
    trees = grower.fit(grow)
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_score").fit(_margin(check, trees))
    return Model(lexicon, trees, calibration)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) in a column of its own; null texts are empty and have a score too."""
    batches_of(docs.sparkSession)
    if model.trees is None:
        return docs.withColumn("_score", F.lit(model.constant))
    scored = model.calibration.transform(_margin(_assembled(_with_features(docs, model.lexicon, text_col, None)), model.trees))
    return scored.withColumn("_score", F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0))).drop("_raw", "_vector")
