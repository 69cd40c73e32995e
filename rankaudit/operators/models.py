"""Linear and tree models over sparse string features, and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, MaxAbsScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import DOMAIN_FEATURES, with_domain_features
from ..functions.fixed import ALPHABET
from ..functions.scoring import mode_columns
from ..functions.text import (
    count_of, edge_ngrams, fraction_of, kmer_tokens, motif_flags, position_tokens, windows_of,
)
from ..session import materialize
from .metrics import evaluate, is_positive
from .panels import training_merge
from .validation import stratified_folds


def feature_tokens(df: DataFrame) -> DataFrame:
    """Add `tokens`: every feature of a string as (token, value) pairs, categories one-hot."""
    featured = with_domain_features(df).withColumns({f"mode_{n}": c for n, c in mode_columns().items()})
    s = F.col("sequence")
    numbers = {name: F.col(name) for name in (*DOMAIN_FEATURES, "length")}
    numbers.update({f"mode_{n}": F.col(f"mode_{n}") for n in mode_columns()})
    numbers.update(motif_flags(s))
    for aa in ALPHABET:
        numbers[f"count_{aa}"] = count_of(s, aa)
        numbers[f"share_{aa}"] = fraction_of(s, aa)
    pairs = F.array(
        *[F.struct(F.lit(n).alias("token"), c.cast("double").alias("value")) for n, c in numbers.items()]
    )
    one = lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("value"))
    named = F.concat(
        pairs, F.transform(edge_ngrams(s), one), F.transform(position_tokens(s), one), kmer_tokens(s)
    )
    return featured.select(*df.columns, named.alias("tokens"))


FAMILY = {
    "logistic_c0_05": lambda total: LogisticRegression(regParam=1.0 / (0.05 * total), maxIter=100, standardization=False),
    "logistic_c0_2": lambda total: LogisticRegression(regParam=1.0 / (0.2 * total), maxIter=100, standardization=False),
    "logistic_c1": lambda total: LogisticRegression(regParam=1.0 / total, maxIter=100, standardization=False),
    "svm_c0_05": lambda total: LinearSVC(regParam=1.0 / (0.05 * total), maxIter=100, standardization=False),
    "svm_c0_2": lambda total: LinearSVC(regParam=1.0 / (0.2 * total), maxIter=100, standardization=False),
    "boosted_trees": lambda total: GBTClassifier(maxIter=10, maxDepth=3, seed=7),
}


def balanced(train: DataFrame) -> tuple[DataFrame, float]:
    """Class-balanced row weights times the row's own weight; returns the total of both factors, which C refers to."""
    sizes = train.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_positive()).alias("p"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"),
        F.coalesce(F.sum(F.when(is_positive(), F.col("weight"))), F.lit(0.0)).alias("w_pos"),
    ).first()
    positives, negatives = max(sizes["p"], 1), max(sizes["n"] - sizes["p"], 1)
    total = sizes["n"] / 2.0 * (sizes["w_pos"] / positives + (sizes["w"] - sizes["w_pos"]) / negatives)
    share = F.when(is_positive(), F.lit(sizes["n"] / (2.0 * positives)))
    share = share.otherwise(F.lit(sizes["n"] / (2.0 * negatives)))
    labelled = train.withColumns(
        {"target": F.when(is_positive(), F.lit(1.0)).otherwise(F.lit(0.0)), "row_weight": share * F.col("weight")}
    )
    return labelled, float(total)


def with_feature_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric feature columns, and `terms`: position, edge and inner k-mer categories."""
    s = F.col("sequence")
    modes = {f"mode_{n}": c for n, c in mode_columns().items()}
    added = dict(motif_flags(s))
    for aa in ALPHABET:
        added[f"count_{aa}"] = count_of(s, aa).cast("double")
        added[f"share_{aa}"] = fraction_of(s, aa)
    terms = F.concat(position_tokens(s), edge_ngrams(s), windows_of(s, 2), windows_of(s, 3))
    featured = with_domain_features(df).withColumns(modes).withColumns({**added, "terms": terms})
    return featured, [*DOMAIN_FEATURES, "length", *modes, *added]


def train_family(train: DataFrame, names: list[str] | None = None, size: int = 1 << 15) -> dict:
    """Fit each model of the family on `sequence, label, weight`; returns fitted pipelines.

    Terms are hashed, so no vocabulary is gathered. Features are built once for all models; they are scaled to a largest
    value of one, and the penalty acts on that scale.
    """
    featured, numeric = with_feature_columns(train)
    labelled, total = balanced(featured)
    hashing = HashingTF(inputCol="terms", outputCol="hashed", numFeatures=size)
    joined = VectorAssembler(inputCols=[*numeric, "hashed"], outputCol="joined")
    wide = joined.transform(hashing.transform(labelled)).select("joined", "target", "row_weight").persist()
    scaler = MaxAbsScaler(inputCol="joined", outputCol="features").fit(wide)
    prepared = scaler.transform(wide)
    fitted = {}
    for name in names or list(FAMILY):
        model = FAMILY[name](total)
        model.setLabelCol("target").setWeightCol("row_weight").setFeaturesCol("features")
        fitted[name] = PipelineModel(stages=[hashing, joined, scaler, model.fit(prepared)])
    wide.unpersist()
    return fitted


def score_family(fitted: dict, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Long scores (model_id, keep..., score): positive probability, or the raw margin."""
    prepared, _ = with_feature_columns(rows)
    parts = []
    for name, model in fitted.items():
        out = model.transform(prepared)
        column = "probability" if "probability" in out.columns else "rawPrediction"
        score = vector_to_array(F.col(column)).getItem(1).alias("score")
        parts.append(out.select(F.lit(name).alias("model_id"), *keep, score))
    return reduce(DataFrame.unionByName, parts)


def split_groups(rows: DataFrame, group: str, folds: int = 5, seed: str = "models") -> DataFrame:
    """Add `held_out`: whole groups, dealt so that a fold's share of positives and rows is held out."""
    fold = stratified_folds(rows, group, 1, folds, seed).select(F.col(group).alias("_group"), (F.col("fold") == 1).alias("held_out"))
    return rows.join(fold, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def train_and_hold_out(
    rows: DataFrame, group: str, names: list[str], per_positive: int = 4, folds: int = 5, seed: str = "models"
) -> DataFrame:
    """Long scores of held-out rows only, by models that no row of their groups has trained.

    `rows` is sequence, label and the group column. Training takes the other groups: all positives
    and decoys, and background sampled per positive. The scores are (model_id, sequence, label, score).
    """
    split = materialize(split_groups(rows, group, folds, seed))
    known = split.where(~F.col("held_out"))
    weights = known.where(is_positive()).select("sequence", F.lit(1.0).alias("weight")).distinct()
    train = materialize(training_merge(known.select("sequence", "label"), weights, per_positive=per_positive))
    fitted = train_family(train, names)
    return score_family(fitted, split.where("held_out").select("sequence", "label"), ["sequence", "label"])


def leaderboard(scores: DataFrame) -> DataFrame:
    """All models evaluated in one grouped plan, best first."""
    table = evaluate(scores, ["model_id"])
    return table.orderBy(F.desc("top_1pct_count"), F.desc("top_10pct_count"), F.desc("auroc_matched"), "mean_rank")
