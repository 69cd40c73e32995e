"""Position-weight site scan and the stability score built on it. No join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cut_matrices import CUT_MATRICES
from ..functions.fixed import ALPHABET
from ..functions.mathx import clamp01, sigmoid
from ..functions.text import add_all

_SYMBOLS = ALPHABET + "X_"


def _weights(position: dict[str, float]) -> Column:
    """Weights in symbol order; an unlisted symbol takes `*`, off-end falls back to it as well."""
    other = position.get("*", 0.0)
    return F.array(F.lit(other), *[F.lit(position.get(s, other)) for s in _SYMBOLS])


def _logit(sequence: Column, index: Column, model: dict) -> Column:
    """Sum of the weights around the 1-based residue `index` that precedes the cut."""
    terms = [F.lit(model.get("intercept", 0.0))]
    for offset, position in model["positions"].items():
        place = index + F.lit(offset)
        inside = (place >= 1) & (place <= F.length(sequence))
        letter = F.when(inside, F.substring(sequence, place, F.lit(1))).otherwise(F.lit("_"))
        symbol = F.position(letter, F.lit(_SYMBOLS))
        terms.append(F.get(_weights(position), symbol))
    if "distance_penalty" in model:
        terms.append(F.lit(float(model["distance_penalty"])) * (index - F.lit(1)))
    return add_all(terms)


def sites(sequence: Column, model: dict) -> Column:
    """Array of (position, probability, residue, next_residue) at or above the model's threshold."""
    size = F.length(sequence)
    start = F.lit(int(model.get("min_index", 0)) + 1)
    stop = size - F.lit(1)
    if "max_index" in model:
        stop = F.least(stop, F.lit(int(model["max_index"]) + 1))
    scored = F.transform(
        F.sequence(start, stop),
        lambda i: F.struct(
            i.alias("position"),
            sigmoid(_logit(sequence, i, model)).alias("probability"),
            F.substring(sequence, i, F.lit(1)).alias("residue"),
            F.substring(sequence, i + F.lit(1), F.lit(1)).alias("next_residue"),
        ),
    )
    kept = F.filter(scored, lambda s: s["probability"] >= F.lit(model.get("min_probability", 0.0)))
    empty = F.array().cast("array<struct<position:int,probability:double,residue:string,next_residue:string>>")
    return F.when((size >= 2) & (stop >= start), kept).otherwise(empty)


def overall(found: Column) -> Column:
    """Probability that at least one site is cut."""
    whole = F.aggregate(found, F.lit(1.0), lambda a, s: a * (F.lit(1.0) - s["probability"]))
    return clamp01(F.lit(1.0) - whole)


def cleavage_profile(df: DataFrame, models: dict[str, dict] | None = None) -> DataFrame:
    """One row per (input row, enzyme) with `sites` and the overall `probability`."""
    chosen = models or CUT_MATRICES
    per_model = F.array(
        *[F.struct(F.lit(name).alias("enzyme"), sites(F.col("sequence"), m).alias("sites")) for name, m in chosen.items()]
    )
    opened = df.select("*", F.inline(per_model))
    return opened.withColumn("probability", overall(F.col("sites")))


def stability(df: DataFrame, models: dict[str, dict] | None = None, least: float = 0.2) -> DataFrame:
    """1 - likely sites / possible sites, and the count per enzyme; 1 for a single residue."""
    chosen = models or CUT_MATRICES
    likely = lambda s: (s["probability"] >= F.lit(least)) & (s["next_residue"] != "P")
    counts = {
        f"{name}_sites": F.size(F.filter(sites(F.col("sequence"), m), likely)) for name, m in chosen.items()
    }
    counted = df.withColumns(counts)
    total = add_all([F.col(name) for name in counts])
    share = F.least(total / F.greatest(F.lit(1), F.length("sequence") - F.lit(1)), F.lit(1.0))
    score = F.when(F.length("sequence") <= 1, F.lit(1.0)).otherwise(F.lit(1.0) - share)
    return counted.withColumn("stability", score)
