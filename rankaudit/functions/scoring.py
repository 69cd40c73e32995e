"""Score modes and ablations over the feature columns, one pass, long result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import DOMAIN_FEATURES, FULL_SCORE, MODE_ONLY_FEATURES, with_domain_features
from .fixed import ABLATION_REMOVES, COMPOSITION_TERMS, MODE_WEIGHTS
from .mathx import clamp01, hash_uniform, round_to
from .text import add_all


def linear(weights: dict[str, float]) -> Column:
    return add_all([F.lit(weight) * F.col(name) for name, weight in weights.items()])


def mode_columns(modes: dict[str, dict[str, float]] | None = None) -> dict[str, Column]:
    """Registry of score modes: name -> column over the feature row; the full score comes with the row, unrounded."""
    chosen = modes or MODE_WEIGHTS
    exact = lambda weights: F.col(FULL_SCORE) if weights is MODE_WEIGHTS["sar"] else linear(weights)
    return {name: round_to(clamp01(exact(weights))) for name, weights in chosen.items()}


def ablation_columns() -> dict[str, Column]:
    """Registry of ablations of the full score, which must be present as `sar`."""
    full = MODE_WEIGHTS["sar"]
    columns = {"full": F.col("sar")}
    for name, removed in ABLATION_REMOVES.items():
        columns[name] = clamp01(F.col("sar") - linear({term: full[term] for term in removed}))
    columns["composition_only"] = clamp01(linear({term: full[term] for term in COMPOSITION_TERMS}))
    columns["hash_control"] = hash_uniform(F.col("candidate_id"))
    return columns


def to_long(df: DataFrame, keep: list[str], columns: dict[str, Column], key: str) -> DataFrame:
    """One row per (row, named column): a map-free unpivot that stays in the projection."""
    wide = df.select(*keep, *[column.alias(f"_v_{name}") for name, column in columns.items()])
    pairs = F.array(
        *[F.struct(F.lit(name).alias(key), F.col(f"_v_{name}").alias("score")) for name in columns]
    )
    return wide.select(*keep, F.inline(pairs))


def score_modes(public: DataFrame, modes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Blind scoring: reads only the public columns, returns (id, sequence, length, mode, score)."""
    featured = with_domain_features(public.select("candidate_id", "sequence"))
    return to_long(featured, ["candidate_id", "sequence", "length"], mode_columns(modes), "mode")


def unblinded(scored: DataFrame, key: DataFrame, required: bool = False) -> DataFrame:
    """Attach labels to one-row-per-candidate scores, before they are made long.

    Joining first moves one row per candidate through the shuffle, not one per score. A
    missing key is labelled, or dropped when it is required.
    """
    labels = key.select("candidate_id", "label")
    if required:
        return scored.join(labels, "candidate_id")
    return scored.join(labels, "candidate_id", "left").fillna({"label": "missing_key"})


def labelled_modes(public: DataFrame, key: DataFrame, modes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """All mode scores, blind, then labelled: (id, sequence, length, label, mode, score)."""
    featured = with_domain_features(public.select("candidate_id", "sequence"))
    wide = featured.select(
        "candidate_id", "sequence", "length", *[c.alias(name) for name, c in mode_columns(modes).items()]
    )
    names = {name: F.col(name) for name in mode_columns(modes)}
    return to_long(unblinded(wide, key), ["candidate_id", "sequence", "length", "label"], names, "mode")


def labelled_ablations(public: DataFrame, key: DataFrame) -> DataFrame:
    featured = with_domain_features(public.select("candidate_id", "sequence"))
    scored = featured.withColumn("sar", mode_columns()["sar"])
    columns = ablation_columns()
    wide = scored.select("candidate_id", "sequence", "length", *[c.alias(name) for name, c in columns.items()])
    names = {name: F.col(name) for name in columns}
    return to_long(unblinded(wide, key, True), ["candidate_id", "sequence", "length", "label"], names, "ablation")


def score_wide(public: DataFrame) -> DataFrame:
    """Feature row with one column per mode."""
    featured = with_domain_features(public.select("candidate_id", "sequence"))
    kept = ["candidate_id", "sequence", "length", *DOMAIN_FEATURES, *MODE_ONLY_FEATURES]
    return featured.select(*kept, *[c.alias(name) for name, c in mode_columns().items()])


def score_ablations(public: DataFrame) -> DataFrame:
    featured = with_domain_features(public.select("candidate_id", "sequence"))
    scored = featured.withColumn("sar", mode_columns()["sar"])
    return to_long(scored, ["candidate_id", "sequence", "length"], ablation_columns(), "ablation")
