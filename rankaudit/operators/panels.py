"""Panel composition, row selection and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MATCHED_LABEL, NEGATIVE_LABELS, POSITIVE_LABELS
from ..functions.mathx import hash_uniform
from ..session import materialize
from .metrics import is_matched, is_positive
from .ordering import global_rank


def composition(panel: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct references and materials, short and terminal counts per panel."""
    short = F.length("sequence") <= 5
    ends = F.col("sequence").endswith("P")
    return panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("reference").alias("reference_count"),
        F.count_distinct("material").alias("material_count"),
        F.count_if(short).alias("length_le_5_count"),
        F.count_if(~short).alias("length_gt_5_count"),
        F.count_if(ends).alias("ends_proline_count"),
        F.count_if(~ends).alias("ends_other_count"),
    )


def latest_per_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Last row per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_row")).select(key, "_row.*")


def lowest_per_key(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """Row with the smallest value per key, the first one on ties."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(F.col(value), F.col(ordinal))).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*")


def join_key(ranked: DataFrame, key: DataFrame, required: bool = False) -> DataFrame:
    """Attach the private key; a missing one is labelled, or dropped when it is required."""
    kept = key.select("candidate_id", "label", "origin", "provenance")
    if required:
        return ranked.join(kept, "candidate_id")
    joined = ranked.join(kept, "candidate_id", "left")
    return joined.fillna({"label": "missing_key", "origin": "", "provenance": ""})


def missing_keys(ranked: DataFrame, key: DataFrame) -> DataFrame:
    return ranked.join(key.select("candidate_id"), "candidate_id", "left_anti")


def first_members(ranked: DataFrame, members: DataFrame, n: int, key: str = "sequence") -> DataFrame:
    """The first n ranked positives whose `key` is in a set."""
    kept = ranked.where(is_positive()).join(members.select(key).distinct(), key, "left_semi")
    return kept.orderBy("rank").limit(n)


def shortlist(ranked: DataFrame, n: int, only: str | None = None) -> DataFrame:
    """First n ranked rows that are neither positives nor decoys."""
    rows = ranked.where(~is_positive() & ~is_matched())
    if only:
        rows = rows.where(F.col("label") == only)
    return rows.orderBy("rank").limit(n)


def weight_per_key(weights: DataFrame, key: str = "sequence") -> DataFrame:
    """Largest weight of each key, at least 1."""
    return weights.groupBy(key).agg(F.greatest(F.lit(1.0), F.max("weight")).alias("weight"))


def training_merge(keys: DataFrame, weights: DataFrame, per_positive: int, seed: str = "train") -> DataFrame:
    """One training row per string: positives win, then the heavier weight; negatives are sampled.

    All matched decoys stay. Digest background is cut to half of `per_positive` rows per
    positive and random background to all of it, both in digest order.
    """
    weighted = keys.join(weight_per_key(weights), "sequence", "left").select(
        "sequence", "label", F.when(is_positive(), F.coalesce("weight", F.lit(1.0))).otherwise(F.lit(1.0)).alias("weight")
    )
    order = {label: i for i, label in enumerate((*POSITIVE_LABELS, MATCHED_LABEL, *NEGATIVE_LABELS[1:]))}
    choice = F.lit(len(order))
    for label, place in order.items():
        choice = F.when(F.col("label") == label, F.lit(place)).otherwise(choice)
    first = F.struct(
        F.when(is_positive(), F.lit(0)).otherwise(F.lit(1)).alias("negative"),
        (-F.col("weight")).alias("minus_weight"), choice.alias("place"), F.col("label").alias("label"),
    )
    merged = materialize(weighted.groupBy("sequence").agg(F.min(first).alias("first")).select(
        "sequence", "first.label", (-F.col("first.minus_weight")).alias("weight")
    ))
    background = merged.where(~is_positive() & ~is_matched())
    drawn = hash_uniform(F.concat_ws(":", F.lit(seed), F.col("sequence")))
    numbered = global_rank(background.withColumn("_draw", drawn), ["label"], [F.col("_draw"), F.col("sequence")])
    quota = merged.where(is_positive()).agg(
        (F.greatest(F.lit(1), F.count(F.lit(1))) * F.lit(per_positive)).alias("_quota")
    )
    allowed = F.when(F.col("label") == "digestome_background", F.floor(F.col("_quota") / F.lit(2)))
    allowed = allowed.otherwise(F.col("_quota"))
    sampled = numbered.crossJoin(F.broadcast(quota)).where(F.col("rank") <= allowed)
    kept = merged.where(is_positive() | is_matched())
    return kept.unionByName(sampled.select("sequence", "label", "weight"))


def scoring_panel(ranked: DataFrame, top: int, sampled: int, seed: str = "panel") -> DataFrame:
    """All positives and matched decoys, background among the `top` ranks, and a sample of the rest."""
    inside = is_positive() | is_matched()
    group = (
        F.when(inside, "matched_eval")
        .when(F.col("rank") <= top, "top_background")
        .otherwise("random_background_probe")
    )
    grouped = ranked.withColumn("scenario_group", group)
    rest = grouped.where(F.col("scenario_group") == "random_background_probe")
    drawn = hash_uniform(F.concat_ws(":", F.lit(seed), F.col("candidate_id").cast("string")))
    probe = rest.withColumn("_draw", drawn).orderBy("_draw", "candidate_id").limit(sampled).drop("_draw")
    return grouped.where(F.col("scenario_group") != "random_background_probe").unionByName(probe)


def role_panel(ranked: DataFrame, anchors: Column, most: int, per_positive: int, longest: int) -> DataFrame:
    """Anchors, then best-ranked positives up to `most`; then `per_positive` decoys for each."""
    short = ranked.where(F.col("length") <= longest)
    first = F.when(anchors, F.lit(0)).otherwise(F.lit(1))
    positives = short.where(is_positive()).orderBy(first, "rank").limit(most)
    positives = positives.withColumn("panel_role", F.lit("positive"))
    chosen = positives.agg(F.count(F.lit(1)).alias("_n"))
    decoys = short.where(is_matched()).join(positives.select("sequence"), "sequence", "left_anti")
    best = decoys.orderBy("rank").limit(most * per_positive)
    numbered = global_rank(best, [], [F.col("rank")], "_place")
    wanted = numbered.crossJoin(F.broadcast(chosen)).where(F.col("_place") <= F.col("_n") * per_positive)
    decoys = wanted.drop("_place", "_n").withColumn("panel_role", F.lit("hard_matched_decoy"))
    return positives.unionByName(decoys)


def consensus(lists: DataFrame) -> DataFrame:
    """Merge ranked lists of several models into one row per string."""
    distance = F.coalesce("nearest_distance", F.lit(999999))
    named = F.concat_ws(":", F.col("model_id"), F.col("mutations"))
    filled = F.nullif(F.col("nearest"), F.lit(""))
    joined = lambda name: F.array_join(F.array_sort(F.collect_set(F.col(name).cast("string"))), ";")
    return lists.groupBy("sequence").agg(
        F.count_distinct("model_id").alias("models_present"),
        joined("model_id").alias("model_ids"),
        F.avg("rank").alias("mean_rank"),
        F.min("rank").alias("best_rank"),
        F.avg("score").alias("mean_score"),
        F.avg("delta").alias("mean_delta"),
        joined("parent").alias("parents"),
        joined("edit_count").alias("edit_counts"),
        F.array_join(F.array_sort(F.collect_list(named)), ";").alias("mutations_by_model"),
        F.min_by(filled, F.when(filled.isNotNull(), F.struct(distance, F.col("model_id")))).alias("nearest"),
        F.min(distance).alias("nearest_distance"),
        joined("flag").alias("flags"),
    )


def rank_consensus(rows: DataFrame, n: int) -> DataFrame:
    best = rows.orderBy(F.desc("models_present"), "mean_rank", F.desc("mean_delta"), "sequence").limit(n)
    order = [F.desc("models_present"), F.col("mean_rank"), F.desc("mean_delta"), F.col("sequence")]
    return global_rank(best, [], order, "consensus_rank")
