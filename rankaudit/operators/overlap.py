"""Overlap, exclusion and rejection between collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_canonical, length_between, sorted_set


def overlaps(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidate strings that occur in an excluded panel, with the panels as a sorted list.

    Panels are combined per string before the join, so each side is one row per string.
    """
    panels = excluded.groupBy("sequence").agg(sorted_set(F.col("panel")).alias("panels"))
    return candidates.select("sequence").distinct().join(panels, "sequence")


def overlap_audit(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: sizes, overlap count and pass or fail."""
    panels = excluded.groupBy("sequence").agg(F.lit(1).alias("seen"))
    joined = candidates.select("sequence").distinct().join(panels, "sequence", "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("candidate_count"), F.coalesce(F.sum("seen"), F.lit(0)).alias("overlap_count")
    )
    sizes = excluded.agg(
        F.count_distinct("sequence").alias("excluded_count"), F.count_distinct("panel").alias("panel_count")
    )
    status = F.when(F.col("overlap_count") == 0, "pass").otherwise("fail").alias("status")
    return counted.crossJoin(F.broadcast(sizes)).select("*", status)


def without(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    return candidates.join(blocked.select("sequence").distinct(), "sequence", "left_anti")


def reject_reason(
    sequence: Column, excluded: Column, potency: Column, shortest: int, longest: int, maximum: float | None
) -> Column:
    """First reason that applies; NULL means accepted."""
    reason = (
        F.when(~F.coalesce(is_canonical(sequence), F.lit(False)), "invalid_sequence")
        .when(~length_between(sequence, shortest, longest), "length_outside_range")
        .when(excluded, "excluded_eval_sequence")
        .when(potency.isNull(), "unparsed_ic50")
    )
    return reason if maximum is None else reason.when(potency > maximum, "above_max_ic50_um")


def with_reject_reason(
    raw: DataFrame, excluded: DataFrame, shortest: int, longest: int, maximum: float | None = None
) -> DataFrame:
    """Add `reason` to rows with `sequence` and `ic50_um`."""
    marks = excluded.select("sequence").distinct().withColumn("_excluded", F.lit(True))
    joined = raw.join(marks, "sequence", "left")
    hit = F.coalesce("_excluded", F.lit(False))
    reason = reject_reason(F.col("sequence"), hit, F.col("ic50_um"), shortest, longest, maximum)
    return joined.withColumn("reason", reason).drop("_excluded")
