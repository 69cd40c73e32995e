"""Contact geometry of atom groups around a centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import euclidean, triangular
from .scaling import attach, minmax_fit
from .metrics import separation


def contact_geometry(atoms: DataFrame, center: tuple[float, float, float], near: float = 3.2) -> DataFrame:
    """Minimum distance per atom class and counts within `near`, per pose; hydrogens are ignored.

    The last residue of a pose is found by a combined maximum and joined back, one row per
    pose, so no pose is gathered in a window.
    """
    spot = tuple(F.lit(float(c)) for c in center)
    heavy = atoms.where(F.col("element") != "H").withColumn(
        "d", euclidean((F.col("x"), F.col("y"), F.col("z")), spot)
    )
    ends = heavy.groupBy("pose").agg(F.max("residue_number").alias("_last"))
    joined = heavy.join(ends, "pose")
    polar = F.col("element").isin("O", "N", "S")
    oxygen = F.col("element") == "O"
    terminal = oxygen & F.col("name").isin("O", "OXT") & (F.col("residue_number") == F.col("_last"))
    return joined.groupBy("pose").agg(
        F.min("d").alias("min_heavy"),
        F.min(F.when(polar, F.col("d"))).alias("min_polar"),
        F.min(F.when(oxygen, F.col("d"))).alias("min_oxygen"),
        F.min(F.when(terminal, F.col("d"))).alias("min_terminal_oxygen"),
        F.count_if(polar & (F.col("d") <= near)).alias("polar_near"),
        F.count_if(oxygen & (F.col("d") <= near)).alias("oxygen_near"),
        F.count_if(terminal).alias("terminal_oxygens"),
    )


def contact_score(distance: Column) -> Column:
    return F.coalesce(triangular(distance, 2.3, 2.2), F.lit(0.0))


def _share(df: DataFrame, value: str) -> DataFrame:
    """Min-max share of a column over all rows; missing values give 0, a flat column 0.5."""
    joined = attach(df, minmax_fit(df, [], value, "_"), [])
    flat = F.col("_low") == F.col("_high")
    span = F.when(flat, F.lit(0.5)).otherwise((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    share = F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(span)
    return joined.withColumn(f"{value}_share", share).drop("_low", "_high")


def pose_scores(geometry: DataFrame, poses: DataFrame) -> DataFrame:
    """Combine contacts with affinities. `poses` has pose, role, length and affinity."""
    joined = poses.join(geometry, "pose", "left").withColumn("raw", -F.col("affinity"))
    joined = joined.withColumn("per_residue", F.col("raw") / F.nullif(F.col("length"), F.lit(0)))
    shared = _share(_share(joined, "raw"), "per_residue")
    scored = shared.withColumns(
        {"contact": contact_score(F.col("min_polar")), "terminal_contact": contact_score(F.col("min_terminal_oxygen"))}
    )
    combined = (
        F.lit(0.35) * F.col("terminal_contact") + F.lit(0.25) * F.col("contact")
        + F.lit(0.25) * F.col("raw_share") + F.lit(0.15) * F.col("per_residue_share")
    )
    status = F.when(F.col("min_heavy").isNotNull(), "ok").otherwise("missing_pose_atoms")
    return scored.withColumns({"pose_score": combined, "status": status})


def metric_table(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean per role and AUROC of positives against hard decoys, one row per metric."""
    long = scored.select("pose", "role", *[F.col(m).cast("double") for m in metrics]).unpivot(
        ["pose", "role"], metrics, "metric", "value"
    ).where(F.col("value").isNotNull())
    labelled = long.where(F.col("role").isin("positive", "hard_matched_decoy")).select(
        "metric", F.col("value").alias("score"),
        F.when(F.col("role") == "positive", "known_positive").otherwise("matched_decoy").alias("label"),
    )
    means = long.groupBy("metric").agg(
        F.avg(F.when(F.col("role") == "positive", F.col("value"))).alias("positive_mean"),
        F.avg(F.when(F.col("role") == "hard_matched_decoy", F.col("value"))).alias("decoy_mean"),
        F.count(F.lit(1)).alias("n"),
    )
    return means.join(separation(labelled, ["metric"]).select("metric", "auroc_matched"), "metric", "left")
