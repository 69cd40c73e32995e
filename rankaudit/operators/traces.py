"""Per-position traces and permutation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.features import run_score, run_score_kept, run_score_moved, side_charges
from ..functions.mathx import let
from ..functions.text import residue_values, residues
from ..session import spread
from .generate import attempts, shuffle


def property_trace(df: DataFrame, window: int = 5, ph: float = 6.8) -> DataFrame:
    """Smoothed hydropathy and side-chain charge per position, row-local.

    The centred mean shrinks at both ends; it is taken on arrays so no shuffle is needed.
    """
    letters = residues(F.col("sequence"))
    half = F.lit(max(1, window) // 2)
    valued = df.select(
        "sequence",
        residue_values(F.col("sequence"), fixed.HYDROPATHY).alias("_kd"),
        residue_values(F.col("sequence"), side_charges(ph)).alias("_charge"),
        letters.alias("_letters"),
    )
    size = F.size("_letters")

    def mean_around(values: str, i):
        first = F.greatest(F.lit(1), i - half)
        part = F.slice(F.col(values), first, F.least(size, i + half) - first + F.lit(1))
        return let(part, lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b) / F.size(p))

    rows = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            i.alias("position"),
            F.element_at("_letters", i).alias("residue"),
            mean_around("_kd", i).alias("hydropathy"),
            mean_around("_charge", i).alias("charge"),
        ),
    )
    return valued.where(F.length("sequence") > 0).select("sequence", F.inline(rows))


def shuffle_zscore(df: DataFrame, shuffles: int = 200, seed: str = "zscore") -> DataFrame:
    """Run score against its own shuffles: mean, population sd and z.

    Terms that only depend on the composition are computed once per string.
    Works on distinct strings. z is 0 when sd is 0 and NULL when sd is positive but not
    above 1e-6; a single residue has none. Partial sums keep the shuffle to one row per
    string and task.
    """
    strings = df.select("sequence").distinct().withColumn("score", run_score(F.col("sequence")))
    strings = strings.withColumn("_kept", run_score_kept(F.col("sequence")))
    key = F.concat_ws(":", F.lit(seed), F.col("sequence"), F.col("attempt").cast("string"))
    tried = attempts(spread(strings.where(F.length("sequence") > 1), "sequence"), shuffles)
    mixed = tried.withColumn("mixed", shuffle(F.col("sequence"), key))
    shuffled = mixed.withColumn("shuffled", run_score_moved(F.col("mixed"), F.col("_kept")))
    stats = shuffled.groupBy("sequence").agg(
        F.avg("shuffled").alias("shuffle_mean"), F.stddev_pop("shuffled").alias("shuffle_sd"),
        F.min("shuffled").alias("_low"), F.max("shuffled").alias("_high"),
    )
    joined = strings.drop("_kept").join(stats, "sequence", "left")
    z = (F.col("score") - F.col("shuffle_mean")) / F.when(F.col("shuffle_sd") > 1e-6, F.col("shuffle_sd"))
    flat = F.col("_low") == F.col("_high")
    return joined.select(
        "sequence", "score", "shuffle_mean",
        F.when(flat, F.lit(0.0)).otherwise(F.col("shuffle_sd")).alias("shuffle_sd"),
        F.when(flat, F.lit(0.0)).otherwise(z).alias("z_score"),
    )
