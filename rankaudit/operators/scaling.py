"""Percentile, min-max and z scaling of score components in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import tied_positions


def percentile(df: DataFrame, by: list[str], value: str = "score", constant: float = 0.0) -> DataFrame:
    """Replace `value` by (average rank - 1) / (n - 1) in its group.

    A group with a single distinct value gets `constant`: 0 for whole components,
    0.5 inside length buckets.
    """
    positions = tied_positions(df, by, value)
    flat = F.col("peers") == F.col("group_size")
    scaled = (F.col("avg_rank") - F.lit(1.0)) / F.greatest(F.lit(1.0), F.col("group_size") - F.lit(1.0))
    table = positions.select(*by, value, F.when(flat, F.lit(constant)).otherwise(scaled).alias("_pct"))
    joined = df.join(table, [*by, value])
    return joined.withColumn(value, F.col("_pct")).drop("_pct")


def length_percentile(df: DataFrame, by: list[str], value: str = "score", length: str = "length") -> DataFrame:
    return percentile(df, [*by, length], value, constant=0.5)


def _close(low: Column, high: Column) -> Column:
    """Equal up to a relative 1e-9."""
    return F.abs(high - low) <= F.lit(1e-9) * F.greatest(F.abs(low), F.abs(high))


def minmax_value(value: Column, low: Column, high: Column) -> Column:
    flat = _close(low, high)
    return F.when(flat, F.lit(0.5)).otherwise((value - low) / F.when(~flat, high - low))


def minmax_fit(df: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    bounds = [F.min(value).alias(f"{prefix}low"), F.max(value).alias(f"{prefix}high")]
    return df.groupBy(*by).agg(*bounds) if by else df.agg(*bounds)


def attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Join fitted statistics; without keys `stats` is one row."""
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))


def minmax(df: DataFrame, by: list[str], value: str, name: str | None = None) -> DataFrame:
    joined = attach(df, minmax_fit(df, by, value, "_"), by)
    scaled = minmax_value(F.col(value), F.col("_low"), F.col("_high"))
    return joined.withColumn(name or value, scaled).drop("_low", "_high")


def length_z_fit(df: DataFrame, by: list[str], value: str, length: str = "length") -> tuple[DataFrame, DataFrame]:
    """Mean and population sd per (group, length), and per group as the fallback."""
    stats = [F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")]
    per_length = df.groupBy(*by, length).agg(*stats)
    overall = [F.avg(value).alias("_all_mean"), F.stddev_pop(value).alias("_all_sd")]
    per_group = df.groupBy(*by).agg(*overall) if by else df.agg(*overall)
    return per_length, per_group


def length_z_apply(
    df: DataFrame, fit: tuple[DataFrame, DataFrame], by: list[str], value: str, name: str, length: str = "length"
) -> DataFrame:
    """(value - mean) / sd of the length; unseen lengths use the group, zero sd falls back to it, then to 1."""
    per_length, per_group = fit
    joined = attach(df.join(per_length, [*by, length], "left"), per_group, by)
    group_sd = F.coalesce(F.nullif(F.col("_all_sd"), F.lit(0.0)), F.lit(1.0))
    center = F.coalesce(F.col("_mean"), F.col("_all_mean"))
    scale = F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), group_sd)
    return joined.withColumn(name, (F.col(value) - center) / scale).drop("_mean", "_sd", "_all_mean", "_all_sd")


def length_z(df: DataFrame, by: list[str], value: str, name: str, length: str = "length") -> DataFrame:
    return length_z_apply(df, length_z_fit(df, by, value, length), by, value, name, length)
