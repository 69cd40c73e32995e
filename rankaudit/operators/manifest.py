"""Manifests, rank-list evaluation and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import cutoff, number_hits, rank_statistics, tag, with_enrichment


def row_digest(columns: list[str]) -> Column:
    """Order-insensitive share of one row in a table digest: 48 bits of its hash."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")


def manifest(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Row counts and digests per group, all as combined sums."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_digest(columns)).cast("decimal(38,0)").alias("digest")
    )


def evaluate_rank_list(ranks: DataFrame, by: list[str], percents: tuple[float, ...] = (1.0, 5.0, 10.0)) -> DataFrame:
    """Re-evaluate from positive ranks and the collection size `n_rows` alone."""
    numbered = number_hits(ranks.select(*by, "rank", "n_rows"), by)
    counts = [F.max("n_rows").alias("n_rows"), F.max("n_positive").alias("n_positive")]
    for percent in percents:
        inside = F.col("rank") <= cutoff(F.col("n_rows"), percent)
        counts.append(F.count_if(inside).alias(f"top_{tag(percent)}pct_count"))
    summary = numbered.groupBy(*by).agg(*counts, *rank_statistics(F.col("hit"), F.col("n_positive")))
    return with_enrichment(summary, percents)


def expect(summary: DataFrame, expected: dict[str, tuple[float | str, float]], loud: bool = False) -> DataFrame:
    """Compare the columns of a one-row table with (value, tolerance); `loud` raises on a miss.

    A value in text names another column of the table.
    """
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"), F.col(name).cast("double").alias("actual"),
                (F.col(value).cast("double") if isinstance(value, str) else F.lit(float(value))).alias("expected"), F.lit(float(tolerance)).alias("tolerance"),
            )
            for name, (value, tolerance) in expected.items()
        ]
    )
    met = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    rows = summary.select(F.inline(checks)).withColumn("met", met)
    if loud:
        rows = rows.where(F.assert_true(F.col("met"), F.concat(F.lit("expectation missed: "), "metric")).isNull())
    return rows
