"""Exact ranks and running totals without sending a whole group to one task.

Rows are range-partitioned on (group, order keys) and written once. The range sampler
balances on the full key, so neither a hot group nor a hot leading value fills one
partition. What remains is a small table of partition totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33
AT = _AT = "_at"
_PART, _BASE = "_part", "_base"


def _partition_number() -> Column:
    return F.shiftright(F.col(_AT), _ROW_BITS)


def ordered_parts(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows in global order across written partitions, with their position in `_at`."""
    keys = [F.col(c) for c in by] + order
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(placed.withColumn(_AT, F.monotonically_increasing_id()))


def _earlier_parts(by: list[str]):
    """Window over the table of partition totals: one row per (partition, group)."""
    return Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def part_offsets(rows: DataFrame, by: list[str], flag: Column | None = None) -> DataFrame:
    """One row per (partition, group): its first position, the rows before it, and group totals.

    With `flag` also the flagged rows before it and in the group. This table has as many rows
    as there are partitions and groups, whatever the number of rows.
    """
    counts = [F.min(_AT).alias("_first"), F.count(F.lit(1)).alias("_size")]
    counts.append((F.lit(0) if flag is None else F.count_if(flag)).cast("bigint").alias("_flagged"))
    sizes = rows.withColumn(_PART, _partition_number()).groupBy(_PART, *by).agg(*counts)
    group = Window.partitionBy(*by)
    before = lambda c: F.coalesce(F.sum(c).over(_earlier_parts(by)), F.lit(0))
    return sizes.select(
        _PART, *by, "_first",
        before("_size").alias(_BASE), F.sum("_size").over(group).alias("_rows"),
        before("_flagged").alias("_flag_base"), F.sum("_flagged").over(group).alias("_flags"),
    )


def _position(offsets_joined: DataFrame, name: str) -> DataFrame:
    return offsets_joined.withColumn(name, F.col(_BASE) + F.col(_AT) - F.col("_first") + F.lit(1))


_OFFSET_COLUMNS = ("_first", _BASE, "_rows", "_flag_base", "_flags")


def global_rank(
    df: DataFrame, by: list[str], order: list[Column], name: str = "rank", total: str | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size as `total`.

    The order should be total (end in a unique key), otherwise ties fall arbitrarily.
    """
    rows = ordered_parts(df, by, order)
    joined = rows.withColumn(_PART, _partition_number()).join(part_offsets(rows, by), [_PART, *by])
    ranked = _position(joined, name)
    if total:
        ranked = ranked.withColumn(total, F.col("_rows"))
    return ranked.drop(_AT, _PART, *_OFFSET_COLUMNS)


def flagged_ranks(rows: DataFrame, by: list[str], flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rank and running number of the flagged rows of `ordered_parts`, and totals per group.

    Only flagged rows are joined and numbered; the totals come from the offsets alone.
    """
    offsets = part_offsets(rows, by, flag)
    inside = Window.partitionBy(_PART, *by).orderBy(_AT)
    kept = rows.where(flag).withColumn(_PART, _partition_number()).join(offsets, [_PART, *by])
    kept = _position(kept, "rank").withColumn("hit", F.col("_flag_base") + F.row_number().over(inside))
    kept = kept.withColumns({"n_rows": F.col("_rows"), "n_positive": F.col("_flags")})
    totals = offsets.groupBy(*by).agg(F.max("_rows").alias("n_rows"), F.max("_flags").alias("n_positive"))
    return kept.drop(_AT, _PART, *_OFFSET_COLUMNS), totals


def rows_above(firsts: DataFrame, offsets: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many rows of its group stand before the row at `_at`, from the offsets of `part_offsets`."""
    joined = firsts.withColumn(_PART, _partition_number()).join(offsets, [_PART, *by])
    return joined.withColumn(name, F.col(_BASE) + F.col(_AT) - F.col("_first")).drop(_AT, _PART, *_OFFSET_COLUMNS)


def running_totals(df: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Add `cum_<c>` (inclusive) and `total_<c>` per group for every column in `sums`."""
    rows = ordered_parts(df, by, order).withColumn(_PART, _partition_number())
    parts = rows.groupBy(_PART, *by).agg(*[F.sum(c).alias(f"_part_{c}") for c in sums])
    for c in sums:
        before = F.coalesce(F.sum(f"_part_{c}").over(_earlier_parts(by)), F.lit(0))
        parts = parts.withColumn(f"_before_{c}", before)
        parts = parts.withColumn(f"total_{c}", F.sum(f"_part_{c}").over(Window.partitionBy(*by)))
    parts = parts.drop(*[f"_part_{c}" for c in sums])
    inside = Window.partitionBy(_PART, *by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_inside_{c}": F.sum(c).over(inside) for c in sums})
    joined = rows.join(parts, [_PART, *by])
    joined = joined.withColumns({f"cum_{c}": F.col(f"_before_{c}") + F.col(f"_inside_{c}") for c in sums})
    helpers = [f"_before_{c}" for c in sums] + [f"_inside_{c}" for c in sums]
    return joined.drop(_AT, _PART, *helpers)


def tied_positions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per distinct (group, value): peers, average rank from the bottom, group size.

    Equal values are combined before anything is ordered, so a value held by a third of
    all rows is a single row here.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("peers"))
    run = running_totals(counted, by, [F.col(value)], ["peers"])
    average = F.col("cum_peers") - (F.col("peers") - F.lit(1)) / F.lit(2.0)
    return run.select(*by, value, "peers", average.alias("avg_rank"), F.col("total_peers").alias("group_size"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Add the tie-averaged rank of `value` within its group."""
    positions = tied_positions(df, by, value).select(*by, value, F.col("avg_rank").alias(name))
    return df.join(positions, [*by, value])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """Best n rows of every group; the limit is pushed below the shuffle by the window-limit rule."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
