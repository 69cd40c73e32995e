"""Sharding by a two-pass external shuffle.

Pass one scatters records into buckets that fit in memory, by a seeded hash of the id. Pass two reads one
bucket at a time, applies a seeded Fisher-Yates shuffle and writes it. The shuffled buckets in order are one
random permutation of all records, which is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batches_of, store, total_bytes

BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1 that depends on seed and bucket only."""
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(1, n + 1))
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(batches: Iterator[pa.RecordBatch], schema: pa.Schema, seed: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Shuffle each bucket; the rows of a bucket arrive one after the other."""

    def finish(held: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        mixed = whole.take(pa.array(fisher_yates(whole.num_rows, seed, bucket)))
        mixed = mixed.append_column("_place", pa.array(np.arange(whole.num_rows), pa.int64()))
        yield from mixed.select(schema.names).cast(schema).to_batches(max_chunksize=rows)

    held, current = [], None
    for batch in batches:
        buckets = batch.column("_bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and buckets[a] != current:
                yield from finish(held, current)
                held = []
            current = int(buckets[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from finish(held, current)


def shuffled_buckets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows of `docs` as a written table in random order: its columns, `_bucket` and `_place`.

    `docs` is a stored table. Rows of one id meet in one bucket; ids with more rows than an average bucket,
    of which there can be no more than there are buckets, are scattered row by row instead.
    """
    spark = docs.sparkSession
    batches_of(spark)
    n, size = total_bytes(docs, text_col)
    buckets = max(1, -(-size // bucket_bytes))
    per_id = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    hot = [r[0] for r in per_id.where(F.col("_n") > max(1000, n // buckets)).select(id_col).collect()]
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    for value in hot:
        key = F.when(F.col(id_col).eqNullSafe(F.lit(value)), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).otherwise(key)
    placed = docs.withColumn("_bucket", F.pmod(key, F.lit(buckets)).cast("int"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    placed = placed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", F.col(id_col), crc)
    schema = T.StructType([*placed.schema.fields, T.StructField("_place", T.LongType())])
    arrow, rows = arrow_schema(schema), 1000
    return store(placed.mapInArrow(lambda it: _shuffled(it, arrow, seed, rows), schema)).df


def shards(shuffled: DataFrame, n_shards: int) -> DataFrame:
    """Add `shard` and `slot` to shuffled buckets: consecutive runs of the permutation, of equal length but for one row.

    The running offsets have one row per bucket, whatever the number of documents.
    """
    counts = shuffled.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        F.sum("_rows").over(Window.partitionBy(F.lit(1))).alias("_all"),
    )
    at = shuffled.join(offsets, "_bucket").withColumn("_at", F.col("_base") + F.col("_place"))
    small, longer = F.expr(f"_all div {n_shards}"), F.col("_all") % n_shards
    cut = longer * (small + 1)
    low = F.col("_at") < cut
    late = f"_all % {n_shards} + (_at - _all % {n_shards} * (_all div {n_shards} + 1)) div greatest(_all div {n_shards}, 1)"
    shard = F.when(low, F.expr(f"_at div (_all div {n_shards} + 1)")).otherwise(F.expr(late)).cast("int")
    start = F.when(low, F.col("shard") * (small + 1)).otherwise(cut + (F.col("shard") - longer) * small)
    return at.withColumn("shard", shard).withColumn("slot", (F.col("_at") - start).cast("bigint"))
