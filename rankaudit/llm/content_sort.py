"""Exact dedup by sorting contents.

Sampled splitters range-partition the rows by the start of the normalised text, its digest and the
order within a group, so neither a common beginning nor a large group of copies fills one task. The
external sort places equal texts next to each other, and neighbours are compared in full. A group may
reach over several partitions; only the first and last run of a partition can, so those few are merged
by their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, arrow_schema, batches_of, store

WHITE = r"[\x20\x09-\x0D]+"
SPLITTER_CHARS = 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; the edges of the partition get a row with their text."""
    part, run, last, held = TaskContext.get().partitionId(), -1, None, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("_norm")
        same = [last is not None and norm[0].as_py() == last, *pc.equal(norm[1:], norm[:-1]).to_pylist()]
        runs = []
        for i, equal in enumerate(same):
            if not equal:
                run += 1
                if run == 0:
                    held[0] = (batch.column("_id")[i], batch.column("_chars")[i], norm[i])
                latest = i
            runs.append(run)
        if not all(same) and run:
            held = {0: held[0], run: (batch.column("_id")[latest], batch.column("_chars")[latest], norm[latest])}
        last = norm[n - 1].as_py()
        columns = {name: batch.column(name) for name in batch.schema.names if name != "_norm"}
        columns |= {
            "_part": pa.repeat(pa.scalar(part, pa.int32()), n), "_run": pa.array(runs, pa.int64()),
            "_head": pa.array([not x for x in same]), "_edge": pa.nulls(n, pa.string()),
        }
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
    for number, (key, chars, norm) in held.items():
        values = {"_id": key.as_py(), "_chars": chars.as_py(), "_part": part, "_run": number, "_edge": norm.as_py()}
        yield pa.RecordBatch.from_pylist([values], schema=schema)


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> Stored:
    """The sorted rows with their run (`_part`, `_run`), and a row with `_edge` for every run at an edge."""
    batches_of(docs.sparkSession)
    text = F.col(text_col)
    order = [F.desc("_chars"), F.asc_nulls_last("_id")]
    rows = docs.select(
        F.col(id_col).alias("_id"), F.length(F.coalesce(text, F.lit(""))).alias("_chars"), normalised(text).alias("_norm"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    ).withColumn("_sha", F.sha2("_norm", 256)).withColumn("_start", F.substring("_norm", 1, SPLITTER_CHARS))
    if text_col in carry:  # the text is moved once, and normalised again where it arrives
        rows = rows.drop("_norm")
    placed = rows.repartitionByRange("_start", "_sha", *order)
    if text_col in carry:
        placed = placed.withColumn("_norm", normalised(F.col(f"_c_{text_col}")))
    placed = placed.sortWithinPartitions("_start", "_sha", "_norm", *order).drop("_start")
    fields = [f for f in placed.schema.fields if f.name != "_norm"]
    fields += [T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()),
               T.StructField("_head", T.BooleanType()), T.StructField("_edge", T.StringType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = arrow_schema(schema)
    return store(placed.mapInArrow(lambda it: _runs(it, arrow), schema))


def merged_edges(runs: DataFrame) -> DataFrame:
    """For every edge run: size, keeper and the partition that holds it, over all runs of the same text."""
    sizes = runs.where(F.col("_edge").isNull()).groupBy("_part", "_run").agg(F.count(F.lit(1)).alias("_size"))
    edges = runs.where(F.col("_edge").isNotNull()).select("_part", "_run", "_edge", "_chars", "_id")
    edges = edges.join(sizes, ["_part", "_run"])
    best = F.min_by(F.struct("_id", "_part", "_run"), F.struct(-F.col("_chars"), F.col("_id").isNull(), "_id", "_part", "_run"))
    whole = edges.groupBy("_edge").agg(F.sum("_size").alias("_total"), best.alias("_best"))
    return edges.select("_part", "_run", "_edge").join(whole, "_edge").select("_part", "_run", "_total", "_best")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the id that stays for its text, group size, whether it stays, digest.

    Texts are equal when they match after deleting ASCII white space; null counts as empty. The row with
    the most characters stays, then the smallest id (null last); of rows alike in both, one. Repeated ids are
    separate rows. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    runs = sorted_runs(docs, id_col, text_col).df
    rows = runs.where(F.col("_edge").isNull())
    own = rows.groupBy("_part", "_run").agg(
        F.count(F.lit(1)).alias("_size"), F.max_by(F.struct("_id"), "_head").alias("_first")
    )
    known = own.join(merged_edges(runs), ["_part", "_run"], "left").select(
        "_part", "_run", F.coalesce("_total", "_size").alias("group_size"),
        F.when(F.col("_best").isNotNull(), F.col("_best._id")).otherwise(F.col("_first._id")).alias("keep_id"),
        (F.col("_best").isNull() | ((F.col("_best._part") == F.col("_part")) & (F.col("_best._run") == F.col("_run")))).alias("_here"),
    )
    return rows.join(known, ["_part", "_run"]).select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("_head") & F.col("_here")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; the same rule as `exact_groups`."""
    carry = tuple(docs.columns)
    runs = sorted_runs(docs, id_col, text_col, carry).df
    losing = merged_edges(runs).where((F.col("_best._part") != F.col("_part")) | (F.col("_best._run") != F.col("_run")))
    heads = runs.where(F.col("_edge").isNull() & F.col("_head"))
    kept = heads.join(losing.select("_part", "_run"), ["_part", "_run"], "left_anti")
    return kept.select(*[F.col(f"_c_{c}").alias(c) for c in carry])
