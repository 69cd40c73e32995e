"""Blind scoring of candidates that arrive as files; the same column job as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import score_modes
from ..sources.tables import PUBLIC_SCHEMA


def arriving_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PUBLIC_SCHEMA).parquet(path)


def score_arrivals(candidates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the mode scores of new candidates to `out`, then stop. Ranks stay a batch job."""
    writer = score_modes(candidates).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
