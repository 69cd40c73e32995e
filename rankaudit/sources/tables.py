"""Delimited, JSON and parquet tables at the edge of the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_sequence

PANEL_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "sequence", "target", "activity_class", "source_material", "generation_context",
            "evidence_type", "reference_url", "notes",
        )
    ]
)
PUBLIC_SCHEMA = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("length", T.IntegerType()),
    ]
)
RECIPE_SCHEMA = T.StructType(
    [
        T.StructField("recipe_id", T.StringType()),
        T.StructField("gate_component", T.StringType()),
        T.StructField("rank_component", T.StringType()),
        T.StructField("gate_percent", T.DoubleType()),
        T.StructField("include_length_stratified_components", T.BooleanType()),
        T.StructField(
            "fusion_components",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("component_id", T.StringType()),
                        T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
                    ]
                )
            ),
        ),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, or headered CSV with a declared schema that fails on malformed rows."""
    if path.endswith(".csv"):
        if schema is None:
            return spark.read.csv(path, header=True)
        return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", multiLine=False)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Write a fixed list of columns; one that is absent becomes NULL."""
    picked = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    writer = df.select(*picked).write.mode(mode)
    writer.csv(path, header=True) if path.endswith(".csv") else writer.parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    panel = read_table(spark, path, PANEL_SCHEMA if path.endswith(".csv") else None)
    cleaned = panel.withColumn("sequence", clean_sequence(F.col("sequence")))
    return cleaned.where(F.col("sequence") != "")


def read_tsv_trimmed(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text whose header and cells are padded with blanks."""
    df = spark.read.csv(
        path, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    return df.toDF(*[c.strip() for c in df.columns])


def to_components(wide: DataFrame, source: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Wide scores to long (component, score) rows named `ml:<source>:<column>`."""
    values = [F.col(c).cast("double").alias(f"ml:{source}:{c}") for c in columns]
    return wide.select(*keys, *values).unpivot(keys, [f"ml:{source}:{c}" for c in columns], "component", "score")


def read_score_matrix(tables: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Align several wide score tables into one long component table."""
    keys = keys or ["candidate_id", "sequence"]
    meta = {"candidate_id", "sequence", "length", "label", "origin", "provenance"}
    parts = [
        to_components(df, name, [c for c in df.columns if c not in meta | set(keys)], keys) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def misaligned(tables: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Keys that are not in every table, with the tables that hold them."""
    keys = keys or ["candidate_id", "sequence"]
    tagged = [df.select(*keys).distinct().withColumn("_table", F.lit(name)) for name, df in tables.items()]
    seen = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(
        F.array_sort(F.collect_set("_table")).alias("tables")
    )
    return seen.where(F.size("tables") < len(tables))


def read_mode_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One folder per mode, found by partition discovery, as `mode:<name>` components."""
    df = spark.read.schema(schema).parquet(path)
    return df.withColumn("component", F.concat(F.lit("mode:"), F.col("mode"))).drop("mode")


def unscored(candidates: DataFrame, components: DataFrame, expected: int) -> DataFrame:
    """Candidates that lack one of the `expected` components."""
    counted = components.groupBy("candidate_id").agg(F.count_distinct("component").alias("_n"))
    joined = candidates.select("candidate_id").join(counted, "candidate_id", "left")
    return joined.where(F.coalesce("_n", F.lit(0)) < expected).select("candidate_id")


def union_tagged(tables: dict[str, DataFrame], name: str = "source") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(tag)) for tag, df in tables.items()])


def read_recipe(spark: SparkSession, path: str) -> DataFrame:
    """Recipe JSON as one row; a missing required key fails the read."""
    df = spark.read.schema(RECIPE_SCHEMA).json(path, multiLine=True)
    for key in ("recipe_id", "gate_component", "rank_component", "gate_percent"):
        df = df.where(F.assert_true(F.col(key).isNotNull(), F.lit(f"recipe lacks {key}")).isNull())
    return df


def recipe_weights(recipe: DataFrame) -> DataFrame:
    fusion = recipe.select(F.inline("fusion_components"))
    return fusion.select(F.col("component_id").alias("fusion_id"), F.explode("weights").alias("component", "weight"))


def load_recipe(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A recipe file as the settings and the weights that `fusion.apply_recipe` takes.

    Required keys are those of `read_recipe`; other keys are notes and are left aside. A fused
    component without a name, without weights, with a weight that is no number, or named twice
    raises ValueError. A recipe is one small document, so it is read to the driver.
    """
    rows = read_recipe(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows) or 'no'} recipes, not one")
    found = rows[0].asDict(recursive=True)
    settings = {key: found[key] for key in ("recipe_id", "gate_component", "rank_component", "gate_percent")}
    settings["include_length_ranks"] = bool(found["include_length_stratified_components"])
    weights, seen = [], set()
    for part in found["fusion_components"] or []:
        name = part["component_id"]
        if not name or name in seen:
            raise ValueError(f"fusion component named {name!r}: missing or repeated name")
        if not part["weights"] or any(w is None for w in part["weights"].values()):
            raise ValueError(f"fusion component {name} has no weights or one that is no number")
        seen.add(name)
        weights += [(name, component, weight) for component, weight in part["weights"].items()]
    return settings, spark.createDataFrame(weights, "fusion_id string, component string, weight double")


def load_fusion_weights(summary: DataFrame, weights: DataFrame, keep: int) -> DataFrame:
    """Weights of the first `keep` fusions of an ordered summary (`place`)."""
    first = summary.orderBy("place").limit(keep).select("fusion_id")
    return weights.join(first, "fusion_id", "left_semi")


def panel_name(path_column: Column) -> Column:
    """Short panel id from a file name: the last path part without prefix and extension."""
    stem = F.regexp_extract(path_column, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.translate(F.regexp_replace(stem, "^known-positive-", ""), "-", "_")
