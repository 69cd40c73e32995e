"""How the given tables stand in for the engine's inputs. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import candidate_id, sorted_letters
from ..session import spread

NAMESPACE = "rankaudit-v1"
#: Lengths that the builders of panels, decoys and universes take; the loaders take every word.
SHORTEST, LONGEST = 2, 12

#: Accented letters and the base letters that stand for them.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõøúùûüýÿßœæÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝŒÆ"
BASE_LETTERS = "aaaaaaceeeeiiiinoooooouuuuyysoaAAAAAACEEEEIIIINOOOOOOUUUUYOA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_letters(text: Column) -> Column:
    return F.translate(text, ACCENTED, BASE_LETTERS)


def letters_only(text: Column) -> Column:
    """Upper-case words over A-Z; accents are folded, everything else is stripped before upper-casing."""
    return F.trim(F.upper(F.regexp_replace(base_letters(text), "[^A-Za-z]+", " ")))


def sized(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Words of the lengths that a builder takes."""
    return words.where(F.length("sequence").between(shortest, longest))


def to_residues(words: Column) -> Column:
    """Map the six letters outside the residue alphabet onto it."""
    return F.translate(words, "BJOUXZ", "DLPCAE")


def raw_words(df: DataFrame, *keep: str) -> DataFrame:
    word = F.explode(F.split(letters_only(F.col("text")), " ")).alias("word")
    return df.select(*keep, word).where(F.col("word") != "")


def raw_word_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Like `raw_words`, with the place of the word in its text."""
    return df.select(*keep, F.posexplode(F.split(letters_only(F.col("text")), " ")).alias("place", "word")).where(F.col("word") != "")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct residue strings of `documents` with their first document and occurrence count."""
    words = raw_words(table(spark, sf_dir, "documents"), "doc_id")
    mapped = words.select("doc_id", to_residues(F.col("word")).alias("sequence"))
    return mapped.groupBy("sequence").agg(F.min("doc_id").alias("min_doc_id"), F.count(F.lit(1)).alias("n"))


def panel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct residue strings of `benchmark`: the panel of positives."""
    words = raw_words(table(spark, sf_dir, "benchmark"), "item_id")
    mapped = words.select("item_id", to_residues(F.col("word")).alias("sequence"))
    return mapped.groupBy("sequence").agg(F.min("item_id").alias("item_id"))


def prior_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue strings of `conversations`, one exclusion panel per role."""
    words = raw_words(table(spark, sf_dir, "conversations"), "role")
    mapped = words.select(F.col("role").alias("panel"), to_residues(F.col("word")).alias("sequence"))
    return mapped.distinct()


def keyed_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document strings plus the panel, labelled.

    Panel strings are positives, whether they occur in a document or are added; anagrams of
    a panel string are matched decoys; the rest is background.
    """
    found = document_words(spark, sf_dir)
    panel = panel_words(spark, sf_dir)
    joined = found.join(panel, "sequence", "full_outer")
    anagrams = panel.groupBy(sorted_letters(F.col("sequence")).alias("letters")).agg(F.min("sequence").alias("parent"))
    marked = joined.withColumn("letters", sorted_letters(F.col("sequence"))).join(anagrams, "letters", "left")
    in_panel, in_documents = F.col("item_id").isNotNull(), F.col("min_doc_id").isNotNull()
    label = (
        F.when(in_panel & in_documents, "digestome_known_positive")
        .when(in_panel, "known_positive")
        .when(F.col("parent").isNotNull(), "matched_decoy")
        .otherwise("digestome_background")
    )
    origin = (
        F.when(in_panel & ~in_documents, F.concat(F.lit("benchmark:"), F.col("item_id")))
        .when(~in_panel & F.col("parent").isNotNull(), F.concat(F.lit("composition_shuffle:"), F.col("parent")))
        .otherwise(F.concat(F.lit("documents:"), F.col("min_doc_id")))
    )
    return marked.select(
        candidate_id(F.col("sequence"), NAMESPACE).alias("candidate_id"),
        "sequence", F.length("sequence").alias("length"), label.alias("label"), origin.alias("origin"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long residue string per document."""
    text = F.upper(F.regexp_replace(base_letters(F.col("text")), "[^A-Za-z]", ""))
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return documents.select(
        F.col("doc_id").alias("accession"), F.col("source").alias("source_class"), to_residues(text).alias("sequence")
    )


COMPONENTS = tuple(f"c{i:02d}" for i in range(1, 11))


def wide_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten score components of every vector: eight plain, one with many ties, one constant."""
    e = F.col("embedding")
    label = (
        F.when(F.col("label") == 0, "known_positive")
        .when(F.col("label").between(1, 4), "matched_decoy")
        .otherwise("random_background")
    )
    columns = {f"c{i:02d}": e[i - 1].cast("double") for i in range(1, 9)}
    columns["c09"] = F.rint(e[8].cast("double") * 10.0) / 10.0
    columns["c10"] = F.lit(0.0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("candidate_id"),
        F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("sequence"),
        (F.lit(2) + F.col("vec_id") % 11).cast("int").alias("length"),
        label.alias("label"),
        *[c.alias(name) for name, c in columns.items()],
    )


KEYS = ["candidate_id", "sequence", "length", "label"]


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the component table."""
    return wide_components(spark, sf_dir).unpivot(KEYS, list(COMPONENTS), "component", "score")


def grouped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores with the parent group that a vector belongs to."""
    wide = wide_components(spark, sf_dir)
    return wide.select(
        "candidate_id", "sequence", "length", "label",
        (F.col("candidate_id") % 50).alias("parent"),
        F.col("c01").alias("s1"), F.col("c02").alias("s2"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text potency notes, one per event."""
    v = F.col("value").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("Reported IC50 "), v, F.lit(" uM after digestion")))
        .when(kind == "view", F.concat(F.lit("IC50 of "), v, F.lit(" mg per mL for the synthesis product")))
        .when(kind == "purchase", F.concat(F.lit("IC50 from "), v, F.lit("-"), (F.col("value") + 10.0).cast("string"), F.lit(" mM")))
        .when(kind == "signup", F.concat(v, F.lit(" percent ACE inhibition")))
        .otherwise(F.lit("activity seen in a hydrolysate"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", text.alias("notes"),
        F.when(kind == "view", "chemical synthesis").otherwise("fermentation").alias("context"),
    )


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potency export rows: untranslated document words per source, with free-text potencies."""
    words = raw_words(table(spark, sf_dir, "documents"), "doc_id", "source")
    counted = words.groupBy("word", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("id"))
    n, last = F.col("n").cast("string"), F.substring("word", -1, 1)
    potency = (
        F.when(last.isin("A", "E", "I"), F.concat(n, F.lit(" uM")))
        .when(last.isin("N", "S"), F.concat(n, F.lit(".5 mM")))
        .when(last == "T", F.concat(n, F.lit(" mg/ml")))
        .when(last == "D", F.concat(n, F.lit(" ug/ml")))
        .when(last == "R", F.concat(n, F.lit(" %")))
        .otherwise(F.lit("ND"))
    )
    mass = F.when(last == "D", "").otherwise((F.length("word") * 110).cast("string"))
    return counted.select(F.col("word").alias("sequence"), "source", "id", potency.alias("ic50"), mass.alias("molwt"))
