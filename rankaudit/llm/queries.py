"""One query for each operator of this subpackage, over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, conversation_repair, external_shuffle, feast_whitening, jaccard_join, lattice_model, line_bitmaps, piece_lattice, positional_index, rank_profiles, substrings, token_files, toxicity
from .common import table
from .oracles import ORACLE  # noqa: F401

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, written to framed files and read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest, docs.schema["doc_id"].dataType).withColumnRenamed("id", "doc_id")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of ten words of a benchmark item."""
    found = positional_index.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near matches of every document: windows of ten words of a benchmark item whose terms all lie within two words of their place.

    n_near counts pairs of a window and a place of its rarest term; an exact occurrence is one of them. only_near tells documents
    without an exact one.
    """
    found = positional_index.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=positional_index.SLOP)
    near = found.withColumn("near", F.filter("matches", lambda m: m["kind"] == "near"))
    names = F.array_distinct(F.flatten(F.transform("near", lambda m: m["items"])))
    near = near.withColumn("names", F.array_sort(F.transform(names, lambda x: x.cast("string"))))
    return near.select(
        "doc_id", "n_words", F.size("near").cast("bigint").alias("n_near"), F.size("names").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), ((F.size("near") > 0) & (F.col("n_hit") == 0)).alias("only_near"),
    )


@query
def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of a random permutation; row counts are at most one apart."""
    mixed = external_shuffle.shuffled_buckets(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    narrow = mixed.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), "_bucket", "_place")
    return external_shuffle.shards(narrow, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies up to white space: which row stays, for every document."""
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


def remainder(n: int):
    """crc32 of doc_id as text modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document, learnt from three quarters of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_model(docs, labels, remainder(4) != 2)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op6_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by out-of-place distance, learnt from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    found = rank_profiles.predict_languages(docs, remainder(5) != 0)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 35 words found elsewhere cover."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document over all segmentations into pieces, and the add-half word unigram."""
    import public_tokenizers

    scored = lattice_model.score_texts(table(spark, sf_dir, "documents"), remainder(5) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op1_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document by the best path through its lattice; the digest is of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = piece_lattice.encode(table(spark, sf_dir, "documents"), path, decoded="text")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("text", 256).alias("text_sha256")
    )


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.85 or more of four-word shingles."""
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"))


@query
def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that three documents or more share and a larger doc_id keeps; the digest is of the text that the bitmap leaves."""
    found = line_bitmaps.keep_bitmaps(table(spark, sf_dir, "documents"), with_text=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after planted damage, and its cheapest repair."""
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.with_digests(rows, conversation_repair.plan_repairs(rows)).withColumnRenamed("conv", "conv_id")


@query
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight principal components of the whole table, scaled to unit variance; a deviation beyond a long is null."""
    found = feast_whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
