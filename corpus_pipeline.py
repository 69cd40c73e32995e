"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Each stage first deletes what earlier stages kept for themselves. Toxic documents go, then exact copies, then all but one document of each group of near copies, then documents that
hold passages of the benchmark; what is left is encoded in pieces, which are decoded again and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankaudit.llm import content_sort, jaccard_join, piece_lattice, positional_index, toxicity
from rankaudit.llm.common import release, store, table
from rankaudit.llm.queries import remainder

THRESHOLD = 0.3
#: Words of a shingle and hundredths of the Jaccard similarity for near copies; those of op9 hold for that query only.
NEAR_WORDS, NEAR_PERCENT = 5, 80
_KEY = "_pipeline_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows told apart by id and text, also where ids are null or recur."""
    return docs.withColumn(_KEY, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))


def _by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    other = keys.select(F.col(_KEY).alias("_other")).distinct()
    return docs.join(other, docs[_KEY].eqNullSafe(other["_other"]), how).drop(_KEY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold; null and empty texts stay, as they score like harmless ones."""
    release(docs)
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.score(docs, model).where(F.col("_score") < THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those with the same text up to white space; null and empty texts are one group."""
    release(docs)
    return content_sort.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group under links of similarity 0.8 or more of five-word shingles; texts without words stay."""
    release(docs)
    keyed = _keyed(docs)
    groups = jaccard_join.near_groups(keyed, _KEY, size=NEAR_WORDS, percent=NEAR_PERCENT)
    return _by_key(keyed, groups.where(F.col(_KEY).eqNullSafe(F.col("component_id"))), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a window of a benchmark item."""
    release(docs)
    keyed = _keyed(docs)
    found = positional_index.find_leaks(keyed, table(spark, sf_dir, "benchmark"), _KEY)
    return _by_key(keyed, found.where("n_hit > 0"), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left; no ids for null and empty texts.

    All ids are decoded again. A row whose ids do not spell its text (the mark U+2581 counts as a space) fails the stage.
    """
    release(docs)
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda text: F.xxhash64(F.coalesce(text, F.lit("")))
    keyed = docs.withColumn(_KEY, F.struct(F.col("doc_id").alias("id"), digest(F.translate("text", piece_lattice.MARK, " ")).alias("hash")))
    decoded = piece_lattice.decode(piece_lattice.encode(keyed, path, _KEY), path)
    same = digest(F.col("text")) == F.col(_KEY)["hash"]
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("the ids of a document do not decode to its text")))
    return decoded.select(F.col(_KEY)["id"].alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"), ids.alias("ids"))


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks), ("SentencePiece encoding", encode_pieces),
]

#: The trees, the components and the encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir)).df
    return docs
