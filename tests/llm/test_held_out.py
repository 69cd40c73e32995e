"""Quality on rows that the models have not seen, over the given tables."""

import pytest

pytest.importorskip("public_tokenizers")

from rankaudit.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
#: The smaller tables have too few toxic labels to learn from.
LABELLED_DIR = "/root/testdata/sf0.1"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_rank_profiles"](spark, SF_DIR).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{LABELLED_DIR}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = QUERIES["op4_toxicity"](spark, LABELLED_DIR).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert toxic and clean and wins / (len(toxic) * len(clean)) >= 0.95
