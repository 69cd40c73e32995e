"""The pipeline stage by stage: decisions take effect, columns stay."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir, small):
    df, rows = small
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    calm = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert calm.columns == docs.columns
    single = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    kept = sorted((k for k, *_, stays, _ in brute.exact(rows) if stays), key=repr)
    assert single.columns == docs.columns and sorted((k for k, _ in rows_of(single)), key=repr) == kept
    apart = corpus_pipeline.drop_near_copies(spark, single, sf_dir)
    left = brute.components(rows_of(single))
    assert sorted((k for k, _ in rows_of(apart)), key=repr) == sorted((k for k, _, c in left if k == c), key=repr)
    clean = corpus_pipeline.drop_leaks(spark, apart, sf_dir)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted((k for k, _ in rows_of(clean)), key=repr) == sorted((x[0] for x in brute.leaks(rows_of(apart), items) if not x[5]), key=repr)
    assert corpus_pipeline.encode_pieces(spark, clean, sf_dir).count() == clean.count()


def test_run(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.columns == ["doc_id", "n_pieces", "ids"] and 0 < done.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_near_copies_of_five_words(spark, sf_dir, small):
    word = lambda i: f"w{i}"
    base = [word(i) for i in range(100)]
    changed = lambda *at: " ".join("other" + w if i in at else w for i, w in enumerate(base))
    rows = [(1, changed()), (2, changed(20, 60)), (3, changed(20, 60, 80)), (4, changed(10, 30, 50, 70, 90))]
    rows += [(10, " ".join(map(word, range(200, 213)))), (11, " ".join(map(word, range(200, 212))) + " end"), (12, "w1 w2 w3 w4"), (13, "w1 w2 w3"), (14, None)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(small[1])]
    least = sorted(k for k, _, c in brute.components(rows, 80, 5) if k == c)
    assert least != sorted(k for k, _, c in brute.components(rows) if k == c)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(k for k, _ in rows_of(corpus_pipeline.drop_near_copies(spark, docs, sf_dir))) == least


def test_pieces_are_decoded_again(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(1, "plain words"), (1, "plain words"), (2, None), (3, ""), (None, " \u2581 marks\u2581and  spaces\n"), (4, "\u65e5\u672c\u8a9e \U0001f600 \u00e9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    encode = corpus_pipeline.piece_lattice.encode
    done = corpus_pipeline.encode_pieces(spark, docs, sf_dir)
    assert done.columns == ["doc_id", "n_pieces", "ids"]
    assert sorted((r["doc_id"] or 0, r["n_pieces"] > 0, len(r["ids"]) == r["n_pieces"]) for r in done.collect()) == [
        (0, True, True), (1, True, True), (1, True, True), (2, False, True), (3, False, True), (4, True, True)]
    cut = F.expr("slice(ids, 1, greatest(size(ids) - 1, 0))")
    monkeypatch.setattr(corpus_pipeline.piece_lattice, "encode", lambda *a, **b: encode(*a, **b).withColumn("ids", cut))
    with pytest.raises(Exception, match="do not decode"):
        corpus_pipeline.encode_pieces(spark, docs, sf_dir).collect()
