"""Readers, writers, the streaming scorer and the driver contract."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from checks.oracle import ORACLE
from rankaudit.functions.scoring import score_modes
from rankaudit.operators import fusion
from rankaudit.plans.catalog import QUERIES
from rankaudit.sources import chained_hash, tables, text_files
from rankaudit.streaming.scoring import arriving_candidates, score_arrivals


def test_panel_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "panel.csv")
    df = spark.createDataFrame([(" v-pp ", "note"), ("123", "none")], "sequence string, notes string")
    tables.write_table(df, path, [f.name for f in tables.PANEL_SCHEMA])
    panel = tables.read_panel(spark, path)
    assert panel.columns == [f.name for f in tables.PANEL_SCHEMA]
    assert [(r.sequence, r.target, r.notes) for r in panel.collect()] == [("VPP", None, "note")]


def test_fasta_records_and_rejects(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|name x\nacd\nEF-G\n>empty\n\n>P2\nKK\r\nRR\r\n")
    good, bad = text_files.read_fasta(spark, str(tmp_path))
    assert {(r.accession, r.sequence) for r in good.collect()} == {("P1", "ACDEFG"), ("P2", "KKRR")}
    assert [r.accession for r in bad.collect()] == ["empty"]


def atom_line(serial, name, residue, x, y, z, kind):
    return f"ATOM  {serial:5d}  {name:<3s} GLY A{residue:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00     0.000 {kind}"


def test_fixed_width_atoms_first_model_only(spark, tmp_path):
    one = "\n".join([atom_line(1, "N", 1, 1.5, -2.25, 3.0, "NA"), atom_line(2, "OXT", 2, 0.0, 0.0, 9.125, "OA")])
    two = atom_line(9, "C", 7, 5.0, 5.0, 5.0, "C")
    (tmp_path / "p.pdbqt").write_text(f"REMARK x\nMODEL 1\n{one}\nENDMDL\nMODEL 2\n{two}\nENDMDL\n")
    rows = text_files.read_fixed_width_atoms(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(r.serial, r.name, r.residue_number, r.x, r.y, r.z, r.element) for r in rows] == [
        (1, "N", 1, 1.5, -2.25, 3.0, "N"), (2, "OXT", 2, 0.0, 0.0, 9.125, "O"),
    ]


def test_recipe_and_weights(spark, tmp_path):
    recipe = {
        "recipe_id": "r", "gate_component": "g", "rank_component": "c", "gate_percent": 1.5,
        "fusion_components": [{"component_id": "f", "weights": {"a": 0.5, "b": 0.25}}],
    }
    path = tmp_path / "recipe.json"
    path.write_text(json.dumps(recipe, indent=2))
    got = tables.read_recipe(spark, str(path))
    assert got.first().gate_percent == 1.5
    assert {(r.fusion_id, r.component, r.weight) for r in tables.recipe_weights(got).collect()} == {("f", "a", 0.5), ("f", "b", 0.25)}
    del recipe["gate_component"]
    path.write_text(json.dumps(recipe))
    with pytest.raises(Exception, match="recipe lacks gate_component"):
        tables.read_recipe(spark, str(path)).collect()


def test_mode_folders_and_completeness(spark, tmp_path):
    df = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 2.0), ("b", "m1", 3.0)], "candidate_id string, mode string, score double")
    df.write.partitionBy("mode").parquet(str(tmp_path / "scores"))
    long = tables.read_mode_scores(spark, str(tmp_path / "scores"), "candidate_id string, score double, mode string")
    assert {r.component for r in long.collect()} == {"mode:m1", "mode:m2"}
    assert [r.candidate_id for r in tables.unscored(df.select("candidate_id").distinct(), long, 2).collect()] == ["b"]


def test_tagged_union_and_panel_names(spark):
    df = spark.createDataFrame([("x",)], "sequence string")
    assert {r.source for r in tables.union_tagged({"a": df, "b": df}).collect()} == {"a", "b"}
    name = spark.range(1).select(tables.panel_name(F.lit("/d/known-positive-v4-main.csv")).alias("n")).first().n
    assert name == "v4_main"


def test_file_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = text_files.file_digests(spark, str(tmp_path), "*.bin").first()
    assert (row.bytes, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_large_files_are_hashed_span_by_span(spark, tmp_path, monkeypatch):
    """Files that may not be read whole have the same digests, whatever bytes they start and end with."""
    rng = random.Random(3)
    noise = rng.randbytes(300_000)
    contents = {
        "noise": noise, "feed at end": noise + b"\n", "mark": b"\xef\xbb\xbf" + noise, "mark,{2}%20": b"\xef\xbb\xbf" * 2 + noise + b"\n\n",
        "feeds": b"\n" * 30_000, "one line": b"\r\x00" * 20_000, "lines": b"caf\xc3\xa9\r\n" * 9_000, "small": b"abc\n",
    }
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    for name, content in contents.items():
        (folder / f"{name}.bin").write_bytes(content)
    (folder / "packed.bin.gz").write_bytes(gzip.compress(b"x" * 5000))
    monkeypatch.setattr(text_files, "WHOLE_BYTES", 20_000)
    monkeypatch.setattr(chained_hash, "SPAN_BYTES", 100_000)
    monkeypatch.setattr(chained_hash, "BLOCK_BYTES", 5_000)
    settings = {"spark.sql.sources.binaryFile.maxLength": "20000", "spark.sql.files.maxPartitionBytes": "40000"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in text_files.file_digests(spark, str(tmp_path)).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == {f.name: (len(c := f.read_bytes()), hashlib.sha256(c).hexdigest()) for f in folder.iterdir()}


def test_streaming_scores_equal_batch(spark, tmp_path):
    public = spark.createDataFrame([("1", "VPP", 3), ("2", "LKPNM", 5)], tables.PUBLIC_SCHEMA)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    public.write.parquet(source)
    score_arrivals(arriving_candidates(spark, source), out, str(tmp_path / "cp")).awaitTermination()
    public.withColumn("candidate_id", F.lit("3")).limit(1).write.mode("append").parquet(source)
    score_arrivals(arriving_candidates(spark, source), out, str(tmp_path / "cp")).awaitTermination()
    streamed = {(r.candidate_id, r.mode, r.score) for r in spark.read.parquet(out).collect()}
    assert streamed >= {(r.candidate_id, r.mode, r.score) for r in score_modes(public).collect()}
    assert len(streamed) == 18


def test_every_oracle_names_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize(
    "name", ["reject_reasons", "domain_features", "lenrank_components", "recovery_by_component", "nearest_neighbor_audit", "variants"]
)
def test_queries_match_oracle(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).sql(ORACLE[name]).df()) == "ok"


@pytest.mark.parametrize("name", ["fixed_width_scan", "training_tokens", "file_digests"])
def test_queries_without_oracle_return_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_compare_notices_differences():
    import pandas as pd

    a = pd.DataFrame({"k": ["x", "y"], "v": [0.1, None]})
    assert compare(a.copy(), a.iloc[::-1].copy()) == "ok"
    for changed in (a.assign(v=[0.100001, None]), a.assign(v=[0.1, 0.0]), a.assign(k=["x", "z"]), a.iloc[:1]):
        assert compare(a.copy(), changed.copy()) != "ok"


def test_recipe_file_reaches_settings_and_weights(spark, tmp_path):
    recipe = {
        "recipe_id": "r", "gate_component": "f", "rank_component": "lenrank:a", "gate_percent": 1.5, "status": "a note",
        "include_length_stratified_components": True,
        "fusion_components": [{"component_id": "f", "weights": {"a": 0.5, "lenrank:b": 0.25}}],
    }
    path = tmp_path / "recipe.json"
    path.write_text(json.dumps(recipe, indent=2))
    settings, weights = tables.load_recipe(spark, str(path))
    assert settings == {
        "recipe_id": "r", "gate_component": "f", "rank_component": "lenrank:a", "gate_percent": 1.5, "include_length_ranks": True,
    }
    assert {tuple(r) for r in weights.collect()} == {("f", "a", 0.5), ("f", "lenrank:b", 0.25)}
    components = spark.createDataFrame([("a",), ("b",)], "component string")
    fusion.check_recipe(components, settings, weights)
    with pytest.raises(ValueError, match="lenrank:b"):
        fusion.check_recipe(components, settings | {"include_length_ranks": False}, weights)
    with pytest.raises(ValueError, match="rank_component z"):
        fusion.check_recipe(components, settings | {"rank_component": "z"}, weights)
    for broken in ([{"component_id": "f"}], [{"weights": {"a": 1.0}}], recipe["fusion_components"] * 2):
        path.write_text(json.dumps(recipe | {"fusion_components": broken}))
        with pytest.raises(ValueError, match="fusion component"):
            tables.load_recipe(spark, str(path))
    path.write_text(json.dumps({k: v for k, v in recipe.items() if k != "fusion_components"}))
    assert tables.load_recipe(spark, str(path))[1].count() == 0
