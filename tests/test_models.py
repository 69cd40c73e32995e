"""Models are measured on groups that took no part in their training."""

import random

from pyspark.sql import functions as F

from rankaudit.operators import models


def _rows(spark, seed, n):
    """Positives end in P; every string has two anagrams that do not."""
    draw = random.Random(seed)
    rows = {}
    for _ in range(n):
        body = "".join(draw.choice("ADEKLV") for _ in range(5))
        rows[body + "P"] = ("known_positive", "".join(sorted(body + "P")))
        for k in (1, 3):
            rows[body[:k] + "P" + body[k:]] = ("matched_decoy", "".join(sorted(body + "P")))
        other = "".join(draw.choice("ADEKLV") for _ in range(6))
        rows[other] = ("digestome_background", "".join(sorted(other)))
    return spark.createDataFrame([(s, x, g) for s, (x, g) in rows.items()], "sequence string, label string, letters string")


def test_held_out_groups_stay_whole_and_keep_their_share(spark):
    rows = _rows(spark, 1, 60)
    split = models.split_groups(rows, "letters").persist()
    assert split.count() == rows.count()
    assert split.groupBy("letters").agg(F.count_distinct("held_out").alias("n")).where("n > 1").count() == 0
    positives = split.where("label = 'known_positive'")
    share = positives.where("held_out").count() / positives.count()
    assert 0.1 < share < 0.3


def test_only_held_out_rows_are_scored_and_the_rule_is_learned(spark):
    rows = _rows(spark, 2, 60)
    scores = models.train_and_hold_out(rows, "letters", ["logistic_c1"]).persist()
    held = {r.sequence for r in models.split_groups(rows, "letters").where("held_out").collect()}
    assert {r.sequence for r in scores.collect()} == held
    board = models.leaderboard(scores.withColumn("length", F.length("sequence"))).first()
    assert board.model_id == "logistic_c1" and board.auroc_matched > 0.9


def test_training_rows_are_merged_once(spark):
    from rankaudit.operators import panels

    keys = spark.createDataFrame([("A", "known_positive"), ("B", "digestome_background"), ("C", "matched_decoy")], "sequence string, label string")
    rows = panels.training_merge(keys, keys.where("sequence = 'A'").selectExpr("sequence", "2.0D AS weight"), per_positive=4)
    assert {tuple(r) for r in rows.collect()} == {("A", "known_positive", 2.0), ("B", "digestome_background", 1.0), ("C", "matched_decoy", 1.0)}
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()
