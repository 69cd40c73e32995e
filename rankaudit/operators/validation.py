"""Two-score fusion: weight curves, frozen weights, and parent-grouped repeated cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import round_to, sign_test
from ..session import materialize
from .metrics import cutoff, evaluate, is_matched, is_positive, separation
from .ordering import global_rank
from .scaling import length_z, length_z_apply, length_z_fit, minmax, minmax_fit, minmax_value

STEPS = 20


def weight_grid() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: i / F.lit(float(STEPS)))


def mix(weight: Column, a: str, b: str) -> Column:
    return weight * F.col(a) + (F.lit(1.0) - weight) * F.col(b)


def fusion_curve(panel: DataFrame, first: str, second: str, length_scaled: bool = False) -> DataFrame:
    """Metrics for every weight of the grid over positives and matched decoys, in one plan."""
    rows = panel.where(is_positive() | is_matched())
    scaled = minmax(rows, [], first, "_a")
    if length_scaled:
        scaled = minmax(length_z(scaled, [], second, "_z"), [], "_z", "_b")
    else:
        scaled = minmax(scaled, [], second, "_b")
    spread = scaled.withColumn("weight", F.explode(weight_grid()))
    scored = spread.select("weight", "sequence", "label", round_to(mix(F.col("weight"), "_a", "_b"), 9).alias("score"))
    return evaluate(scored, ["weight"], length=None)


def frozen_fusion(rows: DataFrame, first: str, second: str, weight: float) -> DataFrame:
    """w * minmax(a) + (1 - w) * minmax(length z of b), rounded to 10 for output."""
    scaled = minmax(rows, [], first, "first_norm")
    scaled = minmax(length_z(scaled, [], second, "length_z"), [], "length_z", "second_norm")
    return scaled.withColumn("score", round_to(mix(F.lit(weight), "first_norm", "second_norm"), 10))


def fold_of(group: Column, repeat: Column, folds: int, seed: str) -> Column:
    """Fold 1..folds from a digest, so every row of a group shares it and repeats differ."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), repeat.cast("string"), group.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(folds) + F.lit(1)).cast("int")


def stratified_folds(rows: DataFrame, group: str, repeats: int, folds: int, seed: str = "cv") -> DataFrame:
    """One row per (group, repeat) with its fold, so that whole groups are dealt out evenly by positives and size.

    Groups stand in falling order of positives, then rows, then the group itself; every run of
    `folds` groups goes to `folds` different folds, in the order of a keyed digest. So two folds
    differ by no more positives than the richest group has, and as soon as `folds` groups hold
    positives, so does every fold. A null group is a group. Only group sizes are ordered; a run
    is the largest window.
    """
    sizes = rows.groupBy(group).agg(F.count_if(is_positive()).alias("_positives"), F.count(F.lit(1)).alias("_rows"))
    placed = global_rank(sizes, [], [F.desc("_positives"), F.desc("_rows"), F.col(group)], "_place")
    runs = placed.withColumn("_run", F.floor((F.col("_place") - 1) / F.lit(folds)))
    spread = runs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.col("repeat").cast("string"), F.col("_place").cast("string")), 256)
    dealt = F.row_number().over(Window.partitionBy("repeat", "_run").orderBy("_draw"))
    # a last run of fewer groups starts at a drawn fold, or the first folds would always get its groups
    shift = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("repeat").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    fold = ((dealt - 1 + shift) % F.lit(folds) + 1).cast("int")
    return spread.withColumn("_draw", draw).select(group, "repeat", fold.alias("fold"))


def scenario_cv(
    rows: DataFrame, first: str, second: str, repeats: int, folds: int, seed: str = "cv", assigned: DataFrame | None = None
) -> DataFrame:
    """Cross-validation on stratified folds, with the second score raw and scaled by length: one row per scenario, repeat and fold.

    As in `grouped_cv`, scaling and weight come from the training folds. Weights are compared on
    training rows by AUROC; then the chosen weight and both scores alone are measured on the held-out
    rows: AUROC, average precision and positives in the first tenth (ties by sequence).
    """
    keys = ["scenario_id", "repeat", "fold"]
    assigned = materialize(stratified_folds(rows, "parent", repeats, folds, seed) if assigned is None else assigned)
    owned = assigned.select(F.col("parent").alias("_parent"), "repeat", F.col("fold").alias("_own"))
    plain = rows.select("parent", "label", "length", "sequence", first, second)
    spread = (
        plain.join(owned, F.col("parent").eqNullSafe(F.col("_parent")))
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn("held_out", F.col("_own") == F.col("fold"))
        .drop("_parent", "_own")
    )
    fitted = length_z_fit(spread.where(~F.col("held_out")), ["repeat", "fold"], second)
    scaled = length_z_apply(spread, fitted, ["repeat", "fold"], second, "_z")
    kinds = F.array(
        F.struct(F.lit("raw").alias("scenario_id"), F.col(second).cast("double").alias("_second")),
        F.struct(F.lit("length_z").alias("scenario_id"), F.col("_z").alias("_second")),
    )
    valued = scaled.withColumn("_kind", F.explode(kinds)).select("*", "_kind.*").drop("_kind")
    fit = valued.where(~F.col("held_out"))
    bounds = minmax_fit(fit, keys, first, "a_").join(minmax_fit(fit, keys, "_second", "b_"), keys)
    ready = materialize(valued.join(bounds, keys).select(
        *keys, "label", "sequence", "held_out",
        minmax_value(F.col(first), F.col("a_low"), F.col("a_high")).alias("_a"),
        minmax_value(F.col("_second"), F.col("b_low"), F.col("b_high")).alias("_b"),
    ))
    mixed = lambda df: df.withColumn("score", round_to(mix(F.col("weight"), "_a", "_b"), 9)).drop("_a", "_b")
    trained = separation(mixed(ready.where(~F.col("held_out")).withColumn("weight", F.explode(weight_grid()))), [*keys, "weight"])
    choice = F.max_by(F.struct("weight", "auroc_all"), F.struct(F.col("auroc_all"), -F.col("weight")))
    best = materialize(trained.groupBy(*keys).agg(choice.alias("_best")).select(
        *keys, F.col("_best.weight").alias("selected_weight"), F.col("_best.auroc_all").alias("train_auroc")
    ))
    kinds = F.array(*[
        F.struct(F.lit(n).alias("_kind"), w.alias("weight"))
        for n, w in (("", F.col("selected_weight")), ("first_", F.lit(1.0)), ("second_", F.lit(0.0)))
    ])
    tested = ready.where("held_out").join(best, keys).withColumn("_pick", F.explode(kinds)).select("*", "_pick.*").drop("_pick")
    by = [*keys, "_kind"]
    ranked = materialize(global_rank(mixed(tested).select(*by, "label", "sequence", "score"), by, [F.desc("score"), F.col("sequence")], total="n_rows"))
    tops = ranked.groupBy(*by).agg(F.count_if(is_positive() & (F.col("rank") <= cutoff(F.col("n_rows"), 10.0))).alias("top"))
    apart = separation(ranked, by).select(*by, "auroc_all", "ap_step").join(tops, by)
    of = lambda kind, column: F.max(F.when(F.col("_kind") == kind, F.col(column)))
    measured = apart.groupBy(*keys).agg(*[
        of(kind, column).alias(f"test_{kind}{name}")
        for kind in ("", "first_", "second_") for column, name in (("auroc_all", "auroc"), ("ap_step", "ap"), ("top", "top_10pct"))
    ])
    counted = ready.groupBy(*keys).agg(
        F.count_if(~F.col("held_out")).alias("train_rows"),
        F.count_if("held_out").alias("test_rows"),
        F.count_if(is_positive() & ~F.col("held_out")).alias("train_positives"),
        F.count_if(is_positive() & F.col("held_out")).alias("test_positives"),
    )
    return counted.join(best, keys).join(measured, keys)


def scenario_summary(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """`cv_summary` per scenario, with average precisions, first tenths and the sizes of the panel."""
    delta = F.col("test_auroc") - F.col("test_first_auroc")
    means = {
        "mean_selected_weight": "selected_weight", "mean_test_auroc": "test_auroc", "mean_first_auroc": "test_first_auroc",
        "mean_second_auroc": "test_second_auroc", "mean_test_ap": "test_ap", "mean_first_ap": "test_first_ap",
        "mean_second_ap": "test_second_ap", "mean_top_10pct": "test_top_10pct", "mean_first_top_10pct": "test_first_top_10pct",
    }
    summary = folds.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("fold_results"),
        *[F.avg(column).alias(name) for name, column in means.items()],
        F.median("selected_weight").alias("median_selected_weight"),
        F.coalesce(F.stddev_samp("test_auroc"), F.lit(0.0)).alias("sd_test_auroc"),
        F.avg(delta).alias("mean_delta"), F.median(delta).alias("median_delta"), F.count_if(delta > 0).alias("win_count"),
    )
    panel = rows.groupBy("parent").agg(F.count_if(is_positive()).alias("p"), F.count(F.lit(1)).alias("n")).agg(
        F.sum("p").alias("n_positive"), F.sum(F.col("n") - F.col("p")).alias("n_matched"), F.count(F.lit(1)).alias("n_groups")
    )
    return summary.crossJoin(F.broadcast(panel)).withColumns(
        {
            "win_rate": F.col("win_count") / F.col("fold_results"),
            "sign_test_p": F.expr(sign_test("win_count", "fold_results")),
        }
    )


def grouped_cv(
    rows: DataFrame, first: str, second: str, repeats: int, folds: int, seed: str = "cv", length_scaled: bool = True
) -> DataFrame:
    """Fit scaling and pick the weight on the training folds, score the held-out one.

    `rows` has parent, label, length, sequence and both scores. Every (repeat, fold) is a
    group key: rows are spread to the folds they train or test, and all fits, weights and
    AUROCs are grouped aggregates of one plan.
    """
    keys = ["repeat", "fold"]
    spread = (
        rows.select("parent", "label", "length", "sequence", first, second)
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        .withColumn("_own", fold_of(F.col("parent"), F.col("repeat"), folds, seed))
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn("held_out", F.col("_own") == F.col("fold"))
    )
    train = spread.where(~F.col("held_out"))
    valued = spread
    if length_scaled:
        valued = length_z_apply(spread, length_z_fit(train, keys, second), keys, second, "_z")
    else:
        valued = spread.withColumn("_z", F.col(second))
    fit = valued.where(~F.col("held_out"))
    bounds = minmax_fit(fit, keys, first, "a_").join(minmax_fit(fit, keys, "_z", "b_"), keys)
    scaled = valued.join(bounds, keys).select(
        *keys, "label", "sequence", "held_out",
        minmax_value(F.col(first), F.col("a_low"), F.col("a_high")).alias("_a"),
        minmax_value(F.col("_z"), F.col("b_low"), F.col("b_high")).alias("_b"),
    )
    graded = scaled.withColumn("weight", F.explode(weight_grid()))
    graded = graded.withColumn("score", round_to(mix(F.col("weight"), "_a", "_b"), 9))
    apart = separation(graded, [*keys, "held_out", "weight"])
    sizes = scaled.groupBy(*keys).agg(
        F.count_if(~F.col("held_out")).alias("train_rows"),
        F.count_if("held_out").alias("test_rows"),
        F.count_if(is_positive() & ~F.col("held_out")).alias("train_positives"),
        F.count_if(is_positive() & F.col("held_out")).alias("test_positives"),
    )
    trained = apart.where(~F.col("held_out"))
    choice = F.max_by(F.struct("weight", "auroc_all"), F.struct(F.col("auroc_all"), -F.col("weight")))
    best = trained.groupBy(*keys).agg(choice.alias("_best")).select(
        *keys, F.col("_best.weight").alias("selected_weight"), F.col("_best.auroc_all").alias("train_auroc")
    )
    tested = apart.where("held_out").select(*keys, "weight", "auroc_all", "ap_step")
    picked = tested.join(best, keys).groupBy(*keys).agg(
        F.max("selected_weight").alias("selected_weight"),
        F.max("train_auroc").alias("train_auroc"),
        F.max(F.when(F.col("weight") == F.col("selected_weight"), F.col("auroc_all"))).alias("test_auroc"),
        F.max(F.when(F.col("weight") == F.col("selected_weight"), F.col("ap_step"))).alias("test_ap"),
        F.max(F.when(F.col("weight") == 1.0, F.col("auroc_all"))).alias("test_first_auroc"),
        F.max(F.when(F.col("weight") == 0.0, F.col("auroc_all"))).alias("test_second_auroc"),
    )
    return sizes.join(picked, keys)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean, sample sd, median, wins and sign test over all folds of all repeats."""
    delta = F.col("test_auroc") - F.col("test_first_auroc")
    summary = folds.agg(
        F.count(F.lit(1)).alias("fold_results"),
        F.avg("selected_weight").alias("mean_selected_weight"),
        F.median("selected_weight").alias("median_selected_weight"),
        F.avg("test_auroc").alias("mean_test_auroc"),
        F.coalesce(F.stddev_samp("test_auroc"), F.lit(0.0)).alias("sd_test_auroc"),
        F.avg("test_first_auroc").alias("mean_first_auroc"),
        F.avg("test_second_auroc").alias("mean_second_auroc"),
        F.avg(delta).alias("mean_delta"),
        F.median(delta).alias("median_delta"),
        F.count_if(delta > 0).alias("win_count"),
        F.avg("test_ap").alias("mean_test_ap"),
    )
    return summary.withColumns(
        {
            "win_rate": F.col("win_count") / F.col("fold_results"),
            "sign_test_p": F.expr(sign_test("win_count", "fold_results")),
        }
    )
