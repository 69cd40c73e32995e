"""Weight searches without full ranks, random weight sets, stratified folds."""

import random

import pytest
from pyspark.sql import functions as F

from rankaudit.operators import fusion, validation
from rankaudit.operators.metrics import cutoff

ROW = "candidate_id string, length int, sequence string, label string, score double"


def scored_rows(n, seed, values):
    draw = random.Random(seed)
    label = lambda: draw.choice(["known_positive", "matched_decoy", "random_background", "random_background"])
    return [(f"x{i}", draw.randint(2, 4), f"s{i:05d}", label(), float(values(draw))) for i in range(n)]


def first_hits(rows, n):
    ordered = sorted(rows, key=lambda r: (-r[4], r[1], r[2]))
    return sum(r[3] == "known_positive" for r in ordered[:n])


@pytest.mark.parametrize(
    "values",
    [
        lambda d: d.random(),
        lambda d: 0.5 if d.random() < 0.7 else d.random(),
        lambda d: 0.25,
        lambda d: d.choice([-1.5, 0.0, 1.0, 300.0]),
    ],
)
def test_hits_at_cuts_equal_those_of_a_full_order(spark, values):
    groups = {"a": scored_rows(400, 1, values), "b": scored_rows(7, 2, values), "c": scored_rows(1, 3, values)}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "fusion_id string, " + ROW)
    cuts = {"one": cutoff(F.col("n_rows"), 1.0), "ten": cutoff(F.col("n_rows"), 10.0), "beyond": F.col("n_rows") + 5}
    got = {r.fusion_id: (r.one, r.ten, r.beyond) for r in fusion.hits_above(df, ["fusion_id"], cuts).collect()}
    for g, rows in groups.items():
        n = len(rows)
        assert got[g] == tuple(first_hits(rows, k) for k in (max(1, -(-n // 100)), max(1, -(-n // 10)), n))


def test_only_rows_at_the_cuts_are_ranked(spark, monkeypatch):
    ranked = []
    full = fusion.global_rank
    monkeypatch.setattr(fusion, "global_rank", lambda df, *a, **k: (ranked.append(df.count()), full(df, *a, **k))[1])
    df = spark.createDataFrame([("a", *r) for r in scored_rows(5000, 4, lambda d: d.random())], "fusion_id string, " + ROW)
    cuts = {"one": cutoff(F.col("n_rows"), 1.0), "ten": cutoff(F.col("n_rows"), 10.0)}
    fusion.hits_above(df, ["fusion_id"], cuts).collect()
    assert sum(ranked) < 50


def test_search_in_blocks_finds_what_a_plain_search_finds(spark, monkeypatch):
    """Missing components, a repeated weight map, a negative weight and more sets than a block holds."""
    monkeypatch.setattr(fusion, "BLOCK", 2)
    draw = random.Random(9)
    base = scored_rows(120, 5, lambda d: 0.0)
    scores = {(r[0], c): draw.choice([0.0, 0.25, 0.5, 1.0]) for r in base for c in "xyz" if draw.random() < 0.8}
    long = [(*r[:4], c, scores[r[0], c]) for r in base for c in "xyz" if (r[0], c) in scores]
    components = spark.createDataFrame(long, "candidate_id string, length int, sequence string, label string, component string, score double")
    sets = {"a": {"x": 1.0}, "b": {"x": 1.0}, "c": {"x": 0.5, "y": 0.5}, "d": {"z": 2.0, "y": 1.0}, "e": {"y": 1.0, "z": -3.0}}
    weights = spark.createDataFrame([(f, c, w) for f, m in sets.items() for c, w in m.items()], "fusion_id string, component string, weight double")
    counts = {}
    for name, weight in sets.items():
        rows = []
        for r in base:
            used = [(w, scores[r[0], c]) for c, w in weight.items() if w > 0 and (r[0], c) in scores]
            if used:
                rows.append((*r[:4], sum(w * s for w, s in used) / sum(w for w, _ in used)))
        n = len(rows)
        counts[name] = (first_hits(rows, max(1, -(-n // 100))), first_hits(rows, max(1, -(-n // 10))))
    places = sorted(sets, key=lambda f: (-counts[f][0], -counts[f][1], f))
    want = [f for f in places if f != "b"][:3]
    summary, chosen = fusion.fusion_search(components, weights, keep=3)
    assert [r.fusion_id for r in chosen.orderBy("place").collect()] == want
    assert {r.fusion_id: (r.top_1pct_count, r.top_10pct_count) for r in summary.collect()} == {f: counts[f] for f in want}


def test_search_without_positive_weights_fails(spark):
    components = spark.createDataFrame([], "candidate_id string, length int, sequence string, label string, component string, score double")
    weights = spark.createDataFrame([("a", "x", -1.0)], "fusion_id string, component string, weight double")
    with pytest.raises(ValueError, match="no weight above zero"):
        fusion.fusion_search(components, weights, 2)


def test_random_weights_have_the_moments_of_their_distribution(spark):
    """Dirichlet(0.55 x 3): mean 1/3, variance (1/3)(2/3) / (1.65 + 1); groups of one component draw nothing."""
    groups = {"all": ".*", "one": "^a$", "two": "^[ab]$"}
    drawn = fusion.random_weights(spark, ["a", "b", "c"], groups, trials=6000, seed=3)
    again = fusion.random_weights(spark, ["a", "b", "c"], groups, trials=6000, seed=3)
    rows = drawn.collect()
    assert sorted(rows) == sorted(again.collect())
    assert {r.fusion_id.split("__")[1] for r in rows} == {"all", "two"}
    for c in "abc":
        w = [r.weight for r in rows if r.component == c and "__all__" in r.fusion_id]
        w += [0.0] * (2000 - len(w))
        mean = sum(w) / 2000
        assert mean == pytest.approx(1 / 3, abs=0.025)
        assert sum((x - mean) ** 2 for x in w) / 2000 == pytest.approx(2 / 9 / 2.65, abs=0.01)
    assert all(r.weight > 1e-5 for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_stratified_folds_keep_groups_and_share_positives(spark, seed):
    """Five groups of nine hold positives, one group holds a third of all rows, one is null."""
    draw = random.Random(seed)
    rows = []
    for g in [None, *"abcdefgh"]:
        for _ in range(90 if g == "a" else draw.randint(3, 30)):
            rows.append((g, "known_positive" if g in (None, "b", "c", "d", "e") and draw.random() < 0.4 else "matched_decoy"))
        if g in (None, "b", "c", "d", "e"):
            rows.append((g, "known_positive"))
    df = spark.createDataFrame(rows, "parent string, label string").repartition(7)
    found = validation.stratified_folds(df, "parent", 4, 5, "s").collect()
    assert len(found) == 9 * 4 and len({(r.parent, r.repeat) for r in found}) == 36
    richest = max(sum(g == p and x == "known_positive" for g, x in rows) for p in [None, *"bcde"])
    for repeat in range(1, 5):
        fold = {r.parent: r.fold for r in found if r.repeat == repeat}
        positives = [sum(fold[g] == f and x == "known_positive" for g, x in rows) for f in range(1, 6)]
        assert min(positives) > 0 and max(positives) - min(positives) <= richest
    assert len({tuple(sorted((str(r.parent), r.fold) for r in found if r.repeat == k)) for k in range(1, 5)}) > 1
    key = lambda r: (str(r.parent), r.repeat)
    assert sorted(found, key=key) == sorted(validation.stratified_folds(df.repartition(2), "parent", 4, 5, "s").collect(), key=key)


def test_stratified_folds_with_less_than_a_run_of_groups_and_none(spark):
    few = spark.createDataFrame([("a", "known_positive"), ("b", "matched_decoy")], "parent string, label string")
    found = validation.stratified_folds(few, "parent", 2, 5).collect()
    assert all(1 <= r.fold <= 5 for r in found) and len({(r.repeat, r.fold) for r in found}) == 4
    assert validation.stratified_folds(few.limit(0), "parent", 2, 5).count() == 0


def test_scenarios_differ_only_in_the_second_score(spark):
    """Held-out figures of the first score are the same; a second score that is pure length is useless once scaled."""
    draw = random.Random(5)
    rows = []
    for i in range(160):
        length = draw.choice([3, 4, 5])
        positive = draw.random() < {3: 0.1, 4: 0.4, 5: 0.8}[length]
        rows.append((i % 16, "known_positive" if positive else "matched_decoy", length, f"s{i:03d}", draw.random(), float(length)))
    df = spark.createDataFrame(rows, "parent int, label string, length int, sequence string, s1 double, s2 double")
    found = {(r.scenario_id, r.repeat, r.fold): r for r in validation.scenario_cv(df, "s1", "s2", 1, 4).collect()}
    assert len(found) == 8
    for fold in range(1, 5):
        raw, scaled = found["raw", 1, fold], found["length_z", 1, fold]
        assert (raw.test_first_auroc, raw.test_first_ap, raw.test_first_top_10pct) == (
            scaled.test_first_auroc, scaled.test_first_ap, scaled.test_first_top_10pct)
        assert raw.test_second_auroc > 0.6 and scaled.test_second_auroc == pytest.approx(0.5)
        assert raw.train_rows + raw.test_rows == 160 and raw.test_positives > 0


def test_means_at_half_a_digit_do_not_depend_on_the_order_of_rows(spark):
    scores = {"a": 0.9900316475623939, "b": 0.059688728265053115, "c": 0.5989484591361589}
    rows = [("x", name, score) for name, score in scores.items()] + [("none", "a", None)]
    weights = spark.createDataFrame([("f", "a", 0.5), ("f", "b", 0.25), ("f", "c", 0.25)], "fusion_id string, component string, weight double")

    def fused(ordered):
        table = spark.createDataFrame(ordered, "candidate_id string, component string, score double").coalesce(1)
        return {r.candidate_id: r.score for r in fusion.fuse(table, weights, ["candidate_id"]).collect()}

    assert fused(rows) == fused(rows[::-1]) == {"x": 0.659675120632, "none": None}
