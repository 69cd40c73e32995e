"""Operators against brute force, invariants and published summaries."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankaudit.operators import (
    cleavage, context_model, digest, fusion, generate, geometry, manifest, metrics, neighbors, overlap, panels, scaling,
    traces, validation,
)
from rankaudit.operators.ordering import average_ranks, global_rank, running_totals
from rankaudit.session import materialize


def skewed(n=3000, seed=5):
    """Scores where one value holds a third of all rows of a group, and one group most rows."""
    rng = random.Random(seed)
    labels = ["known_positive", "matched_decoy", "random_background"]
    return [
        ("big" if rng.random() < 0.8 else "small", 0.5 if rng.random() < 0.34 else round(rng.random(), 3),
         2 + i % 7, f"S{i:06d}", labels[0] if rng.random() < 0.05 else labels[1 + i % 2])
        for i in range(n)
    ]


SCHEMA = "g string, score double, length int, sequence string, label string"


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_group(rows):
    return {g: [r for r in rows if r[0] == g] for g in ("big", "small")}


def test_global_rank_is_the_sorted_position(frame, rows):
    ranked = global_rank(frame, ["g"], metrics.total_order(), total="n")
    got = {r.sequence: (r.rank, r.n) for r in ranked.collect()}
    for group in by_group(rows).values():
        ordered = sorted(group, key=lambda r: (-r[1], r[2], r[3]))
        for place, row in enumerate(ordered, 1):
            assert got[row[3]] == (place, len(group))


def test_ranks_do_not_depend_on_partitioning(frame):
    first = {r.sequence: r.rank for r in global_rank(frame, ["g"], metrics.total_order()).collect()}
    again = {r.sequence: r.rank for r in global_rank(frame.repartition(11), ["g"], metrics.total_order()).collect()}
    assert first == again


def test_running_totals(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("one", F.lit(1))
    run = running_totals(frame, ["g"], metrics.total_order(), ["one", "length"])
    got = {r.sequence: (r.cum_one, r.cum_length, r.total_one) for r in run.collect()}
    for group in by_group(rows).values():
        total = 0
        for place, row in enumerate(sorted(group, key=lambda r: (-r[1], r[2], r[3])), 1):
            total += row[2]
            assert got[row[3]] == (place, total, len(group))


def plain_auroc(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_separation_matches_pairs(frame, rows):
    got = {r.g: r for r in metrics.separation(frame, ["g"]).collect()}
    for name, group in by_group(rows).items():
        pos = [r[1] for r in group if r[4] == "known_positive"]
        assert got[name].auroc_all == pytest.approx(plain_auroc(pos, [r[1] for r in group if r[4] != "known_positive"]))
        assert got[name].auroc_matched == pytest.approx(plain_auroc(pos, [r[1] for r in group if r[4] == "matched_decoy"]))
        ordered = sorted(group, key=lambda r: (-r[1], r[4] != "known_positive"))
        hits, total = 0, 0.0
        for place, row in enumerate(ordered, 1):
            if row[4] == "known_positive":
                hits += 1
                total += hits / place
        assert got[name].ap_positives_first == pytest.approx(total / hits, abs=1e-9)


def test_separation_is_null_without_a_class(spark):
    df = spark.createDataFrame([("a", 0.1, "known_positive"), ("b", 0.1, "random_background")], "g string, score double, label string")
    got = {r.g: r for r in metrics.separation(df, ["g"]).collect()}
    assert got["a"].auroc_all is None and got["b"].auroc_all is None and got["b"].ap_step is None


def test_evaluation_orders_all_rows_once(frame, rows, monkeypatch):
    from rankaudit.operators import ordering

    written = []
    write = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df: written.append(out := write(df)) or out)
    found = {r.g: r for r in metrics.evaluate(frame, ["g"]).collect()}
    apart = {r.g: r for r in metrics.separation(frame.drop("length", "sequence"), ["g"]).collect()}
    for g, r in found.items():
        assert all(r[c] == pytest.approx(apart[g][c]) if apart[g][c] is not None else r[c] is None for c in ("auroc_all", "auroc_matched", "ap_step", "ap_positives_first"))
    sizes = [w.count() for w in written]
    scores = {(r[0], r[1]) for r in rows if r[4] in ("known_positive", "matched_decoy")}
    assert sizes[0] == len(rows) and sizes[1] == len(scores) < len(rows) and len(sizes) == 4


def test_average_ranks_and_percentiles(frame, rows):
    got = {r.sequence: r.avg_rank for r in average_ranks(frame, ["g"], "score").collect()}
    pct = {r.sequence: r.score for r in scaling.percentile(frame, ["g"]).collect()}
    for group in by_group(rows).values():
        scores = [r[1] for r in group]
        below, same = Counter(), Counter(scores)
        seen = 0
        for value in sorted(same):
            below[value] = seen
            seen += same[value]
        for row in group:
            expected = below[row[1]] + (same[row[1]] + 1) / 2
            assert got[row[3]] == expected
            assert pct[row[3]] == pytest.approx((expected - 1) / (len(group) - 1))


def test_constant_components(spark):
    df = spark.createDataFrame([("c", 1.0, 3), ("c", 1.0, 3), ("c", 1.0, 4)], "component string, score double, length int")
    assert {r.score for r in scaling.percentile(df, ["component"]).collect()} == {0.0}
    assert {r.score for r in scaling.length_percentile(df, ["component"]).collect()} == {0.5}
    assert {r.score for r in scaling.minmax(df, ["component"], "score").collect()} == {0.5}
    assert {r.z for r in scaling.length_z(df, ["component"], "score", "z").collect()} == {0.0}


# Published positive ranks of one frozen run (58,192 candidates) and its summary.
POSITIVE_RANKS = [
    129, 149, 195, 227, 288, 417, 1073, 1098, 1241, 1370, 1507, 1646, 1949, 2074, 2233, 2639, 3586, 5453, 7034, 7602, 7820,
    8217, 8355, 8434, 9565, 9834, 10492, 11489, 13289, 13493, 14205, 14272, 14811, 14837, 15420, 15506, 15623, 16737, 16851,
    16862, 16914, 18792, 18861, 19597, 20597, 20727, 21392, 26023, 26712, 39233, 44215, 57401,
]


def test_rank_list_reproduces_published_summary(spark):
    df = spark.createDataFrame([("v6", r, 58192) for r in POSITIVE_RANKS], "run string, rank long, n_rows long")
    got = manifest.evaluate_rank_list(df, ["run"]).first()
    assert (got.n_positive, got.top_1pct_count, got.top_5pct_count, got.top_10pct_count) == (52, 6, 16, 18)
    assert got.mean_rank == pytest.approx(12086.26923076923)
    assert got.median_rank == 10163.0 and got.best_rank == 129
    assert got.top_1pct_p == pytest.approx(1.3439959693947684e-05, rel=1e-8)
    assert got.top_1pct_enrichment == pytest.approx(11.536875495638382)


def test_digest_edges(spark):
    df = spark.createDataFrame([("a", "s", "KP"), ("b", "s", "K"), ("c", "s", "AAA"), ("d", "s", "GKGRPK")], "accession string, source_class string, sequence string")
    rows = digest.digest(df, missed=0, shortest=1, longest=10).collect()
    got = {(r.accession, r.rule): set() for r in rows}
    for r in rows:
        got[(r.accession, r.rule)].add(r.sequence)
    assert got[("a", "trypsin")] == {"KP"} and got[("b", "trypsin")] == {"K"}
    assert got[("c", "thermolysin_like")] == {"A"}
    assert got[("d", "trypsin")] == {"GK", "GRPK"}


def test_decoys_keep_composition_and_differ(spark):
    parents = spark.createDataFrame([("VPPKL",), ("AA",), ("ACDEFGHIKLMNPQRSTVWYAC",)], "parent string")
    rows = generate.shuffled_decoys(parents, 5, tries=50).collect()
    assert all(sorted(r.sequence) == sorted(r.parent) and r.sequence != r.parent for r in rows)
    per = Counter(r.parent for r in rows)
    assert per["VPPKL"] == 5 and per["AA"] == 0 and per["ACDEFGHIKLMNPQRSTVWYAC"] == 5
    assert len({(r.parent, r.sequence) for r in rows}) == len(rows)


def test_random_decoys_fill_quota_without_blocked(spark):
    quotas = spark.createDataFrame([("VPPK", 6), ("ACDEF", 3), ("AAA", 0)], "parent string, quota int")
    free = generate.random_decoys(quotas, spark.createDataFrame([], "sequence string")).collect()
    blocked = spark.createDataFrame([(r.sequence,) for r in free], "sequence string")
    rows = generate.random_decoys(quotas, blocked).collect()
    assert Counter(r.parent for r in rows) == {"VPPK": 6, "ACDEF": 3}
    assert not {r.sequence for r in rows} & {r.sequence for r in free}
    assert all(len(r.sequence) == len(r.parent) for r in rows)


def test_decoys_use_up_a_string_space_before_a_parent_is_short(spark):
    quotas = spark.createDataFrame([("AA", 300), ("CC", 90), ("DD", 40), ("EEEE", 50), ("F", 30)], "parent string, quota int")
    taken = spark.createDataFrame([("AA",), ("CC",), ("DD",), ("AA",), ("F",), ("longer",)], "sequence string")
    rows = generate.random_decoys(quotas, taken, rounds=(1, 2)).collect()
    count = Counter(r.parent for r in rows)
    assert len({r.sequence for r in rows}) == len(rows) and not {"AA", "CC", "DD", "F"} & {r.sequence for r in rows}
    assert count["AA"] + count["CC"] + count["DD"] == 397 and count["EEEE"] == 50 and count["F"] == 19
    assert all(len(r.sequence) == len(r.parent) for r in rows) and any(r.attempt is None for r in rows)
    for parent, n in count.items():
        assert sorted(r.ordinal for r in rows if r.parent == parent) == list(range(1, n + 1))
    asked = quotas.selectExpr("'decoy' AS kind", "parent AS owner", "CAST(quota AS BIGINT) AS requested")
    found = generate.shortage(asked, spark.createDataFrame([("decoy", r.parent) for r in rows], "kind string, owner string")).collect()
    assert {r.owner for r in found if r.short} <= {"AA", "CC", "DD", "F"} and all((r.short > 0) == (r.reason != "") for r in found)
    assert sum(r.short for r in found) == 33 + 11


def test_background_meets_its_request_or_uses_up_its_strings(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, None)], "key bigint")
    taken = spark.createDataFrame([("A",), ("C",), ("b",)], "sequence string")
    rows = generate.random_background(keys, 18, 1, 1, taken).collect()
    assert len(rows) == 18 and {r.sequence for r in rows} == set("DEFGHIKLMNPQRSTVWY") and {r.ordinal for r in rows} == set(range(1, 19))
    assert generate.random_background(keys, 50, 1, 1, taken).count() == 18
    first = generate.random_background(keys, 10, 1, 3, taken).collect()
    more = generate.random_background(keys, 200, 1, 3, taken).collect()
    assert {(r.ordinal, r.sequence) for r in first} == {(r.ordinal, r.sequence) for r in more if r.ordinal <= 10} and len(more) == 200
    assert generate.random_background(keys, 0, 1, 3, taken).count() == 0 and generate.random_background(keys.limit(0), 5, 1, 3, taken).count() == 0


def test_every_string_of_a_length(spark):
    assert {r.sequence for r in generate.every_string(spark, 2).collect()} == {a + b for a in "ACDEFGHIKLMNPQRSTVWY" for b in "ACDEFGHIKLMNPQRSTVWY"}


def test_first_writer_wins_and_blinding(spark):
    make = lambda label, *s: spark.createDataFrame([(x, label, "o", "p", "") for x in s], "sequence string, label string, origin string, provenance string, ordinal string")
    union = generate.first_writer_wins([make("a", "X", "Y"), make("b", "Y", "Z")])
    assert {(r.sequence, r.label) for r in union.collect()} == {("X", "a"), ("Y", "a"), ("Z", "b")}
    public, private = generate.split_blind(generate.with_candidate_ids(union, "ns"))
    assert public.columns == ["candidate_id", "sequence", "length"] and "label" in private.columns


def plain_distance(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        previous = row
    return previous[-1]


@pytest.mark.parametrize("alphabet,longest,seed", [("AB", 6, 1), ("ACDEFG", 12, 2), ("ACDEFGHIKLMNPQRSTVWY", 9, 3)])
def test_neighbor_audit_is_exact(spark, alphabet, longest, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
    panel, prior = {word() for _ in range(40)}, {word() for _ in range(120)}
    make = lambda words: spark.createDataFrame([(w,) for w in words], "sequence string")
    got = {r.sequence: r for r in neighbors.neighbor_audit(make(panel), make(prior)).collect()}
    assert set(got) == panel
    check_neighbors(got, prior)


def check_neighbors(got, prior):
    for word, row in got.items():
        distances = [(plain_distance(word, p), p) for p in prior]
        ident = lambda d, p: max(0.0, 1 - d / max(len(word), len(p)))
        best = min((d, -ident(d, p), abs(len(word) - len(p)), p) for d, p in distances)
        assert (row.nearest_distance, row.nearest) == (best[0], best[3]), word
        assert row.one_edit == sum(d == 1 for d, _ in distances), word
        assert row.two_edit == sum(0 < d <= 2 for d, _ in distances), word
        assert row.high_identity == sum(d > 0 and ident(d, p) >= 0.8 for d, p in distances), word


def test_neighbor_audit_without_shared_letters(spark):
    make = lambda words: spark.createDataFrame([(w,) for w in words], "sequence string")
    panel, prior = {"AAAA", "CC", "D", "ACACAC"}, {"GGGGGG", "HHHHHHHH", "GGGGGGGACAC", "HHHHH"}
    got = {r.sequence: r for r in neighbors.neighbor_audit(make(panel), make(prior)).collect()}
    check_neighbors(got, prior)


def test_overlap_and_rejections(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    candidates = make([("A",), ("B",), ("B",)], "sequence string")
    excluded = make([("B", "p2"), ("B", "p1"), ("C", "p1")], "sequence string, panel string")
    assert [(r.sequence, r.panels) for r in overlap.overlaps(candidates, excluded).collect()] == [("B", "p1;p2")]
    audit = overlap.overlap_audit(candidates, excluded).first()
    assert (audit.candidate_count, audit.overlap_count, audit.excluded_count, audit.status) == (2, 1, 2, "fail")
    raw = make([("AC", 1.0), ("AX", 1.0), ("A" * 20, 1.0), ("AD", None), ("AE", 99.0), ("AF", 1.0)], "sequence string, ic50_um double")
    marked = overlap.with_reject_reason(raw, make([("AF",)], "sequence string"), 2, 12, maximum=50.0)
    assert {r.sequence[:2] + str(len(r.sequence)): r.reason for r in marked.collect()} == {
        "AC2": None, "AX2": "invalid_sequence", "AA20": "length_outside_range", "AD2": "unparsed_ic50",
        "AE2": "above_max_ic50_um", "AF2": "excluded_eval_sequence",
    }


def test_site_scan_edges(spark):
    df = spark.createDataFrame([("KK",), ("K",), ("KP",), ("AAKAA",)], "sequence string")
    rows = {(r.sequence, r.enzyme): r for r in cleavage.cleavage_profile(df).collect()}
    assert rows[("K", "trypsin")].sites == [] and rows[("K", "trypsin")].probability == 0.0
    assert [s.position for s in rows[("AAKAA", "trypsin")].sites] == [3]
    stable = {r.sequence: r.stability for r in cleavage.stability(df).collect()}
    assert stable["K"] == 1.0 and stable["KP"] == 1.0
    custom = {"exo": {"intercept": 0.0, "positions": {0: {"P": 2.0, "*": -1.0}}, "min_probability": 0.0, "min_index": 1, "max_index": 2, "distance_penalty": -1.0}}
    only = cleavage.cleavage_profile(df.where("sequence = 'AAKAA'"), custom).first()
    assert [s.position for s in only.sites] == [2, 3]


def test_shuffle_zscore_flat_and_single(spark):
    df = spark.createDataFrame([("AAAA",), ("A",), ("GPWAAKF",)], "sequence string")
    got = {r.sequence: r for r in traces.shuffle_zscore(df, 30).collect()}
    assert got["AAAA"].z_score == 0.0 and got["A"].z_score is None
    assert got["GPWAAKF"].z_score is not None


def test_context_model_is_a_distribution(spark):
    df = spark.createDataFrame([("VPPK", 3), ("ACDE", 1), ("VPP", 2)], "sequence string, n int")
    model = context_model.train(df, "n")
    sums = model.groupBy("left", "right").agg(F.sum(F.exp("log_p")).alias("p"), F.count("*").alias("n")).collect()
    assert all(r.p == pytest.approx(1.0) and r.n == 20 for r in sums)
    scored = {r.sequence: r for r in context_model.log_likelihood(df.unionByName(spark.createDataFrame([("AXA", 1)], df.schema)), model).collect()}
    assert scored["VPP"].mean_ll == pytest.approx(scored["VPP"].total_ll / 3) and scored["AXA"].total_ll == float("-inf")


def test_substitutions_of_contexts_never_seen(spark):
    df = spark.createDataFrame([("VPPK", 3), ("ACDE", 1), ("VPP", 2)], "sequence string, n int")
    parents = spark.createDataFrame([("VAE",), ("VPP",), ("WYA",)], "sequence string")
    rows = context_model.top_substitutions(parents, context_model.train(df, "n"), 2).collect()
    assert sorted((r.sequence, r.position, r.choice) for r in rows) == sorted((s, i, c) for s in ("VAE", "VPP", "WYA") for i in (1, 2, 3) for c in (1, 2))
    found = {(r.sequence, r.position, r.choice): (r.substitute, r.log_p) for r in rows}
    # After V: P with 5 of 5, plus one each of 20; W is no left neighbour.
    assert found[("VAE", 2, 1)] == ("P", pytest.approx(math.log(6 / 25))) and found[("VAE", 2, 2)] == ("C", pytest.approx(math.log(1 / 25)))
    assert found[("WYA", 2, 1)] == ("A", pytest.approx(math.log(1 / 20)))


def test_variants_prefer_single_edits(spark):
    df = spark.createDataFrame([("VPPK", 3), ("ACDE", 1), ("VPP", 2)], "sequence string, n int")
    parents = df.select("sequence", F.col("sequence").alias("parent_order"))
    rows = context_model.variants(parents, context_model.train(df, "n"), df).collect()
    known = {"VPPK", "ACDE", "VPP"}
    assert len({r.sequence for r in rows}) == len(rows) and not {r.sequence for r in rows} & known
    for r in rows:
        changed = sum(a != b for a, b in zip(r.parent, r.sequence))
        assert changed == r.edit_count == len(r.mutations.split(";"))


def test_folds_keep_groups_and_repeats_differ(spark):
    df = spark.range(60).withColumn("parent", F.col("id") % 12).withColumn("repeat", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = df.withColumn("fold", validation.fold_of(F.col("parent"), F.col("repeat"), 5, "s")).collect()
    seen = {}
    for r in rows:
        assert seen.setdefault((r.repeat, r.parent), r.fold) == r.fold
    assert [seen[(1, p)] for p in range(12)] != [seen[(2, p)] for p in range(12)]


def test_gate_helpers_and_duplicate_weights(spark):
    assert fusion.gate_percents([], []) == [2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0]
    assert fusion.gate_percents([3.0], [(1.0, 2.0, 0.5)]) == [1.0, 1.5, 2.0, 3.0]
    weights = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("c", "y", 1.0)], "fusion_id string, component string, weight double")
    order = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "fusion_id string, place int")
    kept = fusion.without_duplicates(weights, order, 5).collect()
    assert {r.fusion_id for r in kept} == {"b", "c"}
    draws = fusion.dirichlet_weights(spark, ["x", "y", "z"], 4, seed=1).groupBy("fusion_id").agg(F.sum("weight").alias("w"))
    assert all(r.w == pytest.approx(1.0, abs=1e-4) for r in draws.collect())


def test_fused_ties_do_not_depend_on_partitioning(spark):
    """Candidates holding the same scores in different components are tied after an equal mean."""
    names = [f"c{i}" for i in range(9)]
    values = [0.1, 0.7, 0.3, 0.9, 0.2, 0.6, 1 / 3, 0.45, 0.05]
    rows = [(f"x{k}", n, values[(i + k) % 9]) for k in range(9) for i, n in enumerate(names)]
    components = spark.createDataFrame(rows, "candidate_id string, component string, score double")
    weights = spark.createDataFrame([("m", n, 1 / 9) for n in names], "fusion_id string, component string, weight double")
    for parts in (1, 4, 13):
        fused = fusion.fuse(components.repartition(parts), weights, ["candidate_id"]).collect()
        assert len({r.score for r in fused}) == 1 and len(fused) == 9


def test_panel_helpers(spark):
    df = spark.createDataFrame([("s", 2, 5.0), ("s", 1, 5.0), ("t", 3, 1.0)], "sequence string, ordinal int, value double")
    assert {(r.sequence, r.ordinal) for r in panels.lowest_per_key(df, "sequence", "value", "ordinal").collect()} == {("s", 1), ("t", 3)}
    assert {(r.sequence, r.value) for r in panels.latest_per_key(df, "sequence", "ordinal").collect()} == {("s", 5.0), ("t", 1.0)}
    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "candidate_id string, rank int")
    key = spark.createDataFrame([("a", "known_positive", "o", "p")], "candidate_id string, label string, origin string, provenance string")
    assert {(r.candidate_id, r.label) for r in panels.join_key(ranked, key).collect()} == {("a", "known_positive"), ("b", "missing_key")}
    assert panels.missing_keys(ranked, key).count() == 1


def test_expectations_can_be_loud(spark):
    summary = spark.createDataFrame([(1.0, 5)], "a double, b int")
    assert [r.met for r in manifest.expect(summary, {"a": (1.01, 0.02), "b": (6, 0)}).collect()] == [True, False]
    with pytest.raises(Exception, match="expectation missed"):
        manifest.expect(summary, {"b": (6, 0)}, loud=True).collect()


def test_manifest_ignores_order(spark, frame):
    one = {r.g: (r.n, r.digest) for r in manifest.manifest(frame, ["sequence", "score"], ["g"]).collect()}
    two = {r.g: (r.n, r.digest) for r in manifest.manifest(frame.repartition(9), ["sequence", "score"], ["g"]).collect()}
    assert one == two


def test_contact_geometry(spark):
    atoms = spark.createDataFrame(
        [("p", 1, "N", "N", 0.0, 0.0, 1.0), ("p", 2, "O", "OXT", 0.0, 3.0, 0.0), ("p", 2, "H", "H", 0.0, 0.0, 0.1), ("q", 1, "C", "CA", 0.0, 0.0, 4.0)],
        "pose string, residue_number int, element string, name string, x double, y double, z double",
    )
    got = {r.pose: r for r in geometry.contact_geometry(atoms, (0.0, 0.0, 0.0)).collect()}
    assert (got["p"].min_heavy, got["p"].min_terminal_oxygen, got["p"].polar_near, got["p"].oxygen_near) == (1.0, 3.0, 2, 1)
    assert got["q"].min_polar is None and got["q"].terminal_oxygens == 0


def test_changed_scores_equal_rescoring(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACDEFG") for _ in range(n))
    corpus = spark.createDataFrame([(word(rng.randint(1, 7)),) for _ in range(60)], "sequence string")
    model = context_model.train(corpus).cache()
    parents, rows = [], {}
    for n in (1, 2, 3, 4, 6, 9):
        parent = word(n)
        parents.append(parent)
        for _ in range(12):
            new = list(parent)
            for i in rng.sample(range(n), min(n, rng.randint(1, 2))):
                new[i] = rng.choice("ACDEFGW")
            rows["".join(new)] = parent
    variants = spark.createDataFrame(list(rows.items()), "sequence string, parent string")
    scored = context_model.log_likelihood(spark.createDataFrame([(p,) for p in parents], "sequence string"), model)
    got = {r.sequence: r for r in context_model.changed_scores(variants, scored, model).collect()}
    whole = {r.sequence: r for r in context_model.log_likelihood(variants, model).collect()}
    before = {r.sequence: r for r in scored.collect()}
    assert set(got) == set(rows)
    for sequence, r in got.items():
        assert r.total_ll == pytest.approx(whole[sequence].total_ll) and r.pseudo_perplexity == pytest.approx(whole[sequence].pseudo_perplexity)
        assert r.delta_mean_ll == pytest.approx(whole[sequence].mean_ll - before[rows[sequence]].mean_ll, abs=1e-12)


def test_nearest_within_a_promised_radius(spark):
    rng = random.Random(5)
    known = {"".join(rng.choice("ABC") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {"Z"}
    queries = {}
    for parent in sorted(known):
        for edits in (1, 2):
            new = list(parent)
            for i in rng.sample(range(len(new)), min(edits, len(new))):
                new[i] = rng.choice("ABCX")
            queries["".join(new)] = min(edits, queries.get("".join(new), 9))
    table = spark.createDataFrame(list(queries.items()), "query string, radius int")
    got = {r.query: (r.nearest, r.nearest_distance) for r in neighbors.nearest_within(table, spark.createDataFrame([(k,) for k in known] * 2, "other string")).collect()}
    assert set(got) == set(queries)
    for query, found in got.items():
        d, _, nearest = min((plain_distance(query, k), abs(len(query) - len(k)), k) for k in known)
        assert found == (nearest, d), query


def test_first_members_and_last_rows(spark):
    rows = [("A", "known_positive", 3), ("B", "known_positive", 1), ("C", "matched_decoy", 2), ("D", "digestome_known_positive", 4), ("E", "known_positive", 5)]
    ranked = spark.createDataFrame(rows, "sequence string, label string, rank long")
    members = spark.createDataFrame([("A",), ("A",), ("C",), ("D",), ("E",)], "sequence string")
    assert [r.sequence for r in panels.first_members(ranked, members, 2).collect()] == ["A", "D"]


def test_strata_have_enrichment_and_tails_per_group(spark):
    from math import comb

    rows = [("m", r, 200, ["all"] + (["odd"] if r % 2 else [])) for r in (1, 2, 9, 60, 61, 150)] + [("k", 199, 200, ["all", "odd"])]
    df = spark.createDataFrame(rows, "mode string, rank long, n_rows long, tags array<string>")
    got = {(r["mode"], r.tag): r for r in metrics.with_enrichment(metrics.strata_summary(df, ["mode"])).collect()}
    assert set(got) == {("m", "all"), ("m", "odd"), ("k", "all"), ("k", "odd")}
    r = got["m", "all"]
    assert (r.n_positive, r.top_1pct_count) == (6, 2) and r.top_1pct_enrichment == pytest.approx(2 / (6 * 2 / 200))
    assert r.top_1pct_p == pytest.approx(comb(6, 2) * comb(194, 0) / comb(200, 2)) and got["k", "odd"].top_1pct_p == 1.0


def test_far_search_opens_few_strings_of_a_skewed_collection():
    rng = random.Random(8)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    # Every string has the letter A, a third of them nothing else.
    others = ["A" * rng.randint(1, 12) for _ in range(1000)] + [word("ABCDEFGHIK", rng.randint(5, 11)) + "A" for _ in range(2000)]
    queries = [word("ABCDEFGHIK", 9) + "A" for _ in range(15)] + ["WWWW", "", "A"]
    search = neighbors.FarSearch(queries)
    for a in range(0, len(others), 700):
        search.take(others[a : a + 700])
    for query, found in zip(queries, search.best):
        assert found == min((d := plain_distance(query, o), -max(len(o), len(query)), abs(len(o) - len(query)), o) for o in others)
    assert search.opened < 0.4 * len(queries) * len(others)


def test_short_pairs_match_brute_force_and_need_no_shared_letter(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ABCDEFGHIKLM") for _ in range(rng.randint(1, n)))
    queries, others = {word(5) for _ in range(60)}, {word(8) for _ in range(300)}
    make = lambda words, name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    got = {(r.query, r.other): r.distance for r in neighbors.short_pairs(make(queries, "query"), make(others, "other")).collect()}
    for q in queries:
        for o in others:
            d = plain_distance(q, o)
            assert got.get((q, o)) == d if d <= 2 and (q, o) in got else d > 2 or max(len(q), len(o)) <= 2


def test_audit_report_counts_the_best_hundredth(spark):
    audit = spark.createDataFrame([("A", "distant", 0.0), ("B", "single_edit_neighbor", 0.5), ("C", "exact_overlap", 1.0), ("D", "distant", 0.25)],
                                  "sequence string, neighborhood_class string, nearest_identity double")
    ranked = spark.createDataFrame([("A", 2), ("B", 1), ("C", 250)], "sequence string, rank long")
    r = neighbors.audit_report(neighbors.with_top_ranks(audit, ranked)).first()
    assert (r.positive_count, r.threshold, r.top_1pct_count, r.distant_count, r.top_1pct_distant_count, r.exact_overlap_count) == (4, 3, 2, 2, 1, 1)
    assert (r.mean_identity, r.median_identity) == (0.4375, 0.375)
    assert neighbors.with_top_ranks(audit, ranked, 100).where("top_1pct").count() == 1


def test_fragment_codes_are_the_fragments_of_the_digest(spark):
    from rankaudit.operators import digest

    draw = random.Random(5)
    texts = ["", None, "K", "KP", "AAA", "KKPRRFWYLPAIM", "A" * 40, *("".join(draw.choices("ACDEFGHIKLMNPQRSTVWYZ", k=n)) for n in (1, 2, 13, 300, 900))]
    rows = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(texts)], "accession long, source_class string, sequence string")
    plain = {(r.accession, r.source_class, r.rule, r.sequence) for r in digest.digest(rows).collect()}
    packed = digest.fragment_codes(rows).withColumns({"sequence": digest.code_text(F.col("code")), "length": digest.code_length(F.col("code"))}).collect()
    rules = list(digest.CUT_RULES)
    assert {(r.accession, r.source_class, rule, r.sequence) for r in packed for i, rule in enumerate(rules) if r.rules >> i & 1} == plain
    assert len(packed) == len({(a, s) for a, _, _, s in plain}) and all(len(r.sequence) == r.length for r in packed)
    assert [r.sequence for r in sorted(packed, key=lambda r: r.code)] == sorted(r.sequence for r in packed)
    with pytest.raises(Exception, match="A-Z"):
        digest.fragment_codes(rows.withColumn("sequence", F.lit("a b"))).collect()


def test_large_tables_of_taken_strings_are_not_shuffled(spark):
    strings = spark.createDataFrame([("a",), ("b",), ("c",)], "sequence string")
    taken = spark.range(200000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("sequence")).union(spark.createDataFrame([("b",)], "sequence string"))
    taken = materialize(taken.unionByName(taken))
    free = generate.without(materialize(strings), taken)
    assert sorted(r.sequence for r in free.collect()) == ["a", "c"]
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin [sequence" not in plan


def test_distinct_codes_are_those_of_the_fragments(spark):
    rows = spark.createDataFrame([("a", "ARNDKCEQRGHILK"), ("b", "ARNDKCEQRGHILK"), ("c", "KKRRPFWYL"), ("d", ""), ("e", None)], "accession string, sequence string")
    codes = [r.code for r in digest.distinct_codes(rows).collect()]
    assert sorted(codes) == sorted({r.code for r in digest.fragment_codes(rows).collect()}) and len(codes) > 5


def test_shortage_asks_for_no_owners(spark, monkeypatch, tmp_path):
    from rankaudit.plans import catalog

    class Reached(Exception):
        pass

    def stop(*_):
        raise Reached

    spark.createDataFrame([(1, "s", "Some words of a document")], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", "panel words")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(catalog, "_digest_owners", lambda proteins: pytest.fail("owners were computed"))
    monkeypatch.setattr(catalog, "_decoy_sources", stop)
    with pytest.raises(Reached):
        catalog.universe_shortage(spark, str(tmp_path))


@pytest.mark.parametrize("rows", [[], [("s1", 5, "KAAK"), ("s0", 9, "AAK"), ("s0", 7, "AAKGG"), (None, 3, "AAK"), ("s1", 1, None), ("s1", 5, "KAAK")]])
def test_digest_owners_are_the_least_of_class_rule_and_accession(spark, rows):
    from rankaudit.operators import digest
    from rankaudit.plans.catalog import _digest_owners

    proteins = spark.createDataFrame(rows, "source_class string, accession long, sequence string")
    least = digest.digest(proteins).groupBy("sequence").agg(F.min(F.struct("source_class", "rule_order", "rule", "accession")).alias("o"))
    want = {(r.sequence, r.o.source_class, r.o.rule, r.o.accession) for r in least.collect()}
    got = [(r.sequence, r.o.source_class, r.o.rule, r.o.accession) for r in _digest_owners(proteins).collect()]
    assert len(got) == len(set(got)) and set(got) == want
