"""Column helpers against published values and plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rankaudit.functions import features, fixed, mathx, text
from rankaudit.functions.scoring import score_ablations, score_modes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "sequence string")


# Published scores of four known strings under each ablation.
ABLATION_SCORES = {
    ("full", "IPP"): 1.0, ("full", "LKP"): 1.0, ("full", "VPP"): 1.0, ("full", "LKPNM"): 0.836647,
    ("no_triad", "IPP"): 0.88, ("no_triad", "LKP"): 0.88, ("no_triad", "LKPNM"): 0.716647,
    ("no_cterm_bonus", "IPP"): 0.88, ("no_cterm_bonus", "LKP"): 0.88, ("no_cterm_bonus", "LKPNM"): 0.836647,
    ("no_position", "LKPNM"): 0.316647, ("no_position", "LKP"): 0.28, ("no_position", "IPP"): 0.16,
    ("composition_only", "LKP"): 0.390029, ("composition_only", "LKPNM"): 0.316647,
    ("composition_only", "IPP"): 0.307748, ("composition_only", "VPP"): 0.307748,
}


def test_ablation_scores_match_published_values(spark):
    public = strings(spark, "IPP", "VPP", "LKP", "LKPNM").withColumn("candidate_id", F.col("sequence"))
    got = {(row.ablation, row.sequence): row.score for row in score_ablations(public).collect()}
    for key, value in ABLATION_SCORES.items():
        assert got[key] == pytest.approx(value, abs=2e-6), key


def test_hash_control_is_the_digest(spark):
    expected = int(hashlib.sha256(b"abc").hexdigest()[:12], 16) / (16**12 - 1)
    assert one(spark, mathx.hash_uniform(F.lit("abc"))) == pytest.approx(expected, abs=1e-15)


def test_modes_stay_in_range_and_need_only_public_columns(spark):
    public = strings(spark, "IPP", "CDEC", "WWWWWWWWWWWWWWW", "A").withColumn("candidate_id", F.col("sequence"))
    rows = score_modes(public).collect()
    assert len(rows) == 4 * len(fixed.MODE_WEIGHTS)
    assert all(0.0 <= row.score <= 1.0 for row in rows)


def test_net_charge_matches_plain_python(spark):
    def plain(s, ph):
        side = sum(features.residue_charge(a, ph) for a in s)
        return features.end_charge(ph) + side

    for s in ("VPP", "KRHDECY", "G"):
        got = one(spark, features.net_charge(F.lit(s), 6.8))
        assert got == pytest.approx(plain(s, 6.8), abs=1e-12)


@pytest.mark.parametrize("hits,pop,suc,draws", [(6, 58192, 52, 582), (4, 16305, 4, 164), (2, 50, 20, 30), (25, 50, 30, 45), (1, 10, 3, 10)])
def test_hypergeometric_tail_against_exact_sum(spark, hits, pop, suc, draws):
    exact = sum(math.comb(suc, k) * math.comb(pop - suc, draws - k) for k in range(hits, min(suc, draws) + 1) if draws - k <= pop - suc)
    exact /= math.comb(pop, draws)
    got = one(spark, F.expr(mathx.hypergeometric_tail(str(hits), str(pop), str(suc), str(draws))))
    assert got == pytest.approx(exact, rel=1e-8)


def test_hypergeometric_published_value_and_guards(spark):
    tail = lambda *a: one(spark, F.expr(mathx.hypergeometric_tail(*map(str, a))))
    assert tail(6, 58192, 52, 582) == pytest.approx(1.3439959693947684e-05, rel=1e-8)
    assert tail(4, 16305, 4, 164) == pytest.approx(9.868450246137669e-09, rel=1e-8)
    assert tail(0, 100, 5, 10) == 1.0
    assert tail(6, 100, 5, 10) == 0.0
    assert math.isnan(tail(1, 0, 0, 0))


def test_hypergeometric_with_a_large_marked_set(spark):
    """The sum window must not lose mass when the start lies far below the mean."""
    got = one(spark, F.expr(mathx.hypergeometric_tail("10", "1000000", "400000", "10000")))
    assert got == pytest.approx(1.0, abs=1e-6)
    upper = one(spark, F.expr(mathx.hypergeometric_tail("4000", "1000000", "400000", "10000")))
    assert 0.5 < upper < 0.51


def test_sign_test_and_digamma(spark):
    assert one(spark, F.expr(mathx.sign_test("8", "10"))) == pytest.approx(2 * (45 + 10 + 1) / 1024, rel=1e-9)
    assert one(spark, F.expr(mathx.sign_test("5", "10"))) == 1.0
    harmonic = one(spark, mathx.digamma(F.lit(11.0)) - mathx.digamma(F.lit(1.0)))
    assert harmonic == pytest.approx(sum(1 / k for k in range(1, 11)), abs=1e-10)


def test_safe_casts_and_weights(spark):
    assert one(spark, mathx.safe_double(F.lit("x"), 2.5)) == 2.5
    assert one(spark, mathx.safe_double(F.lit("NaN"), 1.5)) == 1.5
    assert one(spark, mathx.safe_int(F.lit("7.9"))) == 7
    assert one(spark, mathx.potency_weight(F.lit(1.0), 1000.0, 3.0)) == 3.0
    assert one(spark, mathx.potency_weight(F.lit(0.0), 1000.0, 5.0)) == 5.0
    assert one(spark, mathx.potency_weight(F.lit(100.0), 1000.0, 5.0)) == pytest.approx(2.0)


@pytest.mark.parametrize(
    "potency,mass,expected",
    [
        ("12.5 uM", "", 12.5), ("2 mM", "", 2000.0), ("3 µM", "", 3.0), ("3 μM", "", 3.0), ("5 mg/ml", "500", 10000.0),
        ("250 ug/ml", "500", 500.0), ("0 uM", "", None), ("-4 uM", "", None), ("40 %", "", None), ("ND", "", None),
        ("5 mg/ml", "", None), ("5 mg/ml", "0", None), ("7", "100", None),
    ],
)
def test_export_potency_units(spark, potency, mass, expected):
    got = one(spark, text.export_potency_um(F.lit(potency), F.lit(mass)))
    assert got == (pytest.approx(expected) if expected is not None else None)


def test_range_potency_and_readout(spark):
    note = F.lit("IC50 values from 1.2 to 3.4 mM in vitro")
    parsed = {n: one(spark, c) for n, c in text.range_potency(note).items()}
    assert parsed == {
        "value_low": 1.2, "value_high": 3.4, "value_text": "1.2-3.4", "unit": "mM",
        "um_low": pytest.approx(1200.0), "um_high": pytest.approx(3400.0),
    }
    assert one(spark, text.readout_class(note)) == "IC50"
    assert one(spark, text.readout_class(F.lit("no number"))) == "activity_reported"
    mass = {n: one(spark, c) for n, c in text.range_potency(F.lit("IC50 80 ug per mL")).items()}
    assert mass["unit"] == "ug/mL" and mass["um_low"] is None


def test_slices_and_tokens(spark):
    s = F.lit("VPP")
    assert one(spark, text.first_slice(s, 2, 2)) == "_"
    assert one(spark, text.last_slice(s, 1, 2)) == "VP"
    assert one(spark, text.suffix(F.lit("K"), 2)) is None
    assert one(spark, text.edge_ngrams(F.lit("AB"))) == ["first_1=A", "last_1=B", "first_2=AB", "last_2=AB"]
    shares = {t.token: t.value for t in one(spark, text.kmer_tokens(F.lit("AAAB")))}
    assert shares == {"kmer_2=AA": pytest.approx(2 / 3), "kmer_2=AB": pytest.approx(1 / 3), "kmer_3=AAA": 0.5, "kmer_3=AAB": 0.5}


def test_group_key(spark):
    key = lambda label, origin: one(
        spark, text.parent_of(F.lit(label), F.lit(origin), F.lit("SELF"), F.lit("ID"), fixed.POSITIVE_LABELS)
    )
    assert key("known_positive", "") == "SELF"
    assert key("matched_decoy", "composition_shuffle:VPP") == "VPP"
    assert key("matched_decoy", "other:VPP") == "ID"


def test_run_features_count_excess(spark):
    # AAAA is a run of four (excess 2); FWW adds its own F/W run of three (excess 2) and joins the long run.
    raw = {n: one(spark, c) for n, c in features.run_features(F.lit("GAAAAGKKKK")).items()}
    assert raw["bitterness_raw"] == pytest.approx(2 / 10)
    assert raw["toxicity_raw"] == pytest.approx(2 / 10)
    assert one(spark, features.run_features(F.lit("CWCW"))["toxicity_raw"]) == pytest.approx(0.5 * 2 / 4)


def test_developability_cascade(spark):
    flag = lambda s, w, t, p: one(spark, features.developability_flag(F.lit(s), F.lit(w), F.lit(t), F.lit(p)))
    assert flag("VPP", float("nan"), 1.0, 1.0) == "descriptor_unavailable"
    assert flag("VPP", 100.0, 1.0, 1.0) == "mw_outside_peptide_screen"
    assert flag("VPP", 300.0, 700.0, 1.0) == "high_tpsa"
    assert flag("VPP", 300.0, 600.0, 7.0) == "high_logp"
    assert flag("VPPPP", 300.0, 600.0, 1.0) == "homopolymer_run"
    assert flag("VPPP", 300.0, 600.0, 1.0) == "screen_pass"


def test_round_to_is_half_even_and_keeps_missing(spark):
    assert one(spark, mathx.round_to(F.lit(0.5), 0)) == 0.0
    assert one(spark, mathx.round_to(F.lit(-1.2345678))) == -1.234568
    assert math.isnan(one(spark, mathx.round_to(F.lit(float("nan")))))
    assert one(spark, mathx.round_to(F.lit(None).cast("double"))) is None


def test_average_precision_terms_keep_their_digits_at_any_size(spark):
    from decimal import Decimal, getcontext

    from rankaudit.functions.mathx import harmonic_span

    getcontext().prec = 50
    cases = [(float(r), float(c), float(t)) for r in (0, 5, 63, 64, 1e4, 1e8, 1e10, 1e12) for c in (1, 7, 300) for t in (0, 3)]
    harmonic, ramp = harmonic_span(F.col("r"), F.col("c"))
    for row in spark.createDataFrame(cases, "r double, c double, t double").withColumn("v", F.col("t") * harmonic + ramp).collect():
        exact = sum((Decimal(int(row.t)) + k) / (Decimal(int(row.r)) + k) for k in range(1, int(row.c) + 1))
        assert abs((Decimal(row.v) - exact) / exact) < Decimal("1e-9"), row


def test_tail_probability_keeps_its_digits_at_any_size(spark):
    import math
    from decimal import Decimal, getcontext

    from rankaudit.functions.mathx import hypergeometric_tail

    getcontext().prec = 50

    def exact(h, n, k, d):
        total = Decimal(0)
        for x in range(h, min(k, d) + 1):
            mass = Decimal(math.comb(k, x))
            for i in range(x):
                mass *= Decimal(d - i) / Decimal(n - i)
            for i in range(k - x):
                mass *= Decimal(n - d - i) / Decimal(n - x - i)
            total += mass
        return total

    cases = [(6, 58192, 52, 582), (3, 10**8, 50, 10**6), (2, 10**10, 100, 10**8), (5, 10**12, 120, 10**10), (1, 30, 10, 5), (10, 30, 10, 20)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "h double, n double, k double, d double")
    for case, row in zip(cases, df.select(F.expr(hypergeometric_tail("h", "n", "k", "d")).alias("p")).collect()):
        assert abs((Decimal(row.p) - exact(*case)) / exact(*case)) < Decimal("1e-9"), case


def test_full_score_sums_unrounded_features(spark):
    """Some strings differ by 1e-6 when features are rounded first."""
    from rankaudit.functions import fixed
    from rankaudit.functions.features import FULL_SCORE, with_domain_features
    from rankaudit.functions.scoring import linear, mode_columns

    words = ["".join(c) for c in __import__("itertools").product("AKPDEW", "VRPE", "PLD", "AEP", "DEK", "PW", "AK")]
    rows = with_domain_features(spark.createDataFrame([(w,) for w in words], "sequence string"))
    exact, rounded_first = mode_columns()["sar"], mode_columns({"sar": dict(fixed.MODE_WEIGHTS["sar"])})["sar"]
    found = rows.select(exact.alias("a"), rounded_first.alias("b"), linear(fixed.MODE_WEIGHTS["sar"]).alias("c"), FULL_SCORE).collect()
    assert all(r.a == round(min(1.0, max(0.0, r[FULL_SCORE])), 6) for r in found)
    assert any(r.a != r.b for r in found) and all(abs(r.a - r.b) < 2e-6 for r in found)


def test_words_keep_every_letter(spark, sf_dir):
    from rankaudit.plans import inputs

    documents = inputs.table(spark, sf_dir, "documents")
    letters = documents.agg(F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("n")).first()["n"]
    words = inputs.document_words(spark, sf_dir)
    assert words.agg(F.sum(F.length("sequence") * F.col("n"))).first()[0] == letters
    assert words.where(F.length("sequence") > 12).count() > 0 and words.where(F.length("sequence") == 1).count() > 0
