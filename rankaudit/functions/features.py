"""Feature columns of a residue string, all closed-form column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .mathx import clamp01, let, logistic, round_to, triangular
from .text import add_all, at, count_of, fraction_of, in_class, residue_values


def hydropathy(sequence: Column) -> Column:
    total = add_all([count_of(sequence, aa) * F.lit(kd) for aa, kd in fixed.HYDROPATHY.items()])
    return F.coalesce(total / F.nullif(F.length(sequence), F.lit(0)), F.lit(0.0))


def residue_charge(letter: str, ph: float) -> float:
    """Charge of one side chain at `ph`, a plan-time constant."""
    if letter in fixed.PKA_POSITIVE:
        return 1.0 / (1.0 + 10 ** (ph - fixed.PKA_POSITIVE[letter]))
    if letter in fixed.PKA_NEGATIVE:
        return -1.0 / (1.0 + 10 ** (fixed.PKA_NEGATIVE[letter] - ph))
    return 0.0


def end_charge(ph: float) -> float:
    first = 1.0 / (1.0 + 10 ** (ph - fixed.PKA_FIRST))
    last = -1.0 / (1.0 + 10 ** (fixed.PKA_LAST - ph))
    return first + last


CHARGED_LETTERS = tuple(fixed.PKA_POSITIVE) + tuple(fixed.PKA_NEGATIVE)


def net_charge(sequence: Column, ph: float = 7.4) -> Column:
    sides = [count_of(sequence, aa) * F.lit(residue_charge(aa, ph)) for aa in CHARGED_LETTERS]
    total = F.lit(end_charge(ph)) + add_all(sides)
    return F.when(F.length(sequence) > 0, total).otherwise(F.lit(0.0))


def with_composition(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Length, hydropathy, charge, class fractions and the 20 residue fractions."""
    s = F.col(sequence)
    shares = {f"frac_{aa.lower()}": round_to(fraction_of(s, aa)) for aa in fixed.ALPHABET}
    return df.withColumns(
        {
            "length": F.length(s),
            "hydropathy": round_to(hydropathy(s)),
            "charge": round_to(net_charge(s)),
            "frac_aromatic": round_to(fraction_of(s, fixed.AROMATIC)),
            "frac_proline": round_to(fraction_of(s, "P")),
            "frac_acidic": round_to(fraction_of(s, fixed.ACIDIC)),
            **shares,
        }
    )


def length_preference(length: Column) -> Column:
    score = F.lit(0.0)
    for low, high, value in fixed.LENGTH_STEPS:
        score = F.when(length.between(low, high), F.lit(value)).otherwise(score)
    return score


def length_balance(length: Column) -> Column:
    return F.when(length.between(2, 14), triangular(length.cast("double"), 5.0, 7.0)).otherwise(F.lit(0.0))


DOMAIN_FEATURES = (
    "short_score", "cterm_anchor", "cterm_proline", "cterm_aromatic", "penultimate_proline", "antepenult_anchor",
    "nterm_hydrophobic", "second_basic_or_proline", "third_proline", "hydrophobic_fraction", "aromatic_fraction",
    "basic_fraction", "acidic_fraction", "proline_fraction", "hydrophobic_balance", "proline_balance", "net_charge",
    "charge_balance", "triad", "acidic_penalty", "cysteine_penalty", "extreme_charge_penalty", "hydropathy",
)
FULL_SCORE = "_full_score"
MODE_ONLY_FEATURES = (
    "cterm_hydrophobic", "second_basic", "length_balance", "aromatic_balance", "acid_free", "cysteine_free",
)


def _letter_counts(sequence: Column) -> dict[str, Column]:
    return {f"_n_{aa}": count_of(sequence, aa) for aa in fixed.ALPHABET}


def _share(letters: str) -> Column:
    """Share of a residue class from the counted letters."""
    total = add_all([F.col(f"_n_{aa}") for aa in letters])
    return F.coalesce(total / F.nullif(F.col("length"), F.lit(0)), F.lit(0.0))


def _weighted(weights: dict[str, float]) -> Column:
    return add_all([F.col(f"_n_{aa}") * F.lit(w) for aa, w in weights.items()])


def with_domain_features(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Terminal anchors, balances, penalties and the triad interaction, rounded to 6, and the unrounded full score.

    The full score sums features before they are rounded; the other modes read the rounded ones. Letters are counted once per row; every later projection is arithmetic on the counts.
    """
    s = F.col(sequence)
    first, second, third = at(s, 1), at(s, 2), at(s, 3)
    last, before_last, third_last = at(s, -1), at(s, -2), at(s, -3)
    counted = df.withColumns({"length": F.length(s), **_letter_counts(s)})
    charges = {aa: residue_charge(aa, 7.4) for aa in CHARGED_LETTERS}
    base = counted.withColumns(
        {
            "_hydrophobic": _share(fixed.HYDROPHOBIC),
            "_aromatic": _share(fixed.AROMATIC),
            "_basic": _share(fixed.BASIC),
            "_acidic": _share(fixed.ACIDIC),
            "_proline": _share("P"),
            "_charge": F.when(F.col("length") > 0, F.lit(end_charge(7.4)) + _weighted(charges)).otherwise(F.lit(0.0)),
            "_hydropathy": F.coalesce(
                _weighted(fixed.HYDROPATHY) / F.nullif(F.col("length"), F.lit(0)), F.lit(0.0)
            ),
            "cterm_anchor": in_class(last, fixed.END_ANCHOR),
            "cterm_proline": in_class(last, "P"),
            "cterm_aromatic": in_class(last, fixed.AROMATIC),
            "penultimate_proline": in_class(before_last, "P"),
            "antepenult_anchor": in_class(third_last, fixed.HYDROPHOBIC + fixed.BASIC),
            "nterm_hydrophobic": in_class(first, fixed.HYDROPHOBIC),
            "second_basic_or_proline": in_class(second, fixed.BASIC + "P"),
            "third_proline": in_class(third, "P"),
            "cterm_hydrophobic": in_class(last, fixed.HYDROPHOBIC),
            "second_basic": in_class(second, fixed.BASIC),
            "cysteine_penalty": F.when(F.col("_n_C") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        }
    )
    strength = F.abs(F.col("_charge"))
    short_enough = F.when(F.col("length").between(3, 6), F.lit(1.0)).otherwise(F.lit(0.0))
    derived = base.withColumns(
        {
            "short_score": length_preference(F.col("length")),
            "length_balance": length_balance(F.col("length")),
            "hydrophobic_fraction": round_to(F.col("_hydrophobic")),
            "aromatic_fraction": round_to(F.col("_aromatic")),
            "basic_fraction": round_to(F.col("_basic")),
            "acidic_fraction": round_to(F.col("_acidic")),
            "proline_fraction": round_to(F.col("_proline")),
            "hydrophobic_balance": round_to(triangular(F.col("_hydrophobic"), 0.38, 0.38)),
            "proline_balance": round_to(triangular(F.col("_proline"), 0.32, 0.32)),
            "net_charge": round_to(F.col("_charge")),
            "charge_balance": round_to(triangular(strength, 0.45, 1.25)),
            "extreme_charge_penalty": round_to(F.greatest(F.lit(0.0), strength - F.lit(2.0)) / F.lit(3.0)),
            "hydropathy": round_to(F.col("_hydropathy")),
            "triad": F.col("nterm_hydrophobic") * F.col("second_basic_or_proline") * F.col("third_proline")
            * short_enough,
            "acidic_penalty": round_to(F.col("_acidic")),
        }
    )
    exact = {
        "hydrophobic_balance": triangular(F.col("_hydrophobic"), 0.38, 0.38),
        "proline_balance": triangular(F.col("_proline"), 0.32, 0.32),
        "charge_balance": triangular(strength, 0.45, 1.25),
        "acidic_penalty": F.col("_acidic"),
        "extreme_charge_penalty": F.greatest(F.lit(0.0), strength - F.lit(2.0)) / F.lit(3.0),
    }
    full = add_all([F.lit(w) * exact.get(name, F.col(name)) for name, w in fixed.MODE_WEIGHTS["sar"].items()])
    finished = derived.withColumns(
        {
            FULL_SCORE: full,
            "aromatic_balance": triangular(F.col("aromatic_fraction"), 0.12, 0.22),
            "acid_free": F.lit(1.0) - F.col("acidic_penalty"),
            "cysteine_free": F.lit(1.0) - F.col("cysteine_penalty"),
        }
    )
    helpers = ["_hydrophobic", "_aromatic", "_basic", "_acidic", "_proline", "_charge", "_hydropathy"]
    return finished.drop(*helpers, *_letter_counts(s))


def baseline_score(sequence: Column) -> Column:
    """General composition and length score in [0, 1], rounded to 10."""
    n = F.length(sequence)
    window = (
        F.when(n.between(4, 20), F.lit(1.0))
        .when(n.between(2, 3), F.lit(0.55) + F.lit(0.15) * (n - F.lit(2)))
        .when(n.between(21, 35), F.greatest(F.lit(0.0), F.lit(1.0) - (n - F.lit(20)) / F.lit(15.0)))
        .otherwise(F.lit(0.0))
    )
    parts = [
        F.lit(weight) * triangular(fraction_of(sequence, letters), target, width)
        for letters, target, width, weight in fixed.BASELINE_TARGETS
    ]
    parts += [
        F.lit(weight) * (F.lit(1.0) - F.least(F.lit(1.0), fraction_of(sequence, letter) / F.lit(limit)))
        for letter, limit, weight in fixed.BASELINE_LIMITS
    ]
    share_length, share_composition = fixed.BASELINE_SHARES
    score = F.lit(share_length) * window + F.lit(share_composition) * add_all(parts)
    return F.when(n > 0, round_to(clamp01(score), 10)).otherwise(F.lit(0.0))


def engagement(sequence: Column) -> Column:
    """Capped, weighted shares of basic, aromatic and hydrophobic residues."""
    def capped(letters: str, limit: float) -> Column:
        return F.least(fraction_of(sequence, letters) / F.lit(limit), F.lit(1.0))

    return clamp01(
        F.lit(0.4) * capped(fixed.BASIC, 0.35)
        + F.lit(0.3) * capped(fixed.AROMATIC, 0.25)
        + F.lit(0.3) * capped(fixed.HYDROPHOBIC, 0.6)
    )


def exposure(sequence: Column) -> Column:
    return clamp01((F.lit(4.5) - hydropathy(sequence)) / F.lit(9.0))


def side_charges(ph: float) -> dict[str, float]:
    return {aa: residue_charge(aa, ph) for aa in CHARGED_LETTERS}


def uptake_index(sequence: Column, ph: float = 6.8) -> Column:
    """Mean over all 2- and 3-residue windows of neutrality, hydrophobic start and mild hydropathy."""
    size = F.length(sequence)
    one, zero = F.lit(1.0), F.lit(0.0)
    values = F.struct(
        residue_values(sequence, fixed.HYDROPATHY).alias("kd"),
        residue_values(sequence, side_charges(ph)).alias("charge"),
    )

    def window_scores(v: Column, width: int) -> Column:
        def score(i: Column) -> Column:
            kd = [F.get(v["kd"], i + F.lit(j)) for j in range(width)]
            charge = F.lit(end_charge(ph)) + add_all([F.get(v["charge"], i + F.lit(j)) for j in range(width)])
            neutral = one - F.least(F.abs(charge) / F.lit(2.0), one)
            start = F.greatest(zero, F.least(one, kd[0] / F.lit(2.5)))
            mild = one - F.least(F.abs(add_all(kd) / F.lit(float(width)) - F.lit(0.5)) / F.lit(3.0), one)
            return (neutral + start + mild) / F.lit(3.0)

        starts = F.when(size >= width, F.sequence(F.lit(0), size - F.lit(width)))
        return F.coalesce(F.transform(starts, score), F.array().cast("array<double>"))

    scores = let(values, lambda v: F.concat(window_scores(v, 2), window_scores(v, 3)))
    mean = let(scores, lambda s: F.aggregate(s, zero, lambda a, b: a + b) / F.size(s))
    return F.when(size >= 2, clamp01(mean)).otherwise(zero)


def hydrophobic_moment(sequence: Column, degrees: float = 100.0) -> Column:
    """Length-normalised vector sum of hydropathy around a helix."""
    step = math.radians(degrees)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def turn(acc: Column, kd: Column) -> Column:
        angle = F.lit(step) * acc["at"]
        return F.struct(
            (acc["at"] + F.lit(1)).alias("at"),
            (acc["x"] + kd * F.cos(angle)).alias("x"),
            (acc["y"] + kd * F.sin(angle)).alias("y"),
        )

    length = lambda acc: F.sqrt(acc["x"] * acc["x"] + acc["y"] * acc["y"])
    total = F.aggregate(residue_values(sequence, fixed.HYDROPATHY), zero, turn, length)
    return F.when(F.length(sequence) > 0, total / F.length(sequence)).otherwise(F.lit(0.0))


def run_excess(sequence: Column, letters: str, shortest: int) -> Column:
    """Sum over runs of at least `shortest` of (run length - shortest + 1)."""
    runs = F.regexp_extract_all(sequence, F.lit(f"([{letters}]{{{shortest},}})"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - F.lit(shortest - 1))


def run_features(sequence: Column) -> dict[str, Column]:
    """Turn, length, charge, run and motif features."""
    n = F.length(sequence)
    size = F.nullif(n, F.lit(0))
    histidine = F.least(count_of(sequence, "H").cast("double"), F.lit(fixed.HISTIDINE_CAP) * n)
    bonus = fixed.TURN_BONUS
    turn = F.least(
        F.lit(bonus["cap"]),
        F.when(sequence.contains("P"), F.lit(bonus["proline"])).otherwise(F.lit(0.0))
        + F.when(sequence.rlike("GP|PG"), F.lit(bonus["glycine_next_to_proline"])).otherwise(F.lit(0.0))
        + F.when(sequence.rlike("[FWY]..[FWY]"), F.lit(bonus["aromatic_three_apart"])).otherwise(F.lit(0.0)),
    )
    net = (
        count_of(sequence, "RK") + F.lit(0.1) * count_of(sequence, "H") - count_of(sequence, "DE")
    )
    bitter = run_excess(sequence, fixed.HYDROPHOBIC, 3) + run_excess(sequence, "FW", 2)
    rare = n - F.length(F.replace(sequence, F.lit("CW"), F.lit("C")))
    rare = rare + n - F.length(F.replace(sequence, F.lit("HW"), F.lit("H")))
    toxic = run_excess(sequence, "KR", 3) + F.lit(0.5) * rare
    zero = F.lit(0.0)
    return {
        "aromatic_fraction": fraction_of(sequence, fixed.AROMATIC),
        "basic_fraction": F.coalesce((count_of(sequence, "RK") + histidine) / size, zero),
        "turn_score": turn,
        "length_score": F.when(n > 0, F.greatest(zero, F.lit(1.0) - F.abs(n - F.lit(8.0)) / F.lit(4.0))).otherwise(zero),
        "net_charge": net,
        "charge_score": F.exp(-F.abs(net) / F.lit(3.0)),
        "solubility_input": fraction_of(sequence, fixed.POLAR) - fraction_of(sequence, fixed.HYDROPHOBIC),
        "toxicity_raw": F.coalesce(toxic / size, zero),
        "bitterness_raw": F.coalesce(bitter / size, zero),
    }


def run_transforms(values: dict[str, Column], settings: dict | None = None) -> dict[str, Column]:
    """Logistic or clamped transforms; `settings` overrides single centres and scales."""
    curve = {**fixed.LOGISTIC, **(settings or {})}
    return {
        "aromatic": logistic(values["aromatic_fraction"], *curve["aromatic"]),
        "basic": logistic(values["basic_fraction"], *curve["basic"]),
        "turn": clamp01(values["turn_score"]),
        "length": clamp01(values["length_score"]),
        "charge": clamp01(values["charge_score"]),
        "solubility": logistic(values["solubility_input"], *curve["solubility"]),
        "toxicity": logistic(values["toxicity_raw"], *curve["toxicity"]),
        "bitterness": logistic(values["bitterness_raw"], *curve["bitterness"]),
    }


def signed_weight_score(transforms: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean; a negative weight counts the complement."""
    merged = {**fixed.RUN_WEIGHTS, **(weights or {})}
    used = [(name, w) for name, w in merged.items() if w != 0 and name in transforms]
    total = sum(abs(w) for _, w in used)
    if total == 0:
        return F.lit(0.0)
    parts = [
        F.lit(abs(w)) * (transforms[name] if w > 0 else F.lit(1.0) - transforms[name]) for name, w in used
    ]
    return clamp01(add_all(parts) / F.lit(total))


def run_score(sequence: Column) -> Column:
    return signed_weight_score(run_transforms(run_features(sequence)))


# Terms of the run score that change when residues are reordered.
ORDER_TERMS = ("turn", "toxicity", "bitterness")


def _partial_score(transforms: dict[str, Column], names: list[str]) -> Column:
    """Share of the signed-weight score that the named terms add, before clamping."""
    total = sum(abs(w) for w in fixed.RUN_WEIGHTS.values())
    parts = []
    for name in names:
        w = fixed.RUN_WEIGHTS[name]
        parts.append(F.lit(abs(w)) * (transforms[name] if w > 0 else F.lit(1.0) - transforms[name]))
    return add_all(parts) / F.lit(total)


def run_score_kept(sequence: Column) -> Column:
    """Part of the run score that every reordering of the string shares."""
    kept = [name for name in fixed.RUN_WEIGHTS if name not in ORDER_TERMS]
    return _partial_score(run_transforms(run_features(sequence)), kept)


def run_score_moved(sequence: Column, kept: Column) -> Column:
    """Run score of a reordered string, given the shared part."""
    return clamp01(kept + _partial_score(run_transforms(run_features(sequence)), list(ORDER_TERMS)))


def molecular_weight(sequence: Column) -> Column:
    masses = [count_of(sequence, aa) * F.lit(mass) for aa, mass in fixed.RESIDUE_MASS.items()]
    return add_all(masses) + F.lit(fixed.WATER_MASS)


def residue_descriptors(sequence: Column) -> dict[str, Column]:
    """Descriptors with closed forms over residue counts."""
    aliphatic = (
        fraction_of(sequence, "A") + F.lit(2.9) * fraction_of(sequence, "V") + F.lit(3.9) * fraction_of(sequence, "IL")
    )
    return {
        "molecular_weight": molecular_weight(sequence),
        "aromaticity": fraction_of(sequence, fixed.AROMATIC),
        "mean_hydropathy": hydropathy(sequence),
        "aliphatic_index": F.lit(100.0) * aliphatic,
        "helix_fraction": fraction_of(sequence, fixed.HELIX),
        "turn_fraction": fraction_of(sequence, fixed.TURN),
        "sheet_fraction": fraction_of(sequence, fixed.SHEET),
    }


def developability_flag(sequence: Column, weight: Column, surface: Column, partition: Column) -> Column:
    """First failing screen; descriptors that are missing give their own flag."""
    missing = weight.isNull() | surface.isNull() | partition.isNull()
    missing = missing | F.isnan(weight) | F.isnan(surface) | F.isnan(partition)
    return (
        F.when(missing, "descriptor_unavailable")
        .when(~weight.between(250.0, 1500.0), "mw_outside_peptide_screen")
        .when(surface > 650.0, "high_tpsa")
        .when(partition > 6.0, "high_logp")
        .when(sequence.rlike(f"([{fixed.ALPHABET}])\\1\\1\\1"), "homopolymer_run")
        .otherwise("screen_pass")
    )
