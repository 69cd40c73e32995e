"""Fixed values. Results are only comparable when these stay as they are."""

# Residue alphabet and residue classes.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AILMFWYV"
AROMATIC = "FWY"
BASIC = "KRH"
ACIDIC = "DE"
CHARGED = "DEKRH"
POLAR = "STNQY"
END_ANCHOR = "PAILMFWYV"

# Hydropathy scale.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# Acid dissociation constants of side chains and chain ends.
PKA_POSITIVE = {"K": 10.5, "R": 12.5, "H": 6.5}
PKA_NEGATIVE = {"D": 3.9, "E": 4.1, "C": 8.5, "Y": 10.1}
PKA_FIRST = 8.0
PKA_LAST = 3.1

# Average residue masses (Da, water removed) and the mass of water.
RESIDUE_MASS = {
    "A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411,
    "I": 113.1594, "K": 128.1741, "L": 113.1594, "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307,
    "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760,
}
WATER_MASS = 18.01528
HELIX, TURN, SHEET = "VIYFWL", "NPGS", "EMAL"

# Step table of preferred lengths (low, high, score).
LENGTH_STEPS = ((2, 2, 0.78), (3, 3, 1.0), (4, 4, 0.82), (5, 5, 0.72), (6, 8, 0.46), (9, 12, 0.22))

# Linear weights per score mode over the feature columns.
MODE_WEIGHTS = {
    "sar": {
        "short_score": 0.18, "cterm_anchor": 0.16, "cterm_proline": 0.12, "cterm_aromatic": 0.07,
        "penultimate_proline": 0.12, "antepenult_anchor": 0.08, "nterm_hydrophobic": 0.09,
        "second_basic_or_proline": 0.08, "third_proline": 0.07, "hydrophobic_balance": 0.10,
        "proline_balance": 0.09, "charge_balance": 0.05, "triad": 0.12,
        "acidic_penalty": -0.12, "cysteine_penalty": -0.18, "extreme_charge_penalty": -0.10,
    },
    "pharmacophore": {
        "short_score": 0.16, "cterm_anchor": 0.15, "cterm_proline": 0.12, "cterm_aromatic": 0.07,
        "penultimate_proline": 0.11, "antepenult_anchor": 0.08, "nterm_hydrophobic": 0.08,
        "second_basic_or_proline": 0.07, "third_proline": 0.06, "hydrophobic_balance": 0.08,
        "proline_balance": 0.07, "charge_balance": 0.05, "triad": 0.10,
        "acidic_penalty": -0.10, "cysteine_penalty": -0.16, "extreme_charge_penalty": -0.08,
    },
    "no_proline_motif": {
        "short_score": 0.18, "cterm_hydrophobic": 0.14, "cterm_aromatic": 0.10, "antepenult_anchor": 0.12,
        "nterm_hydrophobic": 0.10, "second_basic": 0.08, "hydrophobic_balance": 0.12,
        "proline_balance": 0.10, "charge_balance": 0.08,
        "acidic_penalty": -0.10, "cysteine_penalty": -0.16, "extreme_charge_penalty": -0.08,
    },
    "stability": {
        "length_balance": 0.18, "hydrophobic_balance": 0.18, "proline_balance": 0.16, "charge_balance": 0.12,
        "cterm_proline": 0.10, "penultimate_proline": 0.07, "nterm_hydrophobic": 0.07,
        "acid_free": 0.06, "cysteine_free": 0.06, "extreme_charge_penalty": -0.08,
    },
    "generic": {
        "length_balance": 0.20, "hydrophobic_balance": 0.20, "charge_balance": 0.18, "proline_balance": 0.16,
        "aromatic_balance": 0.12, "acid_free": 0.08, "cysteine_free": 0.06, "extreme_charge_penalty": -0.10,
    },
    "no_position": {
        "length_balance": 0.22, "hydrophobic_balance": 0.22, "proline_balance": 0.20, "charge_balance": 0.16,
        "aromatic_balance": 0.12,
        "acidic_penalty": -0.12, "cysteine_penalty": -0.18, "extreme_charge_penalty": -0.10,
    },
}

# Feature columns whose weight each ablation takes out of the full score.
ABLATION_REMOVES = {
    "no_triad": ("triad",),
    "no_cterm_bonus": ("cterm_proline",),
    "no_position": (
        "cterm_anchor", "cterm_proline", "cterm_aromatic", "penultimate_proline", "antepenult_anchor",
        "nterm_hydrophobic", "second_basic_or_proline", "third_proline", "triad",
    ),
}
COMPOSITION_TERMS = (
    "short_score", "hydrophobic_balance", "proline_balance", "charge_balance",
    "acidic_penalty", "cysteine_penalty", "extreme_charge_penalty",
)

# General composition baseline, (residues, target, width, weight) and (residue, limit, weight).
BASELINE_TARGETS = (
    ("F", 0.073, 0.10, 0.24), ("G", 0.10, 0.14, 0.18), ("C", 0.035, 0.07, 0.10),
    (HYDROPHOBIC, 0.42, 0.42, 0.16), (CHARGED, 0.18, 0.24, 0.14),
)
BASELINE_LIMITS = (("E", 0.12, 0.10), ("T", 0.12, 0.08))
BASELINE_SHARES = (0.35, 0.65)

# Logistic centres and scales, and signed weights, of the run-feature score.
LOGISTIC = {
    "aromatic": (0.22, 0.06), "basic": (0.18, 0.06), "solubility": (0.0, 0.2),
    "toxicity": (0.15, 0.05), "bitterness": (0.20, 0.07),
}
RUN_WEIGHTS = {
    "aromatic": 0.12, "basic": 0.10, "turn": 0.10, "length": 0.06,
    "charge": 0.04, "solubility": 0.04, "toxicity": -0.03, "bitterness": 0.03,
}
TURN_BONUS = {"proline": 0.6, "glycine_next_to_proline": 0.2, "aromatic_three_apart": 0.2, "cap": 1.0}
HISTIDINE_CAP = 0.5

# Labels.
POSITIVE_LABELS = ("known_positive", "digestome_known_positive")
MATCHED_LABEL = "matched_decoy"
NEGATIVE_LABELS = ("matched_decoy", "random_background", "digestome_background")

# Cut rules as (residues before the cut, residues that block it after, residues after the cut).
CUT_RULES = {
    "trypsin": r"(?<=[KR])(?!P)",
    "chymotrypsin": r"(?<=[FWYL])(?!P)",
    "pepsin_like": r"(?<=[FLWY])",
    "thermolysin_like": r"(?<!^)(?=[AFILMV])",
}

# Text patterns of reported potencies.
POTENCY_UM = r"IC50\s+([0-9.]+)\s+uM"
POTENCY_UM_OR_ABOVE = r"IC50 (?:greater than )?([0-9.]+) uM"
POTENCY_PERCENT = r"inhibitory potency ([0-9.]+) percent"
POTENCY_RETAINED = r"retained best parsed IC50 ([0-9.eE+-]+) uM"
POTENCY_RANGE = (
    r"(?i)IC50(?: values? (?:from|between|range from))?[^0-9]{0,40}([0-9]+(?:\.[0-9]+)?)"
    r"(?:\s*(?:-|to)\s*([0-9]+(?:\.[0-9]+)?))?\s*(uM|µM|mM|ug/mL|ug per mL|mg/mL|mg per mL)"
)
INHIBITION_PERCENT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*percent\s+ACE inhibition"
