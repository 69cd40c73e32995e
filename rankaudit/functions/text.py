"""String, pattern and identifier column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ALPHABET, INHIBITION_PERCENT, POTENCY_RANGE
from .mathx import let


def clean_sequence(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def is_canonical(sequence: Column) -> Column:
    return sequence.rlike(f"^[{ALPHABET}]+$")


def length_between(sequence: Column, low: int, high: int) -> Column:
    return F.length(sequence).between(low, high)


def candidate_id(sequence: Column, namespace: str, prefix: str = "CAND-") -> Column:
    digest = F.sha2(F.concat(F.lit(namespace + ":"), sequence), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 16))


def stable_id(prefix: str, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat(F.lit(prefix + "-"), F.substring(digest, 1, 16))


def clean_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def residues(sequence: Column) -> Column:
    return F.split(sequence, "")


def sorted_letters(sequence: Column) -> Column:
    return F.array_join(F.array_sort(residues(sequence)), "")


def count_of(sequence: Column, letters: str) -> Column:
    """How many characters of `sequence` are among `letters`."""
    if len(letters) == 1:
        return F.length(sequence) - F.length(F.replace(sequence, F.lit(letters), F.lit("")))
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def fraction_of(sequence: Column, letters: str) -> Column:
    return F.coalesce(count_of(sequence, letters) / F.nullif(F.length(sequence), F.lit(0)), F.lit(0.0))


def residue_values(sequence: Column, values: dict[str, float]) -> Column:
    """Array with the value of every residue, looked up by its place in the alphabet; 0 for others."""
    table = F.array(F.lit(0.0), *[F.lit(float(values.get(aa, 0.0))) for aa in ALPHABET])
    return F.transform(residues(sequence), lambda r: F.get(table, F.position(r, F.lit(ALPHABET))))


def at(sequence: Column, position: int) -> Column:
    """Character at a 1-based position, negative from the end; '' outside."""
    needed = abs(position)
    return F.when(F.length(sequence) >= needed, F.substring(sequence, position, 1)).otherwise(F.lit(""))


def in_class(letter: Column, letters: str) -> Column:
    return F.when(letter.isin(*letters), F.lit(1.0)).otherwise(F.lit(0.0))


def first_slice(sequence: Column, start: int, width: int) -> Column:
    """`width` characters after skipping `start`; '_' when the string is too short."""
    enough = F.length(sequence) >= start + width
    return F.when(enough, F.substring(sequence, start + 1, width)).otherwise(F.lit("_"))


def last_slice(sequence: Column, skip: int, width: int) -> Column:
    """`width` characters that end `skip` before the end; '_' when too short."""
    enough = F.length(sequence) >= skip + width
    return F.when(enough, F.substring(sequence, -(skip + width), width)).otherwise(F.lit("_"))


def suffix(sequence: Column, width: int) -> Column:
    return F.when(F.length(sequence) >= width, F.substring(sequence, -width, width))


def edge_ngrams(sequence: Column, longest: int = 3) -> Column:
    """Array of tokens for the first and last n characters, n up to `longest`."""
    tokens = []
    for n in range(1, longest + 1):
        enough = F.length(sequence) >= n
        tokens.append(F.when(enough, F.concat(F.lit(f"first_{n}="), F.substring(sequence, 1, n))))
        tokens.append(F.when(enough, F.concat(F.lit(f"last_{n}="), F.substring(sequence, -n, n))))
    return F.array_compact(F.array(*tokens))


def windows_of(sequence: Column, width: int) -> Column:
    """Every run of `width` neighbouring characters, in order."""
    starts = F.when(F.length(sequence) >= width, F.sequence(F.lit(1), F.length(sequence) - F.lit(width - 1)))
    cut = F.transform(starts, lambda i: F.substring(sequence, i, F.lit(width)))
    return F.coalesce(cut, F.array().cast("array<string>"))


def _kmer_shares(grams: Column, k: int) -> Column:
    def share(gram: Column) -> Column:
        hits = F.size(F.filter(grams, lambda g: g == gram))
        return F.struct(F.concat(F.lit(f"kmer_{k}="), gram).alias("token"), (hits / F.size(grams)).alias("value"))

    return F.transform(F.array_distinct(grams), share)


def kmer_tokens(sequence: Column, widths: tuple[int, ...] = (2, 3)) -> Column:
    """Array of (token, share) for the distinct inner k-mers of each width."""
    def shares(k: int) -> Column:
        return let(windows_of(sequence, k), lambda grams: _kmer_shares(grams, k))

    return F.concat(*[shares(k) for k in widths])


def position_tokens(sequence: Column) -> Column:
    """Categories: five characters from each end and pairs at three offsets per end."""
    tokens = []
    for i in range(5):
        tokens.append(F.concat(F.lit(f"first_pos_{i + 1}="), first_slice(sequence, i, 1)))
        tokens.append(F.concat(F.lit(f"last_pos_{i + 1}="), last_slice(sequence, i, 1)))
    for i in range(3):
        tokens.append(F.concat(F.lit(f"first_pair_{i + 1}="), first_slice(sequence, i, 2)))
        tokens.append(F.concat(F.lit(f"last_pair_{i + 1}="), last_slice(sequence, i, 2)))
    return F.array(*tokens)


def motif_flags(sequence: Column) -> dict[str, Column]:
    flags = {
        "ends_proline": sequence.endswith("P"),
        "ends_aromatic": sequence.rlike("[FWY]$"),
        "ends_basic": sequence.rlike("[KRH]$"),
        "ends_acidic": sequence.rlike("[DE]$"),
    }
    for motif in ("PP", "GP", "PR", "LRP", "YY"):
        flags[f"contains_{motif.lower()}"] = sequence.contains(motif)
    numbers = {name: flag.cast("double") for name, flag in flags.items()}
    numbers["length_squared"] = (F.length(sequence) * F.length(sequence)).cast("double")
    return numbers


def number_in(text: Column, pattern: str, group: int = 1) -> Column:
    """First number a pattern captures, NULL when it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def unit_name(unit: Column) -> Column:
    return F.replace(F.translate(F.trim(unit), "µμ", "uu"), F.lit(" per "), F.lit("/"))


def short_number(value: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(value.cast("decimal(24,6)").cast("string"), r"\.?0+$", "")


def range_potency(text: Column) -> dict[str, Column]:
    """Low and high value, unit and micromolar bounds of a reported potency or range."""
    low, high = number_in(text, POTENCY_RANGE, 1), number_in(text, POTENCY_RANGE, 2)
    unit = F.nullif(unit_name(F.regexp_extract(text, POTENCY_RANGE, 3)), F.lit(""))
    factor = F.when(F.lower(unit) == "um", F.lit(1.0)).when(F.lower(unit) == "mm", F.lit(1000.0))
    rendered = F.concat_ws("-", short_number(low), short_number(high))
    return {
        "value_low": low,
        "value_high": high,
        "value_text": F.nullif(rendered, F.lit("")),
        "unit": unit,
        "um_low": low * factor,
        "um_high": high * factor,
    }


def inhibition_percent(text: Column) -> Column:
    return number_in(text, INHIBITION_PERCENT)


def readout_class(text: Column) -> Column:
    return (
        F.when(text.rlike(POTENCY_RANGE), "IC50")
        .when(text.rlike(INHIBITION_PERCENT), "fixed_concentration_inhibition")
        .otherwise("activity_reported")
    )


def digestive_context(context: Column, notes: Column) -> Column:
    both = F.lower(F.concat_ws(" ", context, notes))
    return (
        F.when(both.contains("before digestion"), "pre_digestive_assay")
        .when(both.contains("after digestion"), "post_digestive_assay")
        .when(both.contains("digestion-released") | both.contains("gi digestion release"), "digestion_released_peptide")
        .when(both.contains("digestion") | both.contains("hydrolysate"), "hydrolysate_or_digest_context")
        .otherwise("not_specified")
    )


def evidence_strength(context: Column, notes: Column, readout: Column) -> Column:
    both = F.lower(F.concat_ws(" ", context, notes))
    return (
        F.when((readout == "IC50") & both.contains("synthesis"), "synthesized_peptide_ic50")
        .when(readout == "IC50", "reported_ic50")
        .when(readout == "fixed_concentration_inhibition", "fixed_concentration_activity")
        .otherwise("reported_activity")
    )


def export_potency_um(potency: Column, mass: Column) -> Column:
    """Micromolar value of a free-text potency; mass units need the molecular mass.

    NULL for zero or negative values, percentages, unknown units and missing masses.
    """
    value = number_in(potency, r"(?<![A-Za-z0-9.])(-?[0-9]+(?:\.[0-9]+)?)")
    mass_value = number_in(mass, r"([0-9]+(?:\.[0-9]+)?)")
    unit = F.lower(potency)
    for garbled in ("âî¼", "î¼", "âµ", "âµ", "μ"):
        unit = F.replace(unit, F.lit(garbled), F.lit("µ"))
    usable_mass = F.when(mass_value > 0, mass_value)
    return (
        F.when(value.isNull() | (value <= 0) | unit.contains("%"), F.lit(None).cast("double"))
        .when(unit.contains("mm"), value * 1000.0)
        .when(unit.contains("µm") | unit.contains("um"), value)
        .when(unit.contains("mg") & unit.contains("ml"), value / usable_mass * 1e6)
        .when(unit.contains("µg") | unit.contains("ug"), value * 0.001 / usable_mass * 1e6)
    )


def parent_of(label: Column, origin: Column, own: Column, fallback: Column, positives: tuple[str, ...]) -> Column:
    """Group key: a positive is its own parent, a decoy names it after `kind:`."""
    is_decoy = origin.startswith("composition_shuffle:") | origin.startswith("length_matched_random:")
    return (
        F.when(label.isin(*positives), own)
        .when(is_decoy, F.regexp_extract(origin, "^[^:]*:(.*)$", 1))
        .otherwise(fallback)
    )


def mutation(before: Column, position: Column, after: Column) -> Column:
    return F.concat(before, position.cast("string"), after)


def identity(left: Column, right: Column, distance: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / longest)


def sorted_set(value: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), ";")


def add_all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)
