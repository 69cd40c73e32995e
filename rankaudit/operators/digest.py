"""Rule-based fragmentation of long strings."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.fixed import CUT_RULES
from ..functions.mathx import let


def fragments(sequence: Column, rule: str, missed: int, shortest: int, longest: int) -> Column:
    """Distinct pieces between cuts with up to `missed` skipped cuts, within the length window."""
    if rule == "none":
        pieces = F.array(sequence)
    else:
        pieces = F.filter(F.split(sequence, CUT_RULES[rule]), lambda p: p != "")

    def joined(p: Column) -> Column:
        count = F.size(p)

        def spans_from(i: Column) -> Column:
            reach = F.sequence(F.lit(1), F.least(F.lit(missed + 1), count - i + F.lit(1)))
            return F.transform(reach, lambda k: F.array_join(F.slice(p, i, k), ""))

        spans = F.flatten(F.transform(F.sequence(F.lit(1), count), spans_from))
        kept = F.filter(spans, lambda s: F.length(s).between(shortest, longest))
        return F.when(count > 0, F.array_distinct(kept)).otherwise(F.array().cast("array<string>"))

    return let(pieces, joined)


def digest(
    proteins: DataFrame,
    rules: tuple[str, ...] = tuple(CUT_RULES),
    missed: int = 2,
    shortest: int = 2,
    longest: int = 12,
) -> DataFrame:
    """One row per (accession, rule, distinct fragment); every row is handled where it lies."""
    per_rule = F.array(
        *[
            F.struct(F.lit(i).alias("rule_order"), F.lit(rule).alias("rule"),
                     fragments(F.col("sequence"), rule, missed, shortest, longest).alias("found"))
            for i, rule in enumerate(rules)
        ]
    )
    opened = proteins.select("accession", "source_class", F.inline(per_rule))
    return opened.select(
        "accession", "source_class", "rule_order", "rule", F.explode("found").alias("sequence")
    )


#: A fragment as one number: five bits a letter from the left, so numbers stand in the order of the texts. Four bits are left for the rules.
CODE_LETTERS, _BITS, _MASK_BITS = 12, 5, 4
_LETTERS = " ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _place(letter: int) -> int:
    return _BITS * (CODE_LETTERS - 1 - letter)


def _cut_table(rule: str) -> np.ndarray:
    """Whether a rule cuts between two letters, for every pair; rules look at one letter on either side."""
    signs = "\n" + _LETTERS.strip()
    return np.array([re.compile(rule).match(before + after, 1) is not None for before in signs for after in signs])


def _cut_fragments(sequences: list[str], cuts: list[np.ndarray], missed: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All fragments of up to 65,536 strings, in NumPy: the place of their string, and their code with the number of the rule in two bits below."""
    signs = np.frombuffer(("\n" + "\n".join(sequences) + "\n").encode(), np.uint8)
    breaks = np.flatnonzero(signs == 10)
    if len(breaks) != len(sequences) + 1 or not ((signs == 10) | (signs >= 65) & (signs <= 90)).all():
        raise ValueError("fragment codes are for texts over A-Z")
    letters = np.where(signs == 10, 0, signs.astype(np.int64) - 64)
    pair = np.concatenate([[0], letters[:-1] * len(_LETTERS) + letters[1:]])
    padded = np.concatenate([letters, np.zeros(CODE_LETTERS, np.int64)])
    ahead = lambda codes, n: np.concatenate([codes[n:], np.zeros(n, np.int64)])
    two = padded << _BITS | ahead(padded, 1)
    four = two << 2 * _BITS | ahead(two, 2)
    eight = four << 4 * _BITS | ahead(four, 4)
    twelve = eight << 4 * _BITS | ahead(four, 8)
    heads = np.array([-1 << _BITS * (CODE_LETTERS - n) for n in range(CODE_LETTERS + 1)], np.int64)
    owners, values = [], []
    for number, table in enumerate(cuts):
        cut = table[pair]
        cut[breaks[:-1] + 1] = cut[breaks[1:]] = True
        cut[0] = False
        bounds = np.flatnonzero(cut)
        owner = np.searchsorted(breaks[:-1] + 1, bounds, "right") - 1
        for k in range(1, missed + 2):
            size = bounds[k:] - bounds[:-k]
            kept = np.flatnonzero((owner[:-k] == owner[k:]) & (size >= shortest) & (size <= longest))
            owners.append(owner[kept].astype(np.uint16))
            values.append((twelve[bounds[kept]] & heads[size[kept]]) << 2 | number)
    return np.concatenate(owners), np.concatenate(values)


def packed_fragments(sequences: list[str], cuts: list[np.ndarray], missed: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments of up to 65,536 strings: codes with the rules as bits on top, and how many each string has."""
    owner, value = _cut_fragments(sequences, cuts, missed, shortest, longest)
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(sequences)))
    for first, last in zip([0, *ends[:-1]], ends):
        value[first:last].sort()
    code, bit = value >> 2, np.int64(1) << (value & 3)
    changed = np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[: len(code)]
    first = np.flatnonzero(changed)
    mask = np.bitwise_or.reduceat(bit, first) if len(first) else bit
    return code[first] | mask << _BITS * CODE_LETTERS, np.bincount(owner[first], minlength=len(sequences))


def fragment_codes(
    proteins: DataFrame,
    rules: tuple[str, ...] = tuple(CUT_RULES),
    missed: int = 2,
    shortest: int = 2,
    longest: int = CODE_LETTERS,
) -> DataFrame:
    """The fragments of `digest` as numbers: one row per row of `proteins` and distinct fragment, with the rules that yield it as bits.

    For strings over A-Z, fragments of up to twelve letters and up to four rules; other strings fail. `sequence` gives way to `rules` and `code`.
    """
    if longest > CODE_LETTERS or len(rules) > _MASK_BITS:
        raise ValueError("fragment codes hold twelve letters and four rules")
    cuts = [_cut_table(CUT_RULES[rule]) for rule in rules]
    kept = [field for field in proteins.schema.fields if field.name != "sequence"]
    names = [field.name for field in kept]

    def pack(batches):
        for batch in batches:
            size = 1024
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                sequences = [s or "" for s in part.column("sequence").to_pylist()]
                packed, counts = packed_fragments(sequences, cuts, missed, shortest, longest)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], found], [*names, "found"])

    schema = proteins.select(*names).schema.add("found", ArrayType(LongType()))
    opened = proteins.mapInArrow(pack, schema).select(*names, F.explode("found").alias("_packed"))
    shift = _BITS * CODE_LETTERS
    return opened.select(
        *names, F.shiftrightunsigned("_packed", shift).cast("int").alias("rules"), F.col("_packed").bitwiseAND(F.lit((1 << shift) - 1)).alias("code"),
    )


def distinct_codes(
    proteins: DataFrame,
    rules: tuple[str, ...] = tuple(CUT_RULES),
    missed: int = 2,
    shortest: int = 2,
    longest: int = CODE_LETTERS,
) -> DataFrame:
    """The fragments of `fragment_codes` without rules and owners, each once as `code`; a task takes copies out of its batches before it makes rows."""
    if longest > CODE_LETTERS or len(rules) > _MASK_BITS:
        raise ValueError("fragment codes hold twelve letters and four rules")
    cuts = [_cut_table(CUT_RULES[rule]) for rule in rules]

    def pack(batches):
        for batch in batches:
            column, size, found = batch.column("sequence"), 1024, [np.empty(0, np.int64)]
            for at in range(0, batch.num_rows, size):
                sequences = [s or "" for s in column.slice(at, size).to_pylist()]
                found.append(np.unique(_cut_fragments(sequences, cuts, missed, shortest, longest)[1] >> 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["code"])

    return proteins.select("sequence").mapInArrow(pack, "code bigint").distinct()


def _letter(code: Column, i: int) -> Column:
    return F.shiftright(code, _place(i)).bitwiseAND(F.lit(31).cast("bigint")).cast("int")


def code_text(code: Column) -> Column:
    """The fragment that a code stands for."""
    return F.rtrim(F.concat(*[F.substring(F.lit(_LETTERS), _letter(code, i) + F.lit(1), F.lit(1)) for i in range(CODE_LETTERS)]))


def code_length(code: Column) -> Column:
    return reduce(Column.__add__, [(_letter(code, i) > 0).cast("int") for i in range(CODE_LETTERS)])
