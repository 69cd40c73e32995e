"""Decoys, random background and the blinded universe. All draws are keyed digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import ALPHABET
from ..functions.mathx import let
from ..functions.text import candidate_id, residues
from ..session import materialize, spread
from .ordering import global_rank, running_totals, top_per_group

_HEX = 4
_PER_DIGEST = 64 // _HEX


def draw_text(key: Column, length: Column) -> Column:
    """Hex text with `_HEX` digits per position, from as many digests as the length needs."""
    blocks = F.sequence(F.lit(0), F.floor((length - 1) / F.lit(_PER_DIGEST)).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(key, F.lit(":"), b.cast("string")), 256)), "")


def shuffle(sequence: Column, key: Column) -> Column:
    """Residues reordered by the key's digits; ties keep their order."""
    def tagged(digits: Column) -> Column:
        return F.transform(
            residues(sequence),
            lambda r, i: F.struct(
                F.substring(digits, i * F.lit(_HEX) + F.lit(1), F.lit(_HEX)).alias("draw"),
                i.alias("at"), r.alias("residue"),
            ),
        )

    ordered = F.array_sort(let(draw_text(key, F.length(sequence)), tagged))
    return F.array_join(F.transform(ordered, lambda t: t["residue"]), "")


def random_string(length: Column, key: Column) -> Column:
    """Letters picked by the key's digits."""
    def letters(digits: Column) -> Column:
        def pick(i: Column) -> Column:
            draw = F.conv(F.substring(digits, i * F.lit(_HEX) + F.lit(1), F.lit(_HEX)), 16, 10).cast("int")
            return F.substring(F.lit(ALPHABET), draw % F.lit(len(ALPHABET)) + F.lit(1), F.lit(1))

        return F.transform(F.sequence(F.lit(0), length - F.lit(1)), pick)

    return F.array_join(let(draw_text(key, length), letters), "")


def attempts(parents: DataFrame, count: int, start: int = 1) -> DataFrame:
    return parents.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(count))))


def shuffled_decoys(parents: DataFrame, per_parent: int, tries: int = 200, seed: str = "shuffle") -> DataFrame:
    """First `per_parent` distinct shuffles of each parent that differ from it.

    `parents` has one distinct string per row in `parent`. A string keeps its first attempt,
    found by a combined minimum, so only distinct decoys reach the per-parent limit. Parents that
    the first attempts serve in full are not tried further, which changes nothing in their result.
    """
    key = F.concat_ws(":", F.lit(seed), F.col("parent"), F.col("attempt").cast("string"))

    def distinct(some: DataFrame, start: int, count: int) -> DataFrame:
        tried = attempts(spread(some, "parent"), count, start).withColumn("sequence", shuffle(F.col("parent"), key))
        return tried.where(F.col("sequence") != F.col("parent")).groupBy("parent", "sequence").agg(F.min("attempt").alias("attempt"))

    head = min(tries, 4 * per_parent)
    found = distinct(parents.select("parent"), 1, head)
    if head < tries:
        served = found.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= per_parent)
        later = distinct(parents.select("parent").join(served, "parent", "left_anti"), head + 1, tries)
        found = found.unionByName(later).groupBy("parent", "sequence").agg(F.min("attempt").alias("attempt"))
    return top_per_group(found, ["parent"], [F.col("attempt")], per_parent, "ordinal")


def without(strings: DataFrame, taken: DataFrame) -> DataFrame:
    """Strings that are not in `taken`, a table that may be far larger.

    First `taken` is reduced to what is among the strings: there the strings are the side that can be broadcast, which an
    anti-join does not allow, so the large table is read in place while they are few. `strings` is read twice.
    """
    held = taken.select("sequence").join(strings.select("sequence"), "sequence", "left_semi").distinct()
    return strings.join(held, "sequence", "left_anti")


def _free(drawn: DataFrame, owner: list[str], taken: list[DataFrame]) -> DataFrame:
    """Distinct drawn strings that nothing has taken, each with its least owner."""
    owned = materialize(drawn.groupBy("sequence").agg(F.min(F.struct(*owner)).alias("owner")))
    for other in taken:
        owned = without(owned, other)
    return owned.select("sequence", "owner.*")


def _needs(quotas: DataFrame, accepted: DataFrame) -> DataFrame:
    """Parents that are short: parent, quota, how many they have and how many they need."""
    have = accepted.groupBy("parent").agg(F.count(F.lit(1)).alias("_have"))
    joined = quotas.join(have, "parent", "left").withColumn("have", F.coalesce("_have", F.lit(0)).cast("int")).drop("_have")
    return joined.withColumn("need", F.col("quota") - F.col("have")).where(F.col("need") > 0).select("parent", "quota", "have", "need")


def every_string(spark: SparkSession, length: int) -> DataFrame:
    """All strings of a length, spread over the cluster: the digits of a running number, written in letters."""
    base = len(ALPHABET)
    digits = [F.floor(F.col("id") / F.lit(base**i)).cast("bigint") % F.lit(base) for i in reversed(range(length))]
    letters = [F.substring(F.lit(ALPHABET), d.cast("int") + F.lit(1), F.lit(1)) for d in digits]
    return spark.range(base**length).select(F.concat(*letters).alias("sequence"))


def fill_from_free(needs: DataFrame, taken: list[DataFrame], seed: str = "fill") -> DataFrame:
    """What is left of each string space, dealt to the parents that are short, in the order of a keyed digest.

    The free strings of a length are numbered by digest, the needs of its parents by running sum, and equal numbers meet. So
    a parent stays short only when no string of its length is free. Only the lengths that are short are listed out; most of
    their strings are taken then, so the list is not much longer than the table that took them.
    """
    sized = needs.withColumn("length", F.length("parent"))
    slots = running_totals(sized, ["length"], [F.col("parent")], ["need"])
    first = F.col("cum_need") - F.col("need")
    slots = slots.select("parent", "have", "length", "total_need", F.posexplode(F.sequence(first + F.lit(1), F.col("cum_need"))).alias("_at", "slot"))
    found = None
    for row in sized.groupBy("length").agg(F.sum("need").alias("total")).collect():
        free = every_string(needs.sparkSession, row["length"])
        for other in taken:
            free = free.join(other.where(F.length("sequence") == row["length"]).select("sequence"), "sequence", "left_anti")
        drawn = free.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("sequence")), 256))
        ranked = global_rank(drawn, [], [F.col("_draw"), F.col("sequence")], "slot").where(F.col("slot") <= row["total"])
        own = ranked.join(slots.where(F.col("length") == row["length"]), "slot").select(
            "parent", "sequence", F.lit(None).cast("int").alias("attempt"), (F.col("have") + F.col("_at") + F.lit(1)).cast("int").alias("ordinal")
        )
        found = own if found is None else found.unionByName(own)
    return found


def random_decoys(
    quotas: DataFrame, taken: DataFrame, rounds: tuple[int, ...] = (2, 100), seed: str = "random"
) -> DataFrame:
    """Length-matched random strings until each parent's `quota` is met or no string of its length is free.

    In each round the parents that are short draw up to so many times their quota in all. Of what they draw, strings in
    `taken` and those of earlier rounds are left out, a string that several draw belongs to the earliest (attempt, parent),
    and a parent keeps its first ones. Who is short after the last round gets free strings by `fill_from_free`. One row per
    decoy: parent, sequence, attempt (null where filled), ordinal.
    """
    wanted = quotas.where(F.col("quota") > 0).select("parent", F.col("quota").cast("int").alias("quota"))
    needs = materialize(wanted.withColumns({"have": F.lit(0), "need": F.col("quota")}))
    key = F.concat_ws(":", F.lit(seed), F.col("parent"), F.col("attempt").cast("string"))
    parts: list[DataFrame] = []
    for low, high in zip((0, *rounds), rounds):
        tries = F.sequence(F.col("quota") * F.lit(low) + F.lit(1), F.col("quota") * F.lit(high))
        drawn = spread(needs, "parent").withColumn("attempt", F.explode(tries)).withColumn("sequence", random_string(F.length("parent"), key))
        free = _free(drawn, ["attempt", "parent", "have", "need"], [taken, *parts])
        ranked = top_per_group(free, ["parent"], [F.col("attempt")], 1 << 30, "ordinal").where(F.col("ordinal") <= F.col("need"))
        parts.append(materialize(ranked.select("parent", "sequence", "attempt", (F.col("ordinal") + F.col("have")).alias("ordinal"))))
        needs = materialize(_needs(wanted, reduce(DataFrame.unionByName, parts)))
        if needs.isEmpty():
            return reduce(DataFrame.unionByName, parts)
    return reduce(DataFrame.unionByName, [*parts, fill_from_free(needs, [taken, *parts])])


def _used_up(taken: list[DataFrame], shortest: int, longest: int) -> bool:
    """Whether all strings of these lengths over the alphabet are taken."""
    lengths = F.length("sequence").alias("length")
    strings = reduce(DataFrame.unionByName, [t.select("sequence") for t in taken]).where(F.col("sequence").rlike(f"^[{ALPHABET}]{{{shortest},{longest}}}$"))
    counts = {r["length"]: r["n"] for r in strings.distinct().groupBy(lengths).agg(F.count(F.lit(1)).alias("n")).collect()}
    return all(counts.get(n, 0) >= len(ALPHABET) ** n for n in range(shortest, longest + 1))


def random_background(
    keys: DataFrame, wanted: int, shortest: int, longest: int, taken: DataFrame, seed: str = "background",
) -> DataFrame:
    """The first `wanted` distinct random strings of uniform length that are not taken, in the order of (`draw`, `key`).

    Every key draws once, and rounds of twice as many draws go on until there are enough strings or none is free. The order
    of the draws is fixed, so the rounds do not change the result. Null and repeated keys draw nothing of their own.
    """
    name = F.concat_ws(":", F.lit(seed), F.col("key").cast("string"), F.col("draw").cast("string"))
    width = F.lit(longest - shortest + 1)
    parts: list[DataFrame] = []
    done, draws, missing = 0, 1, wanted
    keys = keys.select("key").where("key is not null").distinct()
    while missing > 0:
        sized = (
            keys.withColumn("draw", F.explode(F.sequence(F.lit(done + 1), F.lit(done + draws))))
            .withColumn("_name", name)
            .withColumn("_pick", F.conv(F.substring(F.sha2(F.concat(F.col("_name"), F.lit(":length")), 256), 1, 8), 16, 10))
            .withColumn("_length", (F.col("_pick").cast("long") % width).cast("int") + F.lit(shortest))
        )
        drawn = sized.withColumn("sequence", random_string(F.col("_length"), F.col("_name")))
        found = materialize(_free(drawn, ["draw", "key"], [taken, *parts]))
        parts.append(found)
        own, done = found.count(), done + draws
        draws, missing = done, missing - own
        if not own and (keys.isEmpty() or _used_up([taken, *parts], shortest, longest)):
            break
    if not parts:
        return keys.select(F.lit("").alias("sequence"), F.lit(0).alias("draw"), "key", F.lit(0).cast("bigint").alias("ordinal")).limit(0)
    ranked = global_rank(reduce(DataFrame.unionByName, parts), [], [F.col("draw"), F.col("key")], "ordinal")
    return ranked.where(F.col("ordinal") <= wanted)


def shortage(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per request (kind, owner, requested): what was accepted, what is short, and why.

    Draws go on while a string is free, so a request is short only when its string space is used up.
    """
    counted = accepted.groupBy("kind", "owner").agg(F.count(F.lit(1)).alias("_accepted"))
    joined = requests.join(counted, ["kind", "owner"], "left").withColumn("accepted", F.coalesce("_accepted", F.lit(0)).cast("bigint")).drop("_accepted")
    short = F.col("requested") - F.col("accepted")
    return joined.withColumn("short", short).withColumn("reason", F.when(short > 0, "no free string of this length").otherwise(""))


def first_writer_wins(sources: list[DataFrame]) -> DataFrame:
    """Union of candidate sources where the earliest source, then the earliest row, owns a string.

    Each source has sequence, label, origin, provenance and a sortable text `ordinal`.
    """
    columns = ["sequence", "label", "origin", "provenance", "ordinal"]
    tagged = [df.select(*columns, F.lit(i).alias("priority")) for i, df in enumerate(sources)]
    union = reduce(DataFrame.unionByName, tagged)
    owner = F.min(F.struct("priority", "ordinal", "label", "origin", "provenance")).alias("owner")
    return union.groupBy("sequence").agg(owner).select("sequence", "owner.label", "owner.origin", "owner.provenance")


def with_candidate_ids(universe: DataFrame, namespace: str) -> DataFrame:
    return universe.select(
        candidate_id(F.col("sequence"), namespace).alias("candidate_id"),
        "sequence", F.length("sequence").alias("length"), "label", "origin", "provenance",
    )


def split_blind(universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Public table without labels, and the private key."""
    public = universe.select("candidate_id", "sequence", "length")
    private = universe.select("candidate_id", "sequence", "label", "origin", "provenance")
    return public, private
