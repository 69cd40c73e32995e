"""Count-based conditional residue model: P(residue | left, right) with back-off.

Trained by counting residues between their neighbours over a corpus. The model has at most
22 * 22 * 20 rows whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ALPHABET
from ..functions.mathx import round_to
from ..functions.text import mutation, residues, stable_id
from ..session import materialize
from .neighbors import nearest_within
from .ordering import global_rank, top_per_group

_EDGE = "_"


def positions(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per residue with its neighbours; `_` beyond the ends."""
    s = F.col("sequence")
    opened = df.select(*keep, s.alias("_s"), F.posexplode(residues(s)).alias("_i", "residue"))
    i = F.col("_i") + 1
    left = F.when(i > 1, F.substring("_s", i - 1, F.lit(1))).otherwise(F.lit(_EDGE))
    right = F.when(i < F.length("_s"), F.substring("_s", i + 1, F.lit(1))).otherwise(F.lit(_EDGE))
    return opened.select(*keep, i.alias("position"), "residue", left.alias("left"), right.alias("right"))


def train(corpus: DataFrame, weight: str | None = None, smoothing: float = 1.0, pull: float = 20.0) -> DataFrame:
    """Table (left, right, residue, log_p) for every seen context and every residue.

    P = (count + pull * P_left) / (context count + pull), where P_left backs off to the
    left neighbour alone with additive smoothing. Rows with a null `right` hold P_left, for pairs never
    seen; those with a null `left` too are uniform, for left neighbours never seen.
    """
    share = F.col(weight) if weight else F.lit(1)
    kept = [weight] if weight else []
    seen = positions(corpus, kept).groupBy("left", "right", "residue").agg(F.sum(share).alias("n"))
    letters = F.explode(F.array(*[F.lit(a) for a in ALPHABET])).alias("residue")
    by_left = seen.groupBy("left", "residue").agg(F.sum("n").alias("left_n"))
    left_total = seen.groupBy("left").agg(F.sum("n").alias("left_total"))
    context_total = seen.groupBy("left", "right").agg(F.sum("n").alias("context_n"))
    grid = context_total.select("left", "right", "context_n", letters)
    joined = (
        grid.join(seen, ["left", "right", "residue"], "left")
        .join(by_left, ["left", "residue"], "left")
        .join(left_total, "left")
    )
    p_left = (F.coalesce("left_n", F.lit(0)) + F.lit(smoothing)) / (
        F.col("left_total") + F.lit(smoothing * len(ALPHABET))
    )
    p = (F.coalesce("n", F.lit(0)) + F.lit(pull) * p_left) / (F.col("context_n") + F.lit(pull))
    no = F.lit(None).cast("string")
    one_sided = left_total.select("left", "left_total", letters).join(by_left, ["left", "residue"], "left")
    one_sided = one_sided.select("left", no.alias("right"), "residue", F.log(p_left).alias("log_p"))
    uniform = corpus.sparkSession.range(1).select(letters).select(
        no.alias("left"), no.alias("right"), "residue", F.log(F.lit(1.0 / len(ALPHABET))).alias("log_p")
    )
    return joined.select("left", "right", "residue", F.log(p).alias("log_p")).unionByName(one_sided).unionByName(uniform)


_UNSEEN = -3.0


def log_likelihood(df: DataFrame, model: DataFrame) -> DataFrame:
    """Total, mean and pseudo-perplexity per distinct string; -inf outside the alphabet.

    Residues are scored where they lie and summed before the shuffle, so one partial row
    per string travels.
    """
    strings = df.select("sequence").distinct()
    scored = positions(strings, ["sequence"]).join(model, ["left", "right", "residue"], "left")
    known = F.col("residue").isin(*ALPHABET)
    value = F.when(known, F.coalesce("log_p", F.lit(_UNSEEN))).otherwise(F.lit(float("-inf")))
    summed = scored.groupBy("sequence").agg(F.sum(value).alias("total_ll"))
    mean = F.col("total_ll") / F.length("sequence")
    return summed.select("sequence", "total_ll", mean.alias("mean_ll"), F.exp(-mean).alias("pseudo_perplexity"))


def top_substitutions(parents: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """Best n other residues per (parent, position) by conditional log-probability.

    The choice depends only on (left, residue, right), so it is ranked once per context. Pairs of neighbours
    that the model has not seen take the rows of their left neighbour, or the uniform ones.
    """
    places = positions(parents.select("sequence").distinct(), ["sequence"])
    options = model.select(F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("residue").alias("substitute"), "log_p")
    lefts = model.where("left IS NOT NULL").select("left", F.col("left").alias("_from")).distinct()
    pairs = model.where("right IS NOT NULL").select("left", "right", F.col("right").alias("_to")).distinct()
    contexts = places.select("left", "right", "residue").distinct().join(lefts, "left", "left").join(pairs, ["left", "right"], "left")
    contexts = contexts.join(options, F.col("_from").eqNullSafe(F.col("_l")) & F.col("_to").eqNullSafe(F.col("_r")))
    contexts = contexts.select("left", "right", "residue", "substitute", "log_p")
    others = contexts.where(F.col("substitute") != F.col("residue"))
    best = top_per_group(others, ["left", "right", "residue"], [F.col("log_p").desc(), F.col("substitute")], n, "choice")
    return places.join(best, ["left", "right", "residue"]).select(
        "sequence", "position", "residue", "substitute", "log_p", "choice"
    )


def _overlay(sequence: Column, position: Column, residue: Column) -> Column:
    return F.overlay(sequence, residue, position, F.lit(1))


def variants(
    parents: DataFrame, model: DataFrame, blocked: DataFrame, singles: int = 3, doubles: int = 2
) -> DataFrame:
    """Single and double substitutions that are not blocked, one row per new string.

    A single substitution wins over a double that gives the same string; among equals the
    one from the later parent, then the later position, wins. `parents` has `sequence` and
    a `parent_order`.
    """
    best = top_substitutions(parents, model, max(singles, doubles))
    tagged = best.join(parents.select("sequence", "parent_order"), "sequence")
    first = tagged.select(
        "sequence", "parent_order", F.col("position").alias("p1"), F.col("residue").alias("r1"),
        F.col("choice").alias("c1"), F.col("substitute").alias("s1"), F.col("log_p").alias("l1"),
    )
    single = first.where(F.col("c1") <= singles).select(
        F.col("sequence").alias("parent"), "parent_order",
        _overlay(F.col("sequence"), F.col("p1"), F.col("s1")).alias("sequence"),
        F.lit(1).alias("edit_count"),
        mutation(F.col("r1"), F.col("p1"), F.col("s1")).alias("mutations"),
        F.col("l1").alias("support"),
        F.struct(F.col("p1").alias("a"), F.lit(0).alias("b"), F.col("c1").alias("c"), F.lit(0).alias("d")).alias("place"),
    )
    few = first.where(F.col("c1") <= doubles)
    second = few.select(
        "sequence", F.col("p1").alias("p2"), F.col("r1").alias("r2"), F.col("c1").alias("c2"),
        F.col("s1").alias("s2"), F.col("l1").alias("l2"),
    )
    double = few.join(second, "sequence").where(F.col("p1") < F.col("p2")).select(
        F.col("sequence").alias("parent"), "parent_order",
        _overlay(_overlay(F.col("sequence"), F.col("p1"), F.col("s1")), F.col("p2"), F.col("s2")).alias("sequence"),
        F.lit(2).alias("edit_count"),
        F.concat_ws(
            ";", mutation(F.col("r1"), F.col("p1"), F.col("s1")), mutation(F.col("r2"), F.col("p2"), F.col("s2"))
        ).alias("mutations"),
        ((F.col("l1") + F.col("l2")) / F.lit(2.0)).alias("support"),
        F.struct(
            F.col("p1").alias("a"), F.col("p2").alias("b"), F.col("c1").alias("c"), F.col("c2").alias("d")
        ).alias("place"),
    )
    both = single.unionByName(double)
    both = both.join(blocked.select("sequence").distinct(), "sequence", "left_anti")
    latest = F.struct((-F.col("edit_count")).alias("e"), F.col("parent_order"), F.col("place"))
    rest = F.struct("parent", "edit_count", "mutations", "support")
    chosen = both.groupBy("sequence").agg(F.max_by(rest, latest).alias("row")).select("sequence", "row.*")
    return chosen.withColumn(
        "variant_id", stable_id("VAR", F.col("parent"), F.col("sequence"), F.col("mutations"))
    )


def changed_scores(variants: DataFrame, parents: DataFrame, model: DataFrame) -> DataFrame:
    """Total and mean log-likelihood of every variant, and the change of the mean against its parent.

    `variants` has distinct `sequence` with a `parent` of the same length; `parents` has sequence and total_ll. A substitution
    touches its own term and those of its two neighbours only, so these are looked up before and after it and the rest of
    the parent's sum is kept.
    """
    at = lambda name, i: F.substring(name, i, F.lit(1))
    size = F.length("sequence")
    places = F.filter(F.sequence(F.lit(1), size), lambda i: at("sequence", i) != at("parent", i))
    around = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i - 1, i, i + 1))))
    touched = F.filter(around, lambda i: (i >= 1) & (i <= size))

    def term(name: str, sign: int):
        i = F.col("_i")
        left = F.when(i > 1, at(name, i - 1)).otherwise(F.lit(_EDGE))
        right = F.when(i < size, at(name, i + 1)).otherwise(F.lit(_EDGE))
        return F.struct(left.alias("left"), at(name, i).alias("residue"), right.alias("right"), F.lit(sign).alias("sign"))

    opened = variants.select("sequence", "parent", F.explode(touched).alias("_i"))
    terms = opened.select("sequence", F.inline(F.array(term("sequence", 1), term("parent", -1))))
    counted = terms.groupBy("sequence", "left", "residue", "right").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    scored = counted.join(model.where("right is not null"), ["left", "right", "residue"], "left")
    change = scored.groupBy("sequence").agg(F.sum(F.col("sign") * F.coalesce("log_p", F.lit(_UNSEEN))).alias("change"))
    known = parents.select(F.col("sequence").alias("parent"), F.col("total_ll").alias("_parent_ll"))
    joined = variants.select("sequence", "parent").join(known, "parent").join(change, "sequence", "left")
    moved = F.coalesce("change", F.lit(0.0))
    total = F.col("_parent_ll") + moved
    return joined.select(
        "sequence", total.alias("total_ll"), (total / size).alias("mean_ll"), (F.col("_parent_ll") / size).alias("parent_mean_ll"),
        (moved / size).alias("delta_mean_ll"), F.exp(-total / size).alias("pseudo_perplexity"),
    )


def variant_table(
    parents: DataFrame, model: DataFrame, known: DataFrame, blocked: DataFrame, flag: Column, n: int, singles: int = 3, doubles: int = 2
) -> DataFrame:
    """The best n new strings one or two substitutions from a parent, with score, change, nearest known string and flag.

    `known` holds the parents, so a string as near as the number of edits is always there and no wider search is needed.
    Doubles come first, then strings that pass the screen, then by score, change and text. `flag` is an expression over `sequence`.
    """
    found = variants(parents, model, blocked.select("sequence").unionByName(known.select("sequence")), singles, doubles)
    found = materialize(found)
    scores = changed_scores(found, log_likelihood(parents, model), model)
    near = nearest_within(found.select(F.col("sequence").alias("query"), F.col("edit_count").alias("radius")), known.select(F.col("sequence").alias("other")))
    orders = parents.select(F.col("sequence").alias("parent"), F.col("parent_order").alias("parent_rank"))
    joined = found.join(scores, "sequence").join(near.withColumnRenamed("query", "sequence"), "sequence", "left").join(orders, "parent")
    flagged = joined.withColumn("flag", flag)
    # Sums of logarithms add up in no fixed order; nine digits tell scores apart and keep equal ones equal.
    keys = {
        "_single": F.col("edit_count") < 2, "_fails": F.col("flag") != "screen_pass",
        "_score": -round_to(F.col("mean_ll"), 9), "_change": -round_to(F.col("delta_mean_ll"), 9),
    }
    order = [*map(F.col, keys), F.col("sequence")]
    best = flagged.withColumns(keys).orderBy(*order).limit(n)
    return global_rank(best, [], order, "rank").drop(*keys)
