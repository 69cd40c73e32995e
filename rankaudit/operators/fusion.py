"""Weighted fusion of component scores, gates, staged re-ranking and recipes."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import round_to
from ..session import materialize
from .metrics import cutoff, evaluate, is_positive, total_order
from .ordering import global_rank
from .scaling import length_percentile, percentile

META = ["length", "sequence", "label"]


def fuse(components: DataFrame, weights: DataFrame, keep: list[str]) -> DataFrame:
    """Weighted mean of component scores per (fusion_id, candidate); weights <= 0 are ignored.

    A sum of doubles depends on the order of its terms, also after rounding where a mean lies at half a
    digit, so terms are added in the order of their components: ranks do not change from run to run.
    Means are rounded at 12 digits, which ties those that differ in their last bits only.
    """
    used = weights.where(F.col("weight") > 0).select("fusion_id", "component", "weight")
    joined = components.join(used, "component")
    term = F.struct("component", (F.col("weight") * F.col("score")).alias("product"), "weight")
    total = lambda field: F.aggregate(F.filter("_terms", lambda t: t[field].isNotNull()), F.lit(0.0), lambda run, t: run + t[field])
    gathered = joined.groupBy("fusion_id", *keep).agg(F.array_sort(F.collect_list(term)).alias("_terms"))
    some = F.exists("_terms", lambda t: t["product"].isNotNull())
    mean = F.when(some, total("product") / total("weight"))
    return gathered.select("fusion_id", *keep, round_to(mean, 12).alias("score"))


def single_and_mean_weights(names: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Each component alone, and the equal mean of every group of components.

    `groups` maps a group name to a pattern over component names.
    """
    single = names.select(
        F.concat(F.lit("single__"), F.replace("component", F.lit(":"), F.lit("__"))).alias("fusion_id"),
        "component", F.lit(1.0).alias("weight"),
    )
    for group, pattern in groups.items():
        members = names.where(F.col("component").rlike(pattern))
        size = members.agg(F.count(F.lit(1)).alias("_n"))
        mean = members.crossJoin(F.broadcast(size)).select(
            F.lit(f"mean__{group}").alias("fusion_id"), "component", (F.lit(1.0) / F.col("_n")).alias("weight")
        )
        single = single.unionByName(mean)
    return single


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the SHA-256 of the keys."""
    digest = F.sha2(F.concat_ws(":", *[key.cast("string") for key in keys]), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def dirichlet_weights(spark, names: list[str], trials: int, seed: int, group: str = "all", alpha: float = 0.55):
    """Dirichlet(alpha, ..., alpha) weight sets over component names; weights of 1e-5 or less are left out.

    A draw is a gamma variate over the sum of its set's. Gamma(alpha) is Gamma(alpha + 1) times a
    uniform to the power 1 / alpha, and Gamma(alpha + 1) a cube of a normal that a squeeze accepts
    in more than 95 of 100 tries; the first accepted of 16 counts. All uniforms are keyed digests,
    so SQL draws the same sets. Weights have eight digits.
    """
    shape = alpha + 1.0 - 1.0 / 3.0
    slope = F.lit(1.0 / (9.0 * shape) ** 0.5)
    drawn = spark.createDataFrame([(n,) for n in names], "component string").select(
        "component", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("_trial"),
    )
    u = lambda kind, *more: _uniform(F.lit(seed), F.lit(group), F.col("_trial"), F.col("component"), F.lit(kind), *more)
    tries = drawn.withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(16)))).withColumn(
        "_x", F.sqrt(F.lit(-2.0) * F.ln(u("r", F.col("_try")))) * F.cos(F.lit(6.283185307179586) * u("a", F.col("_try")))
    )
    cube = tries.withColumn("_v", F.pow(F.lit(1.0) + slope * F.col("_x"), F.lit(3.0)))
    bound = F.lit(0.5) * F.col("_x") * F.col("_x") + F.lit(shape) * (F.lit(1.0) - F.col("_v") + F.ln("_v"))
    accepted = cube.where((F.col("_v") > 0) & (F.ln(u("u", F.col("_try"))) < bound))
    gammas = accepted.groupBy("_trial", "component").agg(F.min_by("_v", "_try").alias("_v"))
    value = F.lit(shape) * F.col("_v") * F.pow(u("p"), F.lit(1.0 / alpha))
    share = F.col("_g") / F.sum("_g").over(Window.partitionBy("_trial"))
    weighed = gammas.withColumn("_g", value).withColumn("weight", round_to(share, 8)).where("weight > 1e-5")
    name = F.concat(F.lit(f"dirichlet__{group}__"), F.lpad(F.col("_trial").cast("string"), 4, "0"))
    return weighed.select(name.alias("fusion_id"), "component", "weight")


def random_weights(spark, names: list[str], groups: dict[str, str], trials: int, seed: int, alpha: float = 0.55):
    """Dirichlet weight sets for every group of two or more components; the groups share the trials evenly."""
    members = {group: [n for n in names if re.search(pattern, n)] for group, pattern in groups.items()}
    each = max(1, trials // len(groups))
    parts = [dirichlet_weights(spark, found, each, seed, group, alpha) for group, found in members.items() if len(found) > 1]
    return reduce(DataFrame.unionByName, parts)


def without_duplicates(weights: DataFrame, order: DataFrame, n: int, pool: int | None = None) -> DataFrame:
    """First n fusions in `order` (fusion_id, place) whose weight map was not seen before.

    With `pool` only that many places are looked at, so fewer than n may be found.
    """
    if pool is not None:
        order = order.where(F.col("place") <= pool)
    signature = weights.groupBy("fusion_id").agg(
        F.array_sort(F.collect_list(F.struct("component", "weight"))).alias("_signature")
    )
    placed = signature.join(order, "fusion_id").withColumn("_key", F.sha2(F.to_json("_signature"), 256))
    first = placed.groupBy("_key").agg(F.min_by("fusion_id", "place").alias("fusion_id"), F.min("place").alias("place"))
    return first.orderBy("place").limit(n).select("fusion_id", "place")


def hits_above(scored: DataFrame, by: list[str], cuts: dict[str, Column], bins: int = 4096) -> DataFrame:
    """Positives in the first rows of every group, without ranking the groups: one column per entry of `cuts`.

    `scored` is `by`, META and a score of about unit range; a cut is a number of rows, as a column
    over `by` and `n_rows`. Scores are counted in bins, which combine map-side. The bin that a cut
    falls into is found from the counts, and only rows of that bin are ranked. Wider ranges give
    more bins, equal scores fuller ones; counts stay exact. The groups must be few, because the
    bins at the cuts (one per group and cut) are broadcast; callers pass blocks of `BLOCK` groups.
    """
    marked = scored.withColumn("_bin", F.floor(F.col("score") * F.lit(float(bins))))
    counted = materialize(
        marked.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_positive()).alias("_p"))
    )
    group = Window.partitionBy(*by)
    higher = group.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0))
    placed = counted.select(
        *by, "_bin", "_n", "_p", before("_n").alias("_above"), before("_p").alias("_hits"), F.sum("_n").over(group).alias("n_rows")
    )
    limits = [F.struct(F.lit(c).alias("name"), F.least(rows, F.col("n_rows")).cast("bigint").alias("rows")) for c, rows in cuts.items()]
    edges = placed.withColumn("_cut", F.explode(F.array(*limits))).select(
        *by, "_bin", "_p", "_hits", F.col("_cut.name").alias("_name"),
        (F.col("_cut.rows") - F.col("_above")).alias("_need"), F.col("_n").alias("_size"),
    )
    edges = edges.where((F.col("_need") > 0) & (F.col("_need") <= F.col("_size")))
    whole = edges.where("_need = _size").select(*by, "_name", (F.col("_hits") + F.col("_p")).alias("_found"))
    split = edges.where("_need < _size").select(*by, "_bin", "_name", "_need", "_hits")
    inside = marked.join(F.broadcast(split), [*by, "_bin"])
    ranked = global_rank(inside, [*by, "_name"], total_order())
    partly = ranked.groupBy(*by, "_name").agg(
        (F.max("_hits") + F.count_if(is_positive() & (F.col("rank") <= F.col("_need")))).alias("_found")
    )
    found = whole.unionByName(partly)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == c, F.col("_found"))).alias(c) for c in cuts])


#: Weight sets, or combinations of gate, ranker and percent, that meet the rows at a time: what a join broadcasts.
BLOCK = 1024


def blocks(sets: DataFrame, key: list[str]) -> list[DataFrame]:
    """`sets` in parts of `BLOCK` rows, cut in the order of `key` where there are more."""
    if sets.count() <= BLOCK:
        return [sets]
    numbered = materialize(global_rank(sets, [], [F.col(c) for c in key], "_number"))
    last = numbered.agg(F.max("_number")).first()[0] or 0
    return [
        numbered.where(F.col("_number").between(start + 1, start + BLOCK)).drop("_number")
        for start in range(0, max(last, 1), BLOCK)
    ]


def component_names(df: DataFrame, most: int = 1000) -> list[str]:
    """Names of the components in order. They become columns, so more than `most` raise an error."""
    names = [row[0] for row in df.select("component").distinct().orderBy("component").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} components")
    return names


def wide_form(long: DataFrame, names: list[str], value: str, prefix: str) -> DataFrame:
    """One row per candidate with one column per component, null where a candidate has none."""
    columns = [F.max(F.when(F.col("component") == n, F.col(value))).alias(f"{prefix}{i}") for i, n in enumerate(names)]
    return long.where(F.col("component").isin(*names)).groupBy("candidate_id", *META).agg(*columns)


def wide_sets(weights: DataFrame, names: list[str]) -> DataFrame:
    """One row per weight set with one column per component; 0 where it has no weight."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("component") == n, F.col("weight"))), F.lit(0.0)).alias(f"_w{i}") for i, n in enumerate(names)
    ]
    return weights.where(F.col("weight") > 0).groupBy("fusion_id").agg(*columns)


def fuse_wide(wide: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """The scores of `fuse` for a block of weight sets, computed on the row: nothing is shuffled.

    Every row meets every set, because every set ranks all rows; `sets` is broadcast and holds a block at most.
    """
    used = [(F.col(f"_w{i}"), F.col(f"_s{i}")) for i in range(size)]
    used = [((w > 0) & s.isNotNull(), w, s) for w, s in used]
    total = reduce(Column.__add__, [F.when(on, w).otherwise(F.lit(0.0)) for on, w, _ in used])
    mixed = reduce(Column.__add__, [F.when(on, w * s).otherwise(F.lit(0.0)) for on, w, s in used])
    met = wide.crossJoin(F.broadcast(sets)).withColumn("score", round_to(F.try_divide(mixed, total), 12))
    return met.where(F.col("score").isNotNull()).select("fusion_id", "candidate_id", *META, "score")


def fusion_search(components: DataFrame, weights: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Two phases: count hits for all weight sets, then full metrics for the best `keep` distinct ones.

    `components` is percentile-scaled long form with the META columns, one row per candidate and
    component. Counting takes two passes over one row per candidate and ranks only rows at the cuts
    (`hits_above`); the winners alone are ranked in full. Equal weight maps count once; they are
    looked for among the first three times `keep` places.
    """
    by = ["fusion_id"]
    names = component_names(weights.where(F.col("weight") > 0))
    if not names:
        raise ValueError("no weight above zero")
    wide = materialize(wide_form(components, names, "score", "_s"))
    sets = materialize(wide_sets(weights, names))
    cuts = {"top_1pct_count": cutoff(F.col("n_rows"), 1.0), "top_10pct_count": cutoff(F.col("n_rows"), 10.0)}
    parts = [hits_above(fuse_wide(wide, block, len(names)), by, cuts) for block in blocks(sets, by)]
    order = [F.desc("top_1pct_count"), F.desc("top_10pct_count"), F.col("fusion_id")]
    placed = global_rank(reduce(DataFrame.unionByName, parts), [], order, "place").select("fusion_id", "place")
    chosen = materialize(without_duplicates(weights, placed, keep, 3 * keep))
    best = sets.join(chosen.select("fusion_id"), "fusion_id", "left_semi")
    return evaluate(fuse_wide(wide, best, len(names)), by), chosen


def gate_count(total: Column, percent: Column) -> Column:
    """Rows that pass a gate, never fewer than the 1% cut."""
    return F.greatest(cutoff(total, 1.0), F.ceil(F.round(total * percent / F.lit(100.0), 9)))


def gate_percents(values: list[float], ranges: list[tuple[float, float, float]]) -> list[float]:
    """Sorted distinct percents from single values and (start, end, step) ranges; a default list if none."""
    listed = list(values)
    for start, stop, step in ranges:
        if step <= 0:
            raise ValueError(f"step must be positive: {step}")
        count = int((stop + step / 10.0 - start) / step) + 1
        listed += [round(v, 6) for v in accumulate([step] * (count - 1), initial=start)] if count > 0 else []
    return sorted(set(listed)) or [2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0]


def staged_score(gated: Column, score: Column) -> Column:
    """Rows outside the gate fall below every row inside it."""
    return F.when(gated, score).otherwise(score - F.lit(2.0))


def _pick(index: Column, columns: list[str]) -> Column:
    """The column that `index` numbers."""
    return F.coalesce(*[F.when(index == i, F.col(c)) for i, c in enumerate(columns)])


def two_stage_search(components: DataFrame, percents: list[float], gates, rankers, keep: int) -> DataFrame:
    """Count hits for every gate x ranker x percent, full metrics for the best `keep`.

    A candidate's gate ranks and ranker scores stand in one row, which meets the combinations in
    blocks; hits are counted as in `fusion_search`. `gates` and `rankers` are names, None for all.
    """
    by = ["gate_component", "rank_component", "gate_percent"]
    everything = component_names(components) if gates is None or rankers is None else []
    gates, rankers = list(everything if gates is None else gates), list(everything if rankers is None else rankers)
    gated = components.where(F.col("component").isin(*gates))
    places = materialize(global_rank(gated, ["component"], total_order(), "gate_rank", "n_rows"))
    wide = materialize(
        wide_form(components, rankers, "score", "_s").join(
            wide_form(places, gates, "gate_rank", "_g").drop(*META), "candidate_id"
        )
    )
    numbered = lambda names, name, number: F.explode(
        F.array(*[F.struct(F.lit(n).alias(name), F.lit(i).alias(number)) for i, n in enumerate(names)])
    )
    sizes = places.groupBy(F.col("component").alias("gate_component")).agg(F.max("n_rows").alias("_rows"))
    gate_index = F.coalesce(*[F.when(F.col("gate_component") == n, F.lit(i)) for i, n in enumerate(gates)])
    combined = sizes.withColumn("_gate", gate_index).withColumn("_r", numbered(rankers, "rank_component", "_ranker"))
    combined = combined.withColumn("gate_percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    combined = combined.select("gate_component", "_r.*", "gate_percent", "_gate", gate_count(F.col("_rows"), F.col("gate_percent")).alias("_open"))
    name = F.concat_ws("__", F.format_string("gate%s", F.col("gate_percent").cast("string")),
                       "gate_component", F.lit("rank"), "rank_component")
    combined = materialize(combined.withColumn("rerank_id", name))

    def staged(block: DataFrame, keys: list[str]) -> DataFrame:
        place = _pick(F.col("_gate"), [f"_g{i}" for i in range(len(gates))])
        score = _pick(F.col("_ranker"), [f"_s{i}" for i in range(len(rankers))])
        met = wide.crossJoin(F.broadcast(block)).withColumns({"_place": place, "_score": score})
        met = met.where(F.col("_place").isNotNull() & F.col("_score").isNotNull())
        inside = F.col("_place") <= F.col("_open")
        return met.select(*keys, "candidate_id", *META, staged_score(inside, F.col("_score")).alias("score"))

    cuts = {
        "_one": cutoff(F.col("n_rows"), 1.0),
        "_ten": F.least(cutoff(F.col("n_rows"), 10.0), gate_count(F.col("n_rows"), F.col("gate_percent"))),
    }
    parts = [hits_above(staged(block, by), by, cuts) for block in blocks(combined, by)]
    counts = reduce(DataFrame.unionByName, parts).join(combined, by)
    best = materialize(counts.orderBy(F.desc("_one"), F.desc("_ten"), "rerank_id").limit(keep))
    return evaluate(staged(best, ["rerank_id", *by]), ["rerank_id", *by])


def with_length_ranks(components: DataFrame) -> DataFrame:
    """Add a `lenrank:` twin of every component, ranked inside its length."""
    inside = length_percentile(components, ["component"])
    return components.unionByName(inside.withColumn("component", F.concat(F.lit("lenrank:"), "component")))


def check_recipe(components: DataFrame, recipe: dict, weights: DataFrame) -> None:
    """Raise ValueError where a recipe names a component that neither the table nor its fusions hold."""
    raw = component_names(components)
    raw += [f"lenrank:{name}" for name in raw] if recipe.get("include_length_ranks") else []
    unknown = sorted(set(component_names(weights)) - set(raw))
    if unknown:
        raise ValueError(f"fusions use missing components: {unknown}")
    fused = {row[0] for row in weights.select("fusion_id").distinct().collect()}
    for role in ("gate_component", "rank_component"):
        if recipe[role] not in fused | set(raw):
            raise ValueError(f"{role} {recipe[role]} is missing")


def apply_recipe(components: DataFrame, recipe: dict, weights: DataFrame) -> DataFrame:
    """Apply a frozen recipe to raw component scores; returns one ranked row per candidate.

    Order matters: length ranks on raw scores, percentiles of everything, fusion of
    percentiles, percentiles once more, gate, staged score, rank.
    """
    raw = with_length_ranks(components) if recipe.get("include_length_ranks") else components
    scaled = percentile(raw, ["component"])
    fused = fuse(scaled, weights, ["candidate_id", *META]).withColumnRenamed("fusion_id", "component")
    everything = percentile(scaled.select(*fused.columns).unionByName(fused), ["component"])
    gates = everything.where(F.col("component") == recipe["gate_component"])
    places = global_rank(gates, [], total_order(), "gate_rank", "n_rows").select("candidate_id", "gate_rank", "n_rows")
    scores = everything.where(F.col("component") == recipe["rank_component"])
    inside = F.col("gate_rank") <= gate_count(F.col("n_rows"), F.lit(float(recipe["gate_percent"])))
    staged = scores.join(places, "candidate_id").withColumn("gated", inside)
    staged = staged.withColumn("score", staged_score(F.col("gated"), F.col("score")))
    return global_rank(staged.drop("gate_rank", "n_rows", "component"), [], total_order(), total="n_rows")
