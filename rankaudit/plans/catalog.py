"""Every registered job over the given tables: name -> function(spark, sf_dir)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features, fixed, mathx, text
from ..functions.mathx import round_to
from ..functions.scoring import labelled_ablations, labelled_modes, score_modes, score_wide, unblinded
from ..operators import (
    cleavage, context_model, digest, fusion, generate, geometry, manifest, metrics, models, neighbors, overlap,
    panels, scaling, traces, validation,
)
from ..operators.ordering import average_ranks, flagged_ranks, global_rank, ordered_parts
from ..session import materialize, scratch_dir
from ..sources import tables, text_files
from . import inputs

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double for comparison."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: round_to(F.col(name), digits) for name in doubles})


def public_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = inputs.document_words(spark, sf_dir)
    return words.select(
        text.candidate_id(F.col("sequence"), inputs.NAMESPACE).alias("candidate_id"),
        "sequence", F.length("sequence").alias("length"),
    )


# ---- candidates, filters and ids -------------------------------------------------


@query
def clean_ids(spark, sf_dir):
    """Clean keys and ids of all raw document words, with the alphabet and length filters."""
    raw = inputs.raw_words(inputs.table(spark, sf_dir, "documents")).distinct()
    cleaned = raw.select(text.clean_sequence(F.col("word")).alias("sequence"))
    kept = cleaned.where(text.is_canonical(F.col("sequence")) & text.length_between(F.col("sequence"), 2, 12))
    return kept.select(
        text.candidate_id(F.col("sequence"), inputs.NAMESPACE).alias("candidate_id"),
        text.stable_id("VAR", F.col("sequence"), F.length("sequence").cast("string")).alias("stable_id"),
        "sequence", F.length("sequence").alias("length"),
    )


@query
def reject_reasons(spark, sf_dir):
    """Counts per reject reason of the potency export; accepted rows have reason 'accepted'."""
    raw = inputs.raw_export(spark, sf_dir).withColumn("ic50_um", text.export_potency_um(F.col("ic50"), F.col("molwt")))
    excluded = inputs.panel_words(spark, sf_dir)
    marked = overlap.with_reject_reason(raw, excluded, 2, 12, maximum=20000.0)
    return marked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("n_sequences")
    )


@query
def export_best_potency(spark, sf_dir):
    """Accepted export rows, the lowest potency per string; earliest document on ties."""
    raw = inputs.raw_export(spark, sf_dir).withColumn("ic50_um", text.export_potency_um(F.col("ic50"), F.col("molwt")))
    marked = overlap.with_reject_reason(raw, inputs.panel_words(spark, sf_dir), 2, 12, maximum=20000.0)
    accepted = marked.where(F.col("reason").isNull()).withColumn("ordinal", F.struct("id", "source"))
    best = panels.lowest_per_key(accepted, "sequence", "ic50_um", "ordinal")
    return rounded(best.select("sequence", "source", "id", "ic50", "ic50_um"))


@query
def digest_fragments(spark, sf_dir):
    """Fragments of every document under four cut rules: counts per source, rule and length."""
    found = digest.fragment_codes(inputs.proteins(spark, sf_dir))
    rules = list(enumerate(digest.CUT_RULES))
    bit = lambda i: F.shiftright("rules", i).bitwiseAND(F.lit(1))
    per_fragment = found.groupBy("source_class", "code").agg(*[F.sum(bit(i)).alias(f"n{i}") for i, _ in rules])
    has = lambda i: F.when(F.col(f"n{i}") > 0, F.col("code"))
    sums = per_fragment.groupBy("source_class", digest.code_length(F.col("code")).alias("length")).agg(*[
        c for i, _ in rules for c in (
            F.sum(f"n{i}").alias(f"n{i}"), F.count(has(i)).alias(f"d{i}"), F.min(has(i)).alias(f"a{i}"), F.max(has(i)).alias(f"z{i}")
        )
    ])
    each = F.inline(F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n_fragments"), F.col(f"d{i}").alias("n_distinct"),
            digest.code_text(F.col(f"a{i}")).alias("first_fragment"), digest.code_text(F.col(f"z{i}")).alias("last_fragment"),
        ) for i, rule in rules
    ]))
    opened = sums.select("source_class", "length", each).where(F.col("n_fragments") > 0)
    return opened.select("source_class", "rule", "length", "n_fragments", "n_distinct", "first_fragment", "last_fragment")


#: Decoys of a parent in all, how many of them are shuffles, and the tries that shuffles get.
DECOYS, SHUFFLES, SHUFFLE_TRIES = 80, 20, 1000


def _parents(spark, sf_dir):
    return inputs.sized(inputs.panel_words(spark, sf_dir)).select(F.col("sequence").alias("parent"))


def _decoy_sources(parents, taken):
    """Shuffles that nothing has taken, quotas of the parents, random decoys up to the quota, and all that is taken then."""
    drawn = generate.shuffled_decoys(parents, SHUFFLES, tries=SHUFFLE_TRIES)
    owned = materialize(drawn.groupBy("sequence").agg(F.min("parent").alias("parent")))
    shuffled = materialize(generate.without(owned, taken))
    have = shuffled.groupBy("parent").agg(F.count(F.lit(1)).alias("_have"))
    quotas = parents.join(have, "parent", "left").select(
        "parent", (F.lit(DECOYS) - F.coalesce("_have", F.lit(0))).cast("int").alias("quota")
    )
    blocked = taken.select("sequence").unionByName(shuffled.select("sequence"))
    randoms = materialize(generate.random_decoys(quotas, blocked))
    return shuffled, quotas, randoms, blocked.unionByName(randoms.select("sequence"))


def _words_taken(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir).select("sequence")
    return materialize(words.unionByName(inputs.panel_words(spark, sf_dir).select("sequence")))


@query
def shuffled_decoys(spark, sf_dir):
    found = generate.shuffled_decoys(_parents(spark, sf_dir), SHUFFLES, tries=SHUFFLE_TRIES)
    return found.select("parent", "sequence", "attempt", "ordinal")


@query
def random_decoys(spark, sf_dir):
    """Random decoys beside the words of documents and panel and the shuffles, until every quota is met."""
    randoms = _decoy_sources(_parents(spark, sf_dir), _words_taken(spark, sf_dir))[2]
    return randoms.select("parent", "sequence", "attempt", "ordinal")


def _background(spark, sf_dir, taken):
    documents = inputs.table(spark, sf_dir, "documents")
    wanted = documents.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return wanted, generate.random_background(documents.select(F.col("doc_id").alias("key")), wanted, inputs.SHORTEST, inputs.LONGEST, taken)


@query
def random_background(spark, sf_dir):
    """As many distinct random strings as there are documents, none a document or panel word."""
    return _background(spark, sf_dir, _words_taken(spark, sf_dir))[1].select("sequence", "draw", "key", "ordinal")


def _digest_owners(proteins):
    """Every digest fragment with its least (source class, rule, accession) in `o`.

    Documents are numbered in the order of source class and accession, so that owner is the least of a number that counts
    the rules inside the source class, and fragments meet as numbers.
    """
    rules = list(digest.CUT_RULES)
    order = [F.col("source_class").asc_nulls_first(), F.col("accession").asc_nulls_first()]
    numbered = global_rank(proteins, [], order, "_number")
    first = numbered.groupBy("source_class").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    first = first.withColumnRenamed("source_class", "_class")
    placed = numbered.join(first, numbered["source_class"].eqNullSafe(first["_class"])).select(
        "accession", "_first", "_rows", (F.col("_number") - F.col("_first")).alias("_in"), "sequence"
    )
    rule = reduce(lambda other, i: F.when(F.shiftright("rules", i).bitwiseAND(F.lit(1)) == 1, i).otherwise(other), reversed(range(len(rules))), F.lit(0))
    found = digest.fragment_codes(placed).withColumn("_rule", rule.cast("bigint"))
    key = (F.col("_first") - F.lit(1)) * F.lit(len(rules)) + F.col("_rule") * F.col("_rows") + F.col("_in")
    least = found.select("code", "_rule", "accession", "_first", key.alias("_key")).groupBy("code").agg(
        *[F.min_by(c, "_key").alias(c) for c in ("_rule", "accession", "_first")]
    )
    named = least.join(first.select("_first", F.col("_class").alias("source_class")), "_first")
    name = F.element_at(F.array(*[F.lit(r) for r in rules]), (F.col("_rule") + 1).cast("int"))
    return named.select(digest.code_text(F.col("code")).alias("sequence"), F.struct("source_class", name.alias("rule"), "accession").alias("o"))


def _universe_parts(spark, sf_dir, owners=True):
    """Spiked panel, digest of all documents, shuffles, random decoys and background; each leaves out what earlier ones have.

    Who owns a fragment changes nothing in what is taken, so counts alone need no owners.
    """
    panel = inputs.sized(inputs.panel_words(spark, sf_dir))
    proteins = inputs.proteins(spark, sf_dir)
    texts = lambda: digest.distinct_codes(proteins).select(digest.code_text(F.col("code")).alias("sequence"))
    owned = materialize(_digest_owners(proteins) if owners else texts())
    taken = owned.select("sequence").unionByName(panel.select("sequence"))
    parents = panel.select(F.col("sequence").alias("parent"))
    shuffled, quotas, randoms, blocked = _decoy_sources(parents, taken)
    wanted, noise = _background(spark, sf_dir, blocked)
    return panel, owned, shuffled, quotas, randoms, materialize(noise), wanted


def _universe(spark, sf_dir):
    panel, owned, shuffled, _, randoms, background, _ = _universe_parts(spark, sf_dir)
    marks = panel.select("sequence", F.lit(1).alias("_panel"))
    digested = owned.join(marks, "sequence", "left").select(
        "sequence",
        F.when(F.col("_panel") == 1, "digestome_known_positive").otherwise("digestome_background").alias("label"),
        F.concat_ws(":", "o.source_class", F.col("o.accession").cast("string"), "o.rule").alias("origin"),
        F.lit("document").alias("provenance"), F.lit("").alias("ordinal"),
    )
    spiked = panel.select(
        "sequence", F.lit("known_positive").alias("label"), F.lit("panel_spike").alias("origin"),
        F.lit("benchmark").alias("provenance"), F.lit("").alias("ordinal"),
    )
    def decoy(df, kind):
        return df.select(
            "sequence", F.lit("matched_decoy").alias("label"), F.concat(F.lit(kind + ":"), "parent").alias("origin"),
            F.lit("private matched decoy").alias("provenance"), F.col("parent").alias("ordinal"),
        )
    noise = background.select(
        "sequence", F.lit("random_background").alias("label"), F.lit("random_background").alias("origin"),
        F.lit("synthetic").alias("provenance"), F.lit("").alias("ordinal"),
    )
    sources = [digested, spiked, decoy(shuffled, "composition_shuffle"), decoy(randoms, "length_matched_random"), noise]
    return generate.with_candidate_ids(generate.first_writer_wins(sources), inputs.NAMESPACE)


@query
def universe_shortage(spark, sf_dir):
    """What the blinded universe was asked for and got: decoys of every parent, and the background."""
    _, _, shuffled, quotas, randoms, background, wanted = _universe_parts(spark, sf_dir, owners=False)
    decoys = quotas.select(F.lit("matched_decoy").alias("kind"), F.col("parent").alias("owner"), F.lit(DECOYS).cast("bigint").alias("requested"))
    noise = spark.range(1).select(F.lit("random_background").alias("kind"), F.lit("").alias("owner"), F.lit(wanted).cast("bigint").alias("requested"))
    accepted = shuffled.select("parent").unionByName(randoms.select("parent")).select(F.lit("matched_decoy").alias("kind"), F.col("parent").alias("owner"))
    accepted = accepted.unionByName(background.select(F.lit("random_background").alias("kind"), F.lit("").alias("owner")))
    return generate.shortage(decoys.unionByName(noise), accepted)


@query
def priority_universe(spark, sf_dir):
    """Blinded universe: manifest of the private key per label and length."""
    _, private = generate.split_blind(_universe(spark, sf_dir))
    columns = ["candidate_id", "sequence", "label", "origin", "provenance"]
    table = manifest.manifest(private.withColumn("length", F.length("sequence")), columns, ["label", "length"])
    return table.withColumn("digest", F.col("digest").cast("string"))


# ---- features and scores ---------------------------------------------------------


@query
def composition_features(spark, sf_dir):
    return features.with_composition(public_words(spark, sf_dir)).drop("candidate_id")


@query
def domain_features(spark, sf_dir):
    return features.with_domain_features(public_words(spark, sf_dir)).select(
        "sequence", "length", *features.DOMAIN_FEATURES, *[
            round_to(F.col(c)).alias(c) for c in features.MODE_ONLY_FEATURES
        ]
    )


@query
def score_modes_long(spark, sf_dir):
    scored = score_modes(public_words(spark, sf_dir))
    return scored.select("sequence", "mode", "score")


@query
def blind_rank(spark, sf_dir):
    """Blind scoring and total order by the first mode."""
    scored = score_wide(public_words(spark, sf_dir)).select("candidate_id", "sequence", "length", F.col("sar").alias("score"))
    return global_rank(scored, [], metrics.total_order())


@query
def mode_sweep_summary(spark, sf_dir):
    """All score modes ranked, unblinded and evaluated in one plan, with the endpoint gate."""
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    scored = labelled_modes(universe, universe)
    summary = metrics.evaluate(scored, ["mode"])
    passed = metrics.endpoint_pass(
        F.col("top_1pct_count"), F.col("top_1pct_fraction"), F.col("auroc_matched"), (2, 0.012, 0.5)
    )
    return rounded(summary.withColumn("endpoint_pass", passed))


@query
def ablation_summary(spark, sf_dir):
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    scored = labelled_ablations(universe, universe)
    return rounded(metrics.evaluate(scored.withColumn("score", round_to(F.col("score"), 9)), ["ablation"]))


@query
def baseline_score_rank(spark, sf_dir):
    """General composition baseline, evaluated per label source, with the upper median."""
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    public = universe.select("candidate_id", "sequence", "length")
    scored = public.withColumn("score", features.baseline_score(F.col("sequence"))).withColumn("baseline", F.lit("composition"))
    summary = metrics.evaluate(unblinded(scored, universe), ["baseline"])
    return rounded(summary.drop("median_rank"))


# ---- ranks and percentiles over components -----------------------------------------


def _ranked_components(spark, sf_dir):
    return global_rank(inputs.components(spark, sf_dir), ["component"], metrics.total_order(), total="n_rows")


@query
def topk_flags(spark, sf_dir):
    flagged = metrics.with_topk_flags(_ranked_components(spark, sf_dir))
    return rounded(flagged.drop("length", "n_rows", "label"))


@query
def rank_histogram(spark, sf_dir):
    return metrics.rank_histogram(_ranked_components(spark, sf_dir), ["component"])


@query
def recovery_by_component(spark, sf_dir):
    percents = (0.5, 1.0, 2.0, 5.0, 10.0)
    return rounded(metrics.evaluate(inputs.components(spark, sf_dir), ["component"], percents=percents))


@query
def percentile_components(spark, sf_dir):
    scaled = scaling.percentile(inputs.components(spark, sf_dir), ["component"])
    return rounded(scaled.select("candidate_id", "component", "score"), 9)


@query
def lenrank_components(spark, sf_dir):
    scaled = scaling.length_percentile(inputs.components(spark, sf_dir), ["component"])
    return rounded(scaled.select("candidate_id", "component", "score"), 9)


@query
def component_average_ranks(spark, sf_dir):
    ranked = average_ranks(inputs.components(spark, sf_dir), ["component"], "score")
    return ranked.select("candidate_id", "component", "avg_rank")


@query
def minmax_scale(spark, sf_dir):
    scaled = scaling.minmax(inputs.components(spark, sf_dir), ["component"], "score")
    return rounded(scaled.select("candidate_id", "component", "score"))


@query
def length_z(spark, sf_dir):
    scaled = scaling.length_z(inputs.components(spark, sf_dir), ["component"], "score", "z")
    return rounded(scaled.select("candidate_id", "component", "z"))


@query
def score_matrix(spark, sf_dir):
    """Two wide score tables aligned into long components, with an alignment check."""
    wide = inputs.wide_components(spark, sf_dir)
    left = wide.select("candidate_id", "sequence", "c01", "c02")
    right = wide.where(F.col("label") != "known_positive").select("candidate_id", "sequence", "c03")
    matrix = tables.read_score_matrix({"a": left, "b": right})
    gaps = tables.misaligned({"a": left, "b": right})
    counted = matrix.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    missing = tables.unscored(wide, matrix, 3).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("unscored").alias("component"), "n", F.lit(0.0).alias("total")
    )
    apart = gaps.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("misaligned").alias("component"), "n", F.lit(0.0).alias("total")
    )
    return rounded(counted.unionByName(missing).unionByName(apart))


# ---- fusion ------------------------------------------------------------------------


def _scaled(spark, sf_dir):
    return materialize(scaling.percentile(inputs.components(spark, sf_dir), ["component"]))


MIX = {"c01": 0.5, "c02": 0.25, "c09": 0.2, "c10": 0.1, "c03": -0.4}
GROUPS = {"all": ".*", "low": "^c0[1-4]$", "high": "^(c0[5-9]|c10)$"}


def _weights(spark, name, weights):
    rows = [(name, component, float(w)) for component, w in weights.items()]
    return spark.createDataFrame(rows, "fusion_id string, component string, weight double")


@query
def weighted_fusion(spark, sf_dir):
    fused = fusion.fuse(_scaled(spark, sf_dir), _weights(spark, "mix", MIX), ["candidate_id"])
    return rounded(fused, 9)


@query
def fusion_search(spark, sf_dir):
    """Single and mean fusions, counted first, then full metrics for the best six."""
    scaled = _scaled(spark, sf_dir)
    names = scaled.select("component").distinct()
    weights = materialize(fusion.single_and_mean_weights(names, GROUPS))
    grid = scaled.withColumn("score", round_to(F.col("score"), 9))
    summary, _ = fusion.fusion_search(grid, weights, keep=6)
    return rounded(summary)


RANDOM_GROUPS = {**GROUPS, "preferred": "^c0[17]$", "alone": "^c01$"}


@query
def random_fusion_search(spark, sf_dir):
    """Single, mean and random weight sets of all groups; the mean of a group of one repeats a single set and goes."""
    scaled = _scaled(spark, sf_dir)
    names = fusion.component_names(scaled)
    fixed_sets = fusion.single_and_mean_weights(scaled.select("component").distinct(), RANDOM_GROUPS)
    drawn = fusion.random_weights(spark, names, RANDOM_GROUPS, trials=100, seed=20260101)
    grid = scaled.withColumn("score", round_to(F.col("score"), 9))
    summary, _ = fusion.fusion_search(grid, materialize(fixed_sets.unionByName(drawn)), keep=40)
    return rounded(summary)


@query
def two_stage_rerank(spark, sf_dir):
    """All gate x ranker x percent combinations counted, full metrics for the best eight."""
    percents = fusion.gate_percents([2.0], [(5.0, 15.0, 5.0)])
    table = fusion.two_stage_search(_scaled(spark, sf_dir), percents, ["c01", "c02", "c09"], ["c03", "c04", "c10"], 8)
    return rounded(table)


RECIPE = {
    "recipe_id": "mix-gate", "gate_component": "fusion:mix", "rank_component": "lenrank:c02",
    "gate_percent": 7.5, "include_length_ranks": True,
}


def _recipe_rows(spark, sf_dir):
    weights = _weights(spark, "fusion:mix", MIX)
    return fusion.apply_recipe(inputs.components(spark, sf_dir), RECIPE, weights)


@query
def frozen_recipe(spark, sf_dir):
    rows = _recipe_rows(spark, sf_dir)
    return rounded(rows.select("candidate_id", "rank", "score", F.col("gated").cast("int").alias("gated")), 9)


@query
def frozen_recipe_summary(spark, sf_dir):
    rows = _recipe_rows(spark, sf_dir).withColumn("recipe_id", F.lit(RECIPE["recipe_id"]))
    return rounded(metrics.evaluate(rows.drop("rank", "n_rows", "gated"), ["recipe_id"]))


RECIPE_FILE = {
    "recipe_id": "file-gate", "status": "frozen", "include_length_stratified_components": True,
    "gate_component": "lenrank:c03", "gate_percent": 12.5, "rank_component": "fusion:mix",
    "fusion_components": [
        {"component_id": "fusion:mix", "weights": {"c01": 0.5, "c02": 0.25, "lenrank:c09": 0.25}},
        {"component_id": "fusion:pair", "weights": {"c05": 1.0, "c06": 1.0}},
    ],
}


@query
def recipe_from_file(spark, sf_dir):
    """A recipe written as JSON, read back, checked and applied: every candidate with its rank and gate."""
    path = _scratch(spark, "recipe")
    spark.createDataFrame([(json.dumps(RECIPE_FILE, indent=2),)], "value string").coalesce(1).write.text(path)
    recipe, weights = tables.load_recipe(spark, path)
    components = inputs.components(spark, sf_dir)
    fusion.check_recipe(components, recipe, weights)
    rows = fusion.apply_recipe(components, recipe, weights)
    settings = [F.lit(recipe[key]).alias(key) for key in ("recipe_id", "gate_component", "rank_component", "gate_percent")]
    return rounded(rows.select("candidate_id", "rank", "score", F.col("gated").cast("int").alias("gated"), *settings), 9)


# ---- strata ------------------------------------------------------------------------


def _labelled_documents(spark, sf_dir):
    """Labelled documents ranked by size; positives are the ones of high quality."""
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = inputs.table(spark, sf_dir, "labels")
    rows = documents.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic",
        F.when(F.col("quality") == 1, "known_positive").otherwise("matched_decoy").alias("label"),
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("sequence"),
    )
    return global_rank(rows, [], [F.col("n_chars").desc(), F.col("sequence")], total="n_rows")


SUBSETS = {
    "all": lambda: F.lit(True),
    "english": lambda: F.col("lang") == "en",
    "short": lambda: F.col("n_chars") <= 500,
    "short_english": lambda: (F.col("n_chars") <= 500) & (F.col("lang") == "en"),
    "toxic": lambda: F.col("toxic") == 1,
    "first_source": lambda: F.col("source") == "src0",
    "empty": lambda: F.col("n_chars") < 0,
}


@query
def stratified_recovery(spark, sf_dir):
    """Named overlapping subsets of positives; subsets without rows are reported with zero."""
    ranked = _labelled_documents(spark, sf_dir).where(metrics.is_positive())
    tags = F.array_compact(F.array(*[F.when(p(), F.lit(n)) for n, p in SUBSETS.items()]))
    summary = metrics.with_enrichment(metrics.strata_summary(ranked.withColumn("tags", tags), [])).drop("n_rows")
    wanted = spark.createDataFrame([(n,) for n in SUBSETS], "tag string")
    return rounded(wanted.join(summary, "tag", "left").fillna(
        0, ["n_positive", "top_1pct_count", "top_10pct_count", "top_100_count"]
    ))


@query
def failure_strata(spark, sf_dir):
    """Multi-valued stratum tags including source:<x>; only groups that occur."""
    ranked = _labelled_documents(spark, sf_dir).where(metrics.is_positive())
    tags = F.array_compact(
        F.array(
            F.lit("all"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang"),
            F.when(F.col("n_chars") <= 1000, "chars_le_1000"), F.when(F.col("n_chars") <= 3000, "chars_le_3000"),
            F.when(F.col("toxic") == 1, "toxic"),
        )
    )
    return rounded(metrics.with_enrichment(metrics.strata_summary(ranked.withColumn("tags", tags), [])))


def _panel_tags(spark, sf_dir):
    """Strata of every panel string; of the rows that hold it, the last one of the panel counts."""
    opened = inputs.raw_word_rows(inputs.table(spark, sf_dir, "benchmark"), "item_id")
    rows = opened.select(
        inputs.to_residues(F.col("word")).alias("sequence"), F.struct("item_id", "place").alias("ordinal"), (F.col("item_id") % 4).alias("material")
    )
    last = panels.latest_per_key(rows, "sequence", "ordinal")
    size = F.length("sequence")
    tags = F.array_compact(F.array(
        F.lit("all"), F.concat(F.lit("material:"), "material"), F.when(size <= 3, "length_le_3"), F.when(size.between(4, 6), "length_4_6"),
        F.when(size > 6, "length_gt_6"), F.when(F.col("sequence").endswith("P"), "ends_proline"),
    ))
    return last.select("sequence", tags.alias("tags"))


@query
def mode_failure_strata(spark, sf_dir):
    """Every score mode and stratum of the panel: recovery, enrichment over random and tail probability."""
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    placed = ordered_parts(labelled_modes(universe, universe), ["mode"], metrics.total_order())
    found, _ = flagged_ranks(placed.select("mode", "sequence", "label", "_at"), ["mode"], metrics.is_positive())
    tagged = found.select("mode", "sequence", "rank", "n_rows").join(_panel_tags(spark, sf_dir), "sequence")
    return rounded(metrics.with_enrichment(metrics.strata_summary(tagged, ["mode"]), (1.0, 10.0)))


@query
def panel_composition(spark, sf_dir):
    """Composition of the word panels of `benchmark` and `conversations`."""
    bench = inputs.raw_words(inputs.table(spark, sf_dir, "benchmark"), "item_id").select(
        F.lit("benchmark").alias("panel"), F.col("item_id").alias("reference"),
        F.substring("word", 1, 1).alias("material"), F.col("word").alias("sequence"),
    )
    talk = inputs.raw_words(inputs.table(spark, sf_dir, "conversations"), "conv_id", "role").select(
        F.concat(F.lit("conversations_"), "role").alias("panel"), F.col("conv_id").alias("reference"),
        F.substring("word", 1, 1).alias("material"), F.col("word").alias("sequence"),
    )
    return panels.composition(bench.unionByName(talk), ["panel"])


# ---- overlap and neighbours ------------------------------------------------------------


@query
def overlap_audit(spark, sf_dir):
    return overlap.overlap_audit(inputs.panel_words(spark, sf_dir), inputs.prior_words(spark, sf_dir))


@query
def overlap_panels(spark, sf_dir):
    return overlap.overlaps(inputs.panel_words(spark, sf_dir), inputs.prior_words(spark, sf_dir))


@query
def exclusion_antijoin(spark, sf_dir):
    return overlap.without(inputs.document_words(spark, sf_dir), inputs.prior_words(spark, sf_dir))


@query
def nearest_neighbor_audit(spark, sf_dir):
    """Panel strings against all conversation strings: nearest, counts, suffixes and class."""
    panel = inputs.panel_words(spark, sf_dir).select("sequence")
    prior = materialize(inputs.prior_words(spark, sf_dir))
    audit = neighbors.neighbor_audit(panel, prior)
    for width in (2, 3):
        audit = neighbors.suffix_counts(audit, prior, width)
    listed = prior.groupBy("sequence").agg(text.sorted_set(F.col("panel")).alias("nearest_panels"))
    named = audit.join(listed.withColumnRenamed("sequence", "nearest"), "nearest", "left")
    return rounded(named.withColumn("neighborhood_class", neighbors.neighborhood_class()), 4)


@query
def neighborhood_summary(spark, sf_dir):
    audit = nearest_neighbor_audit(spark, sf_dir)
    return audit.groupBy("neighborhood_class").agg(
        F.count(F.lit(1)).alias("n"), round_to(F.avg("nearest_identity"), 4).alias("mean_identity")
    )


@query
def neighborhood_report(spark, sf_dir):
    """The audit of the panel in one row, with the ranks of its strings among all documents' words."""
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    scored = score_wide(universe.select("candidate_id", "sequence")).select("sequence", "length", F.col("sar").alias("score"))
    ranked = materialize(global_rank(scored, [], metrics.total_order()))
    audit = nearest_neighbor_audit(spark, sf_dir)
    return rounded(neighbors.audit_report(neighbors.with_top_ranks(audit, ranked)))


@query
def suffix_sharing(spark, sf_dir):
    """How many conversation strings share the last two and three letters of each document string."""
    words = inputs.document_words(spark, sf_dir).select("sequence")
    prior = inputs.prior_words(spark, sf_dir)
    return neighbors.suffix_counts(neighbors.suffix_counts(words, prior, 2), prior, 3)


# ---- notes and metadata ------------------------------------------------------------------


def _metadata(spark, sf_dir):
    notes = inputs.notes(spark, sf_dir)
    readout = text.readout_class(F.col("notes"))
    parsed = {f"ic50_{n}": c for n, c in text.range_potency(F.col("notes")).items()}
    return notes.withColumns({**parsed, "readout": readout}).withColumns(
        {
            "inhibition_percent": text.inhibition_percent(F.col("notes")),
            "digestive_context": text.digestive_context(F.col("context"), F.col("notes")),
            "evidence": text.evidence_strength(F.col("context"), F.col("notes"), F.col("readout")),
            "potency_um": text.number_in(F.col("notes"), fixed.POTENCY_UM),
        }
    )


@query
def assay_metadata(spark, sf_dir):
    kept = _metadata(spark, sf_dir).drop("user_id", "value", "context", "event_type")
    return rounded(kept)


@query
def metadata_counts(spark, sf_dir):
    rows = _metadata(spark, sf_dir)
    return rows.groupBy("readout", "evidence", "digestive_context").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"),
        F.count("ic50_um_low").alias("with_um"),
        F.count_if(F.lower("ic50_unit").isin("mg/ml", "ug/ml")).alias("with_mass"),
    )


@query
def potency_weights(spark, sf_dir):
    """Training weight of every user: the largest over its parsed potencies."""
    rows = _metadata(spark, sf_dir).where(F.col("ic50_um_low").isNotNull())
    weighted = rows.select(
        F.col("user_id").alias("sequence"), mathx.potency_weight(F.col("ic50_um_low"), 1000.0, 3.0).alias("weight")
    )
    return rounded(panels.weight_per_key(weighted))


@query
def training_merge(spark, sf_dir):
    """Training rows: all positives and decoys, and background sampled per positive."""
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    keys = universe.select("sequence", "label")
    weights = universe.where(metrics.is_positive()).select(
        "sequence", mathx.potency_weight(F.col("n").cast("double"), 100.0, 3.0).alias("weight")
    )
    return rounded(panels.training_merge(keys, weights, per_positive=4))


# ---- strings -------------------------------------------------------------------------------


@query
def kmer_frequencies(spark, sf_dir):
    tokens = text.kmer_tokens(F.col("sequence"))
    return rounded(inputs.document_words(spark, sf_dir).select("sequence", F.inline(tokens)))


@query
def edge_ngrams(spark, sf_dir):
    """How many document strings share each edge n-gram."""
    tokens = inputs.document_words(spark, sf_dir).select(F.explode(text.edge_ngrams(F.col("sequence"))).alias("token"), "n")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_occurrences"))


@query
def position_categories(spark, sf_dir):
    tokens = inputs.document_words(spark, sf_dir).select(F.explode(text.position_tokens(F.col("sequence"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_sequences"))


@query
def motif_counts(spark, sf_dir):
    """How many document strings carry each motif and terminal class."""
    words = inputs.document_words(spark, sf_dir)
    flags = text.motif_flags(F.col("sequence"))
    return words.groupBy(F.length("sequence").alias("length")).agg(
        *[F.sum(c).cast("bigint").alias(name) for name, c in flags.items()]
    )


@query
def pwm_sites(spark, sf_dir):
    """All sites above the threshold in the panel and document strings."""
    profile = cleavage.cleavage_profile(inputs.document_words(spark, sf_dir).select("sequence"))
    return rounded(profile.select("sequence", "enzyme", F.inline("sites")))


@query
def pwm_profile(spark, sf_dir):
    profile = cleavage.cleavage_profile(inputs.document_words(spark, sf_dir).select("sequence"))
    return rounded(profile.select("sequence", "enzyme", F.size("sites").alias("n_sites"), "probability"))


@query
def pwm_stability(spark, sf_dir):
    return rounded(cleavage.stability(inputs.document_words(spark, sf_dir).select("sequence")))


@query
def uptake_index(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir)
    return rounded(words.select("sequence", features.uptake_index(F.col("sequence")).alias("uptake")))


@query
def hydrophobic_moment(spark, sf_dir):
    moment = features.hydrophobic_moment(F.col("sequence"))
    words = inputs.document_words(spark, sf_dir).select("sequence", moment.alias("moment"))
    return rounded(words.withColumn("moment_norm", mathx.clamp01(F.col("moment") / F.lit(4.5))))


@query
def engagement(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir)
    return rounded(words.select("sequence", features.engagement(F.col("sequence")).alias("engagement")))


@query
def exposure(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir)
    return rounded(words.select("sequence", features.exposure(F.col("sequence")).alias("exposure")))


@query
def property_trace(spark, sf_dir):
    return rounded(traces.property_trace(inputs.document_words(spark, sf_dir)))


@query
def run_features(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir)
    return rounded(words.select("sequence", *[c.alias(n) for n, c in features.run_features(F.col("sequence")).items()]))


@query
def logistic_score(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir)
    raw = words.select("sequence", *[c.alias(f"_{n}") for n, c in features.run_features(F.col("sequence")).items()])
    transforms = features.run_transforms({c[1:]: F.col(c) for c in raw.columns if c != "sequence"})
    named = raw.select("sequence", *[c.alias(n) for n, c in transforms.items()])
    score = features.signed_weight_score({n: F.col(n) for n in transforms})
    return rounded(named.withColumn("score", score))


@query
def shuffle_zscore(spark, sf_dir):
    return rounded(traces.shuffle_zscore(inputs.panel_words(spark, sf_dir)), 5)


@query
def residue_descriptors(spark, sf_dir):
    words = inputs.document_words(spark, sf_dir)
    return rounded(words.select("sequence", *[c.alias(n) for n, c in features.residue_descriptors(F.col("sequence")).items()]))


def _developability(s):
    """Developability flag; surface and partition stand-ins grow with the length."""
    return features.developability_flag(
        s, features.molecular_weight(s), F.when(F.length(s) > 2, F.length(s) * 60.0),
        F.lit(8.0) * text.fraction_of(s, fixed.HYDROPHOBIC),
    )


@query
def developability(spark, sf_dir):
    """Developability flag counts."""
    flag = _developability(F.col("sequence"))
    return inputs.document_words(spark, sf_dir).groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


# ---- conditional model and variants -------------------------------------------------------


@query
def kmer_lm_score(spark, sf_dir):
    words = materialize(inputs.document_words(spark, sf_dir))
    model = materialize(context_model.train(words, "n"))
    return rounded(context_model.log_likelihood(inputs.panel_words(spark, sf_dir), model))


@query
def top_substitutions(spark, sf_dir):
    model = materialize(context_model.train(inputs.document_words(spark, sf_dir), "n"))
    best = context_model.top_substitutions(inputs.panel_words(spark, sf_dir), model, 3)
    return rounded(best)


@query
def variants(spark, sf_dir):
    """New strings one or two substitutions away from a panel string, not seen in any document."""
    words = materialize(inputs.document_words(spark, sf_dir))
    model = materialize(context_model.train(words, "n"))
    parents = inputs.panel_words(spark, sf_dir).select("sequence", F.col("sequence").alias("parent_order"))
    blocked = words.select("sequence").unionByName(parents.select("sequence"))
    return rounded(context_model.variants(parents, model, blocked))


@query
def variant_table(spark, sf_dir):
    """The best 300 new strings around the 40 best ranked panel strings: score, change, nearest panel string, flag."""
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    scored = score_wide(universe.select("candidate_id", "sequence")).select("candidate_id", "sequence", "length", F.col("sar").alias("score"))
    ranked = global_rank(unblinded(scored, universe, required=True), [], metrics.total_order())
    known = materialize(inputs.panel_words(spark, sf_dir).select("sequence"))
    parents = materialize(panels.first_members(ranked, known, 40).select("sequence", F.col("rank").alias("parent_order")))
    words = universe.where(F.col("n") > 0).select("sequence", "n")
    model = materialize(context_model.train(words, "n"))
    found = context_model.variant_table(parents, model, known, universe, _developability(F.col("sequence")), 300)
    return rounded(found.drop("total_ll"))


# ---- two-score fusion and validation ----------------------------------------------------------


@query
def lm_fusion_curve(spark, sf_dir):
    rows = inputs.grouped_pairs(spark, sf_dir)
    curve = validation.fusion_curve(rows, "s1", "s2", length_scaled=True)
    return rounded(curve)


@query
def correlations(spark, sf_dir):
    rows = inputs.grouped_pairs(spark, sf_dir).withColumn("s2", F.rint(F.col("s2") * 20.0) / 20.0)
    return rounded(metrics.correlations(rows, ["label"], "s1", "s2", "candidate_id"))


@query
def grouped_cv_fusion(spark, sf_dir):
    rows = inputs.grouped_pairs(spark, sf_dir).where(metrics.is_positive() | metrics.is_matched())
    return rounded(validation.grouped_cv(rows, "s1", "s2", repeats=3, folds=5))


@query
def cv_summary(spark, sf_dir):
    rows = inputs.grouped_pairs(spark, sf_dir).where(metrics.is_positive() | metrics.is_matched())
    return rounded(validation.cv_summary(validation.grouped_cv(rows, "s1", "s2", repeats=3, folds=5)))


def _scenarios(spark, sf_dir):
    rows = inputs.grouped_pairs(spark, sf_dir).where(metrics.is_positive() | metrics.is_matched())
    return validation.scenario_cv(rows, "s1", "s2", repeats=3, folds=5), rows


@query
def stratified_cv(spark, sf_dir):
    """Folds of whole groups balanced on positives, with the second score raw and scaled by length."""
    return rounded(_scenarios(spark, sf_dir)[0])


@query
def stratified_cv_summary(spark, sf_dir):
    return rounded(validation.scenario_summary(*_scenarios(spark, sf_dir)))


def _frozen(spark, sf_dir):
    fused = validation.frozen_fusion(inputs.grouped_pairs(spark, sf_dir), "s1", "s2", 0.65)
    return global_rank(fused, [], metrics.total_order(length=None), total="n_rows")


@query
def frozen_lm_fusion(spark, sf_dir):
    ranked = _frozen(spark, sf_dir)
    return rounded(ranked.select("candidate_id", "rank", "first_norm", "length_z", "second_norm", "score"))


@query
def shortlist(spark, sf_dir):
    """First 40 background rows of the frozen fusion."""
    rows = panels.shortlist(_frozen(spark, sf_dir), 40)
    return rounded(rows.select("candidate_id", "rank", "label", "score"))


@query
def consensus(spark, sf_dir):
    """Three components act as models that each list their best 60 rows; merged and ranked."""
    listed = _ranked_components(spark, sf_dir).where(F.col("component").isin("c01", "c02", "c03") & (F.col("rank") <= 60))
    parent = (F.col("candidate_id") % 7).cast("string")
    rows = listed.select(
        F.col("component").alias("model_id"), "sequence", "rank", "score",
        (F.col("score") - 0.1).alias("delta"), parent.alias("parent"),
        (F.lit(1) + F.col("candidate_id") % 2).alias("edit_count"),
        F.concat(F.lit("A"), F.col("length"), F.lit("V")).alias("mutations"),
        F.concat(F.lit("P"), parent).alias("nearest"), (F.col("candidate_id") % 5).cast("int").alias("nearest_distance"),
        F.col("label").alias("flag"),
    )
    return rounded(panels.rank_consensus(panels.consensus(rows), 80))


@query
def scoring_panel(spark, sf_dir):
    ranked = _ranked_components(spark, sf_dir).where(F.col("component") == "c01")
    return panels.scoring_panel(ranked, top=60, sampled=50).select("candidate_id", "scenario_group", "rank")


@query
def role_panel(spark, sf_dir):
    ranked = _ranked_components(spark, sf_dir).where(F.col("component") == "c02")
    anchors = F.col("candidate_id").isin(1, 9, 60)
    return panels.role_panel(ranked, anchors, most=12, per_positive=2, longest=8).select("candidate_id", "panel_role", "rank")


@query
def rank_list_eval(spark, sf_dir):
    ranks = _ranked_components(spark, sf_dir).where(metrics.is_positive()).select("component", "rank", "n_rows")
    return rounded(manifest.evaluate_rank_list(ranks, ["component"]))


@query
def expectations(spark, sf_dir):
    """A component's summary checked against expected values with tolerances."""
    one = inputs.components(spark, sf_dir).where(F.col("component") == "c01")
    summary = metrics.evaluate(one, ["component"])
    rows = inputs.table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("table_rows"))
    return rounded(manifest.expect(summary.crossJoin(rows), {"n_rows": ("table_rows", 0), "auroc_all": (0.5, 0.1), "auroc_matched": (0.9, 0.01)}))


# ---- models ---------------------------------------------------------------------------------


def _model_scores(spark, sf_dir):
    universe = materialize(inputs.keyed_universe(spark, sf_dir))
    weights = universe.where(metrics.is_positive()).select("sequence", F.lit(1.0).alias("weight"))
    train = materialize(panels.training_merge(universe.select("sequence", "label"), weights, per_positive=4))
    fitted = models.train_family(train, ["logistic_c0_2", "svm_c0_2"])
    return models.score_family(fitted, universe.select("sequence", "label"), ["sequence", "label"])


@query
def linear_models(spark, sf_dir):
    """Scores of two linear models for every string."""
    return rounded(_model_scores(spark, sf_dir))


@query
def model_leaderboard(spark, sf_dir):
    scores = materialize(_model_scores(spark, sf_dir)).withColumn("length", F.length("sequence"))
    return rounded(models.leaderboard(scores))


@query
def training_tokens(spark, sf_dir):
    """Sparse training features: how often each token occurs and its total value."""
    tokens = models.feature_tokens(inputs.panel_words(spark, sf_dir).select("sequence"))
    long = tokens.select(F.inline("tokens"))
    return rounded(long.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


# ---- geometry, manifests and files -------------------------------------------------------------


def _atoms(spark, sf_dir):
    e = F.col("embedding")
    element = F.element_at(F.array(*[F.lit(x) for x in "CONSHCOHNC"]), F.col("label") + 1)
    return inputs.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("pose"), (F.col("vec_id") % 3).alias("residue_number"),
        element.alias("element"), F.when(element == "O", "OXT").otherwise("CA").alias("name"),
        *[(e[i].cast("double") * 10.0).alias(n) for i, n in enumerate("xyz")],
    )


@query
def contact_geometry(spark, sf_dir):
    return rounded(geometry.contact_geometry(_atoms(spark, sf_dir), (0.5, -0.5, 0.25)))


@query
def contact_metrics(spark, sf_dir):
    """Pose scores and their separation of two roles, metric by metric."""
    table = geometry.contact_geometry(_atoms(spark, sf_dir), (0.5, -0.5, 0.25))
    poses = table.select(
        "pose", F.when(F.col("pose") % 2 == 0, "positive").otherwise("hard_matched_decoy").alias("role"),
        (F.lit(3) + F.col("pose") % 4).cast("int").alias("length"), (F.lit(-4.0) - F.col("pose") % 9).alias("affinity"),
    )
    scored = geometry.pose_scores(table, poses)
    return rounded(geometry.metric_table(scored, ["min_heavy", "contact", "raw_share", "per_residue_share", "pose_score"]))


@query
def table_manifest(spark, sf_dir):
    """Rows and digest of the event notes per type, and of the universe per label."""
    rows = inputs.notes(spark, sf_dir)
    table = manifest.manifest(rows, ["event_id", "user_id", "notes"], ["event_type"])
    return table.withColumn("digest", F.col("digest").cast("string"))


@query
def file_digests(spark, sf_dir):
    files = text_files.file_digests(spark, sf_dir, "*.parquet")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "sha256")


def _scratch(spark, name):
    import uuid

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def fasta_scan(spark, sf_dir):
    """All documents written as FASTA records and read back."""
    path = _scratch(spark, "fasta")
    record = F.concat(F.lit(">doc"), F.col("accession"), F.lit(" "), F.col("source_class"), F.lit("\n"), F.col("sequence"))
    inputs.proteins(spark, sf_dir).select(record.alias("value")).write.text(path)
    good, bad = text_files.read_fasta(spark, path)
    kept = good.select("accession", "header", F.length("sequence").alias("n"), F.sha2("sequence", 256).alias("sha256"))
    return kept.unionByName(bad.select("accession", "header", F.lit(0).alias("n"), F.lit("").alias("sha256")))


@query
def fixed_width_scan(spark, sf_dir):
    """Vectors written as fixed-width atom records, one file text per pose, and parsed."""
    atoms = _atoms(spark, sf_dir).withColumn("serial", F.row_number().over(Window.partitionBy("pose").orderBy("x", "y", "z")))
    fmt = lambda v: F.format_string("%8.3f", F.col(v))
    kind = F.when(F.col("element") == "O", "OA").when(F.col("element") == "H", "HD").otherwise(F.col("element"))
    line = F.concat(
        F.lit("ATOM  "), F.lpad(F.col("serial").cast("string"), 5, " "), F.lit("  "), F.rpad("name", 3, " "), F.lit(" GLY A"),
        F.lpad(F.col("residue_number").cast("string"), 4, " "), F.lit("    "), fmt("x"), fmt("y"), fmt("z"),
        F.lit("  1.00  0.00     0.000 "), kind,
    )
    texts = atoms.groupBy("pose").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", line.alias("line")))), lambda s: s["line"]), "\n").alias("body")
    )
    files = texts.select(
        F.col("pose").cast("string").alias("path"),
        F.concat(F.lit("MODEL 1\n"), "body", F.lit("\nENDMDL\nMODEL 2\n"), "body", F.lit("\nENDMDL\n")).alias("value"),
    )
    parsed = text_files.atoms_of(files)
    return parsed.select("path", "serial", "name", "residue_number", "x", "y", "z", "atom_type", "element")


@query
def tsv_scan(spark, sf_dir):
    """Notes written with padded header and cells and read back trimmed."""
    path = _scratch(spark, "tsv")
    rows = inputs.notes(spark, sf_dir)
    padded = rows.select(
        F.concat(F.lit(" "), F.col("event_id"), F.lit(" ")).alias(" id "), F.concat(F.lit("  "), "notes").alias(" notes "),
    )
    padded.write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = tables.read_tsv_trimmed(spark, path)
    return back.select(F.col("id").cast("bigint").alias("event_id"), "notes")
