"""Recovery, enrichment, separation and precision metrics, always grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MATCHED_LABEL, POSITIVE_LABELS
from ..functions.mathx import harmonic_span, hypergeometric_tail
from .ordering import AT, flagged_ranks, global_rank, ordered_parts, part_offsets, rows_above, running_totals, tied_positions

PERCENTS = (1.0, 5.0, 10.0)
TOPS = (10, 25, 50, 100)


def is_positive(label: Column | None = None) -> Column:
    return (F.col("label") if label is None else label).isin(*POSITIVE_LABELS)


def is_matched(label: Column | None = None) -> Column:
    return (F.col("label") if label is None else label) == MATCHED_LABEL


def cutoff(total: Column, percent: float) -> Column:
    """max(1, ceil(total * percent / 100)), the product taken in whole numbers."""
    scaled = total * F.lit(int(round(percent * 1000)))
    return F.greatest(F.lit(1), F.ceil(scaled / F.lit(100000)))


def tag(percent: float) -> str:
    return f"{percent:g}".replace(".", "_")


def total_order(score: str = "score", length: str | None = "length", sequence: str = "sequence") -> list[Column]:
    """Best score first, then shorter, then alphabetical; `length=None` leaves length out."""
    keys = [F.col(score).desc()]
    if length:
        keys.append(F.col(length))
    return [*keys, F.col(sequence)]


def with_topk_flags(ranked: DataFrame, total: str = "n_rows") -> DataFrame:
    flags = {"top_1pct": F.col("rank") <= cutoff(F.col(total), 1.0)}
    flags.update({f"top_{k}": F.col("rank") <= k for k in TOPS})
    return ranked.withColumns({name: flag.cast("int") for name, flag in flags.items()})


def separation(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """AUROC against all and matched negatives, and three average precisions, per group.

    Works on distinct scores with their class counts, so ties get half credit without
    comparing pairs. `ap_step` groups ties; `ap_positives_first` lists the positives of
    a tie before its negatives, summed in closed form.

    Rows that `ordered_parts` has placed are not ordered again: where a score begins tells how
    many rows are above it. Only scores of positives and matched negatives get running counts.
    """
    rows = df if AT in df.columns else ordered_parts(df, by, [F.col(score).desc()])
    counted = rows.groupBy(*by, score).agg(
        F.count_if(is_positive()).alias("pos"), F.count_if(is_matched()).alias("mat"),
        F.count(F.lit(1)).alias("tied"), F.min(AT).alias(AT),
    )
    offsets = part_offsets(rows, by)
    labelled = rows_above(counted.where((F.col("pos") > 0) | (F.col("mat") > 0)), offsets, by, "above")
    run = running_totals(labelled, by, [F.col(score)], ["pos", "mat"])
    totals = offsets.groupBy(*by).agg(F.max("_rows").cast("double").alias("_rows"))
    p, n = F.col("total_pos").cast("double"), F.col("_rows") - F.col("total_pos")
    pos, mat, tied, above = (F.col(c).cast("double") for c in ("pos", "mat", "tied", "above"))
    tp_before = p - F.col("cum_pos")
    neg = tied - pos
    wins_all = pos * (n - (above - tp_before) - neg * F.lit(0.5))
    wins_matched = pos * (F.col("cum_mat") - mat * F.lit(0.5))
    tp = tp_before + pos
    harmonic, ramp = harmonic_span(above, pos)
    first = tp_before * harmonic + ramp
    summed = run.join(totals, by).groupBy(*by).agg(
        F.sum(wins_all).alias("_all"),
        F.sum(wins_matched).alias("_matched"),
        F.sum(pos * tp / (above + tied)).alias("_step"),
        F.sum(F.when(pos > 0, first).otherwise(F.lit(0.0))).alias("_first"),
        F.max(p).alias("_p"),
        F.max(n).alias("_n"),
        F.max("total_mat").cast("double").alias("_m"),
    )
    some = lambda c: F.nullif(c, F.lit(0.0))
    return totals.select(*by).join(summed, by, "left").select(
        *by,
        (F.col("_all") / some(F.col("_p") * F.col("_n"))).alias("auroc_all"),
        (F.col("_matched") / some(F.col("_p") * F.col("_m"))).alias("auroc_matched"),
        (F.col("_step") / some(F.col("_p"))).alias("ap_step"),
        (F.col("_first") / some(F.col("_p"))).alias("ap_positives_first"),
    )


def number_hits(positives: DataFrame, by: list[str], total: str = "n_positive") -> DataFrame:
    """Number the positives of a group by rank: `hit` 1..P."""
    return global_rank(positives, by, [F.col("rank")], "hit", total)


def rank_statistics(hits: Column, count: Column) -> list[Column]:
    """Mean, median (mean of middles), upper median and best rank as aggregates over numbered hits."""
    rank = F.col("rank").cast("double")
    lower = F.max(F.when(hits == F.floor((count + 1) / F.lit(2)), rank))
    upper = F.max(F.when(hits == F.floor(count / F.lit(2)) + 1, rank))
    return [
        F.avg(rank).alias("mean_rank"),
        ((lower + upper) / F.lit(2.0)).alias("median_rank"),
        upper.alias("upper_median_rank"),
        F.min("rank").alias("best_rank"),
        F.avg(hits / rank).alias("ap_ranked"),
    ]


def recovery(rows: DataFrame, by: list[str], percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """Recovery of positives per group, from rows placed by `ordered_parts` in rank order."""
    found, totals = flagged_ranks(rows.select(*by, "label", "_at"), by, is_positive())
    counts = []
    for percent in percents:
        inside = F.col("rank") <= cutoff(F.col("n_rows"), percent)
        counts.append(F.count_if(inside).alias(f"top_{tag(percent)}pct_count"))
    counts += [F.count_if(F.col("rank") <= k).alias(f"top_{k}_count") for k in TOPS]
    stats = found.groupBy(*by).agg(*counts, *rank_statistics(F.col("hit"), F.col("n_positive")))
    names = [f"top_{tag(p)}pct_count" for p in percents] + [f"top_{k}_count" for k in TOPS]
    return totals.join(stats, by, "left").fillna(0, names)


def with_enrichment(summary: DataFrame, percents: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Fraction, enrichment over random and tail probability at the percent cuts.

    The cuts go through one array so that the plan holds the tail sum once.
    """
    pairs = F.array(
        *[
            F.struct(F.col(f"top_{tag(p)}pct_count").alias("hits"), cutoff(F.col("n_rows"), p).alias("cut"))
            for p in percents
        ]
    )
    tail = hypergeometric_tail("t.hits", "n_rows", "n_positive", "t.cut")
    summary = summary.withColumn("_pairs", pairs)
    tails = F.expr(f"transform(_pairs, t -> {tail})")
    summary = summary.withColumn("_tails", tails)
    added = {}
    for i, percent in enumerate(percents):
        name = f"top_{tag(percent)}pct"
        count, cut = F.col(f"{name}_count"), cutoff(F.col("n_rows"), percent)
        expected = F.col("n_positive") * cut / F.col("n_rows")
        added[f"{name}_fraction"] = count / F.nullif(F.col("n_positive"), F.lit(0))
        added[f"{name}_enrichment"] = count / F.greatest(F.lit(1e-12), expected)
        added[f"{name}_p"] = F.get("_tails", F.lit(i))
    return summary.withColumns(added).drop("_pairs", "_tails")


def evaluate(
    scored: DataFrame,
    by: list[str],
    score: str = "score",
    length: str | None = "length",
    percents: tuple[float, ...] = PERCENTS,
) -> DataFrame:
    """Rank, then recovery, enrichment and separation: one row per group.

    The rows are ordered and written once; everything else reads only the columns it needs
    from there. `by` names at least one column.
    """
    rows = ordered_parts(scored, by, total_order(score, length))
    summary = with_enrichment(recovery(rows, by, percents), percents)
    return summary.join(separation(rows, by, score), by)


def endpoint_pass(count: Column, fraction: Column, auroc: Column, least: tuple[int, float, float]) -> Column:
    """All thresholds met; a missing AUROC passes."""
    enough_count, enough_fraction, enough_auroc = least
    separated = auroc.isNull() | F.isnan(auroc) | (auroc >= enough_auroc)
    return (count >= enough_count) & (fraction >= enough_fraction) & separated


def rank_histogram(ranked: DataFrame, by: list[str], width: int = 100) -> DataFrame:
    bucket = (F.floor((F.col("rank") - 1) / F.lit(width)) + 1) * F.lit(width)
    return ranked.where(is_positive()).groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def strata_summary(tagged: DataFrame, by: list[str], percents: tuple[float, ...] = (1.0, 10.0)) -> DataFrame:
    """Recovery of positives per (group, tag); `tagged` has an array column `tags`."""
    long = tagged.select(*by, "rank", "n_rows", F.explode("tags").alias("tag"))
    keys = [*by, "tag"]
    numbered = number_hits(long, keys)
    counts = [F.max("n_positive").alias("n_positive"), F.max("n_rows").alias("n_rows")]
    for percent in percents:
        inside = F.col("rank") <= cutoff(F.col("n_rows"), percent)
        counts.append(F.count_if(inside).alias(f"top_{tag(percent)}pct_count"))
    counts.append(F.count_if(F.col("rank") <= 100).alias("top_100_count"))
    return numbered.groupBy(*keys).agg(*counts, *rank_statistics(F.col("hit"), F.col("n_positive")))


def correlations(df: DataFrame, by: list[str], left: str, right: str, key: str) -> DataFrame:
    """Pearson and Spearman per group; NULL for constant input or fewer than two rows."""
    ranked = df.select(*by, key, left, right)
    for name in (left, right):
        positions = tied_positions(ranked, by, name).select(*by, name, F.col("avg_rank").alias(f"_rank_{name}"))
        ranked = ranked.join(positions, [*by, name])
    pairs = {"pearson": (left, right), "spearman": (f"_rank_{left}", f"_rank_{right}")}
    usable = (F.count(F.lit(1)) > 1) & (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    out = [F.when(usable, F.corr(a, b)).alias(name) for name, (a, b) in pairs.items()]
    out.append(F.count(F.lit(1)).alias("n_rows"))
    return ranked.groupBy(*by).agg(*out) if by else ranked.agg(*out)
