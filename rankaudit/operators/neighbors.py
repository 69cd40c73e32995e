"""Edit-distance neighbours and shared suffixes between two collections.

No all-pairs join and no join on a single letter. If two strings are at most d edits apart and one of them is cut into
d + 1 pieces, at least one piece survives in the other, moved by at most d places. Pieces of a long string give an
equi-join key. For short strings, whose pieces would be letters, the keys are what is left after up to two deletions.
Strings without a near neighbour are a small rest; they are searched by letter counts, in blocks of stated size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity, suffix
from ..session import materialize, spread


def _pieces(sequence: Column, radius: Column) -> Column:
    """`radius` + 1 near-equal pieces as (piece, start); the string is longer than the radius."""
    count = radius + F.lit(1)
    size = F.length(sequence)

    def bound(i: Column) -> Column:
        return F.floor(size * i / count).cast("int")

    return F.transform(
        F.sequence(F.lit(0), radius),
        lambda i: F.struct(
            F.substring(sequence, bound(i) + F.lit(1), bound(i + F.lit(1)) - bound(i)).alias("piece"),
            (bound(i) + F.lit(1)).alias("start"),
        ),
    )


def _placed_pieces(queries: DataFrame) -> DataFrame:
    """Every (piece, start, length) that a string within the radius can show.

    A piece moved by `left` places needs that many edits before it, and `right` further
    ones behind it account for the length of the other string.
    """
    r = F.col("radius")
    pieces = queries.select("query", "radius", F.inline(_pieces(F.col("query"), r)))
    lefts = pieces.withColumn("left", F.explode(F.sequence(-r, r)))
    spare = r - F.abs("left")
    moved = lefts.withColumn("right", F.explode(F.sequence(-spare, spare)))
    placed = moved.select(
        "query", "radius", "piece",
        (F.col("start") + F.col("left")).alias("start"),
        (F.length("query") + F.col("left") + F.col("right")).alias("size"),
    )
    fits = (F.col("start") >= 1) & (F.col("start") + F.length("piece") - 1 <= F.col("size"))
    return placed.where(fits)


def _substrings(other: Column, widths: tuple[int, int]) -> Column:
    """All substrings of the wanted widths with their start."""
    size = F.length(other)
    shortest, longest = widths

    def of_width(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), size - w + F.lit(1)),
            lambda i: F.struct(F.substring(other, i, w).alias("piece"), i.alias("start")),
        )

    usable = F.sequence(F.lit(shortest), F.least(F.lit(longest), size))
    empty = F.array().cast("array<struct<piece:string,start:int>>")
    return F.when(size >= shortest, F.flatten(F.transform(usable, of_width))).otherwise(empty)


def pairs_within(queries: DataFrame, prior: DataFrame) -> DataFrame:
    """All (query, other, distance) with distance <= the query's `radius`, each once.

    `queries` holds distinct (query, radius) with radius < length; `prior` distinct `other`.
    """
    count = F.col("radius") + F.lit(1)
    shortest, longest = queries.agg(
        F.min(F.floor(F.length("query") / count)), F.max(F.ceil(F.length("query") / count))
    ).first()
    widths = (int(shortest or 1), int(longest or 1))
    shown = prior.select("other", F.length("other").alias("size"), F.inline(_substrings(F.col("other"), widths)))
    candidates = _placed_pieces(queries).join(shown, ["piece", "start", "size"]).select("query", "radius", "other")
    checked = candidates.distinct().withColumn("distance", F.levenshtein("query", "other"))
    return checked.where(F.col("distance") <= F.col("radius")).select("query", "other", "distance")


def _preference() -> Column:
    """Nearest first: distance, identity, length difference, text."""
    return F.struct(
        F.col("distance"),
        (-identity(F.col("query"), F.col("other"), F.col("distance"))).alias("minus_identity"),
        F.abs(F.length("query") - F.length("other")).alias("length_gap"),
        F.col("other"),
    )


def nearest_within(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Nearest `other` of every distinct `query` by (distance, length gap, text), where `known` has one within the query's `radius`.

    The promised neighbour bounds the search, so its pieces are as long as the radius allows. A query no longer than its radius
    is searched one step nearer first; all strings of its length are as far away as it is long then, and the first one of them
    is taken.
    """
    size = F.length("query")
    others = known.select("other").distinct()
    pairs = pairs_within(queries.select("query", F.least(F.col("radius"), size - F.lit(1)).alias("radius")), others)
    best = F.min(F.struct("distance", F.abs(size - F.length("other")).alias("length_gap"), "other")).alias("best")
    near = pairs.groupBy("query").agg(best).select("query", F.col("best.other").alias("nearest"), F.col("best.distance").alias("nearest_distance"))
    rest = queries.where(F.col("radius") >= size).join(near, "query", "left_anti").withColumn("_n", size)
    first = others.groupBy(F.length("other").alias("_n")).agg(F.min("other").alias("nearest"))
    return near.unionByName(rest.join(first, "_n").select("query", "nearest", F.col("_n").alias("nearest_distance")))


def _best(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("query").agg(F.min(_preference()).alias("best"))
    return best.select("query", F.col("best.other").alias("nearest"), F.col("best.distance").alias("distance"))


#: Strings up to this length are joined by what deletions leave of them.
SHORT = 5
#: Queries that one scan of the other collection takes.
BLOCK = 4096
_BINS = 32


def _without_one(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - F.lit(1)), F.substring(t, i + F.lit(1), F.length(t))))


def _deletions(sequence: Column) -> Column:
    """The string and all that is left of it after one or two deletions, without the empty string."""
    once = F.when(F.length(sequence) > 1, _without_one(sequence)).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(once, _without_one))
    return F.filter(F.array_distinct(F.concat(F.array(sequence), once, twice)), lambda t: t != "")


def short_pairs(queries: DataFrame, prior: DataFrame) -> DataFrame:
    """All (query, other, distance) with distance <= 2 that leave a common string of one letter or more after two deletions each.

    For queries of at most `SHORT` letters; two strings of at most two letters may have nothing in common.
    """
    opened = queries.select("query", F.explode(_deletions(F.col("query"))).alias("key"))
    small = prior.where(F.length("other") <= SHORT + 2)
    keyed = small.select("other", F.explode(_deletions(F.col("other"))).alias("key"))
    pairs = opened.join(keyed, "key").select("query", "other").distinct()
    return pairs.withColumn("distance", F.levenshtein("query", "other")).where("distance <= 2")


# ---- the rest: letter counts, nearest bound first -----------------------------------------


def _counts(words: list[str]) -> np.ndarray:
    """How often letters of each bin occur; letters that share a bin only make bounds lower."""
    counts = np.zeros((len(words), _BINS), np.int32)
    owners = np.repeat(np.arange(len(words)), [len(w) for w in words])
    np.add.at(counts, (owners, np.array([ord(c) % _BINS for w in words for c in w], np.int64)), 1)
    return counts


def _edit_distances(word: str, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distances of a word to the rows of `codes`, which are padded."""
    ramp = np.arange(codes.shape[1] + 1)
    row = np.repeat(ramp[None, :], len(codes), axis=0)
    for i, letter in enumerate(word, 1):
        best = np.minimum(row[:, :-1] + (codes != ord(letter)), row[:, 1:] + 1)
        row = np.concatenate([np.full((len(codes), 1), i), best], axis=1)
        row = np.minimum.accumulate(row - ramp, axis=1) + ramp
    return row[np.arange(len(codes)), sizes]


class FarSearch:
    """The nearest string for each of some queries over batches of others.

    Others with the same letter counts are one class. What two strings have in common can not be more than their smaller
    counts, so the longer length less that is a bound. Classes are opened from the nearest bound on, until it is beyond the
    distance found.
    """

    def __init__(self, queries: list[str]):
        self.queries, self.own = queries, _counts(queries)
        self.sizes = np.array([len(q) for q in queries], np.int64)
        self.best: list[tuple | None] = [None] * len(queries)
        self.opened = 0

    def take(self, others: list[str]) -> None:
        sizes = np.array([len(o) for o in others], np.int64)
        codes = np.zeros((len(others), int(sizes.max(initial=1))), np.int32)
        for i, o in enumerate(others):
            codes[i, : len(o)] = np.frombuffer(o.encode("utf-32-le"), "<i4")
        kinds, kind = np.unique(_counts(others), axis=0, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        starts = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
        lengths = kinds.sum(axis=1)
        for at, query in enumerate(self.queries):
            bounds = np.maximum(lengths, self.sizes[at]) - np.minimum(kinds, self.own[at]).sum(axis=1)
            for bound in np.unique(bounds):
                if self.best[at] is not None and bound > self.best[at][0]:
                    break
                members = np.concatenate([order[starts[k] : starts[k + 1]] for k in np.flatnonzero(bounds == bound)])
                self.opened += len(members)
                distances = _edit_distances(query, codes[members], sizes[members])
                least = int(distances.min())
                if self.best[at] is None or least <= self.best[at][0]:
                    ties = (others[m] for m in members[distances == least])
                    found = min((least, -max(len(o), len(query)), abs(len(o) - len(query)), o) for o in ties)
                    self.best[at] = found if self.best[at] is None else min(self.best[at], found)


def _farthest(queries: DataFrame, prior: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """Nearest for queries that have nothing close: a scan of `prior` for every block of them, one answer per query and task."""
    spread_out, parts, held = spread(prior.select("other")), [], []

    def scan(block_of: list[str]) -> DataFrame:
        def work(batches):
            search = FarSearch(block_of)
            for batch in batches:
                if batch.num_rows:
                    search.take(batch.column("other").to_pylist())
            found = [(q, b[3], b[0]) for q, b in zip(block_of, search.best) if b]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int32())], ["query", "other", "distance"])

        return materialize(_best(spread_out.mapInArrow(work, "query string, other string, distance int")))

    for row in queries.select("query").toLocalIterator():
        held.append(row["query"])
        if len(held) == block:
            parts.append(scan(held))
            held = []
    if held:
        parts.append(scan(held))
    return reduce(DataFrame.unionByName, parts) if parts else None


def neighbor_audit(panel: DataFrame, prior: DataFrame) -> DataFrame:
    """Exact nearest prior string and neighbour counts for each distinct panel string.

    The first pass uses a radius that covers all counts: 2 edits, or an identity of 0.8,
    which needs at most a quarter of the length. Strings without a neighbour are searched
    again with wider radii, as long as their pieces have three letters; few are left then, and
    those are searched by letter counts.
    """
    queries = panel.select(F.col("sequence").alias("query")).distinct()
    others = prior.select(F.col("sequence").alias("other")).where(F.length("other") > 0).distinct()
    size = F.length("query")
    radius = F.greatest(F.lit(2), F.floor(size / F.lit(4)).cast("int"))
    first = queries.withColumn("radius", F.least(radius, size - F.lit(1)))
    longest = queries.agg(F.max(F.length("query"))).first()[0] or 1
    long_pairs = pairs_within(first.where(size > SHORT), others)
    pairs = materialize(long_pairs.unionByName(short_pairs(queries.where(size <= SHORT), others)))
    counts = pairs.groupBy("query").agg(
        F.count_if(F.col("distance") == 1).alias("one_edit"),
        F.count_if(F.col("distance").between(1, 2)).alias("two_edit"),
        F.count_if(
            (F.col("distance") > 0) & (identity(F.col("query"), F.col("other"), F.col("distance")) >= 0.8)
        ).alias("high_identity"),
    )
    found = [_best(pairs.where(F.col("distance") < size))]
    left = materialize(first.join(found[0], "query", "left_anti"))
    step = 3
    while 3 * (step + 1) <= longest and not left.isEmpty():
        wider = left.where(size >= 3 * (step + 1)).select("query", F.lit(step).alias("radius"))
        found.append(materialize(_best(pairs_within(wider, others))))
        left = materialize(left.join(found[-1], "query", "left_anti"))
        step += 1
    if far := _farthest(left, others):
        found.append(far)
    nearest = reduce(DataFrame.unionByName, found)
    joined = queries.join(nearest, "query", "left").join(counts, "query", "left")
    joined = joined.join(_tiny_counts(queries, others, pairs), "query", "left")
    return joined.select(
        F.col("query").alias("sequence"),
        "nearest",
        F.col("distance").alias("nearest_distance"),
        identity(F.col("query"), F.col("nearest"), F.col("distance")).alias("nearest_identity"),
        F.coalesce("tiny_one", "one_edit", F.lit(0)).alias("one_edit"),
        F.coalesce("tiny_two", "two_edit", F.lit(0)).alias("two_edit"),
        F.coalesce("high_identity", F.lit(0)).alias("high_identity"),
    )


def _tiny_counts(queries: DataFrame, others: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts for queries of one or two letters, which need nothing in common with strings as short.

    A string that shares nothing is as far away as the longer of the two is long, so those are counted by length alone.
    """
    tiny = queries.where(F.length("query") <= 2)
    near = pairs.where(F.length("query") <= 2).groupBy("query").agg(
        F.count_if(F.col("distance") == 1).alias("near_1"),
        F.count_if(F.col("distance").between(1, 2)).alias("near_2"),
        F.count_if(F.length("other") == 1).alias("shared_1"),
        F.count_if(F.length("other") <= 2).alias("shared_2"),
    )
    sizes = others.agg(
        F.count_if(F.length("other") == 1).alias("all_1"), F.count_if(F.length("other") <= 2).alias("all_2")
    )
    joined = tiny.join(near, "query", "left").crossJoin(F.broadcast(sizes)).fillna(0)
    single = F.length("query") == 1
    return joined.select(
        "query",
        (F.col("near_1") + F.when(single, F.col("all_1") - F.col("shared_1")).otherwise(F.lit(0))).alias("tiny_one"),
        (F.col("near_2") + F.col("all_2") - F.col("shared_2")).alias("tiny_two"),
    )


def with_top_ranks(audit: DataFrame, ranked: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Rank of every audited string (null where it has none) and whether it is among the best hundredth.

    The cut comes from the number of ranked rows where it is known, else from the greatest rank.
    """
    total = ranked.agg((F.lit(n_rows) if n_rows else F.max("rank")).cast("bigint").alias("_total"))
    joined = audit.join(ranked.select("sequence", "rank"), "sequence", "left").crossJoin(F.broadcast(total))
    threshold = F.greatest(F.lit(1), F.ceil(F.coalesce("_total", F.lit(0)) / F.lit(100))).cast("bigint")
    return joined.withColumn("threshold", threshold).withColumn("top_1pct", F.coalesce(F.col("rank") <= F.col("threshold"), F.lit(False))).drop("_total")


def audit_report(audit: DataFrame) -> DataFrame:
    """One row: strings in all and in the best hundredth, by neighbourhood class, and mean and median identity."""
    top = F.col("top_1pct")
    classes = ("exact_overlap", "single_edit_neighbor", "high_similarity_neighbor", "shared_suffix3", "shared_suffix2", "distant")
    named = {name: F.col("neighborhood_class") == name for name in classes}
    return audit.agg(
        F.count(F.lit(1)).alias("positive_count"), F.max("threshold").alias("threshold"), F.count_if(top).alias("top_1pct_count"),
        *[F.count_if(own).alias(f"{name}_count") for name, own in named.items()],
        *[F.count_if(own & top).alias(f"top_1pct_{name}_count") for name, own in named.items()],
        F.avg("nearest_identity").alias("mean_identity"), F.median("nearest_identity").alias("median_identity"),
    )


def suffix_counts(panel: DataFrame, prior: DataFrame, width: int) -> DataFrame:
    """How many prior strings end in the same `width` letters; shorter strings have no suffix."""
    ends = prior.select("sequence").distinct().withColumn("_end", suffix(F.col("sequence"), width))
    counted = ends.where(F.col("_end").isNotNull()).groupBy("_end").agg(F.count(F.lit(1)).alias(f"suffix{width}_count"))
    marked = panel.withColumn("_end", suffix(F.col("sequence"), width))
    return marked.join(counted, "_end", "left").fillna(0, [f"suffix{width}_count"]).drop("_end")


def neighborhood_class() -> Column:
    return (
        F.when(F.col("nearest_distance") == 0, "exact_overlap")
        .when(F.col("one_edit") > 0, "single_edit_neighbor")
        .when(F.col("high_identity") > 0, "high_similarity_neighbor")
        .when(F.col("suffix3_count") > 0, "shared_suffix3")
        .when(F.col("suffix2_count") > 0, "shared_suffix2")
        .otherwise("distant")
    )
