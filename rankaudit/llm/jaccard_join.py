"""Near copies by the Jaccard similarity of word n-grams, with a count-vector R-tree.

Documents with the same set of shingles form a class, and links are sought between classes. Shingles are hashed into
groups; the counts per group are a point, and the sum of the lesser coordinates of two points bounds their overlap.
Two similar sets share a shingle among the first of either in one global order, rare shingles first, so points are
brought together by those shingles. An R-tree over such points finds the pairs that pass the bound, and these are
verified on the whole sets in the same task, which merges what it links as it goes: a tree yields a spanning forest of
its links, never its pairs. Links through a common least hash are verified beforehand: classes that they join need no
more comparison, which keeps a large group of near copies from being compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_bucket, gathered, packed, unpacked
from .common import arrow_schema, batches_of, mix64, store, total_bytes

SHINGLE, PERCENT = 4, 85
GROUPS = 256
#: Entries of the table of frequent shingles, which only orders shingles; ties of the rest fall to their hash.
FREQUENT = 200_000
#: Points and bytes of shingles of one part of a tree; larger groups are dealt to several trees by pairs of parts.
TREE, TREE_BYTES = 4000, 8 << 20
LEAF = 16
BUCKET_BYTES = 8 << 20
#: Bits of the filter on the texts to move; a fixed size, whatever the corpus.
FILTER_BITS = 1 << 24
#: Further turns of early links, each with new heads, among the classes that share a least hash with more than `CROWD` - 1 others.
TURNS, CROWD = 4, 32
_STEP, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes, known: dict, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; a shorter one is one shingle, an empty one has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return _of_hashes(mix64(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))), size)


def _of_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """The shingles of a text of these mixed word hashes, one word at least."""
    n = max(1, len(hashed) - size + 1)
    total = np.full(n, min(len(hashed), size), np.uint64)
    for k in range(min(size, len(hashed))):
        total = total * _STEP + hashed[k : k + n]
    total = np.sort(mix64(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def each_shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """`shingles` of every text of a column; a word is hashed once for all of them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string()).fill_null("")))
    words, ends = split.flatten(), split.offsets.to_numpy()
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashed = mix64(np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct)))
    codes = coded.indices.to_numpy()
    empty = distinct.index(b"") if b"" in distinct else -1  # white space at the ends of a text leaves an empty word there
    for a, b in zip((ends - ends[0]).tolist(), (ends[1:] - ends[0]).tolist()):
        while a < b and codes[a] == empty:
            a += 1
        while a < b and codes[b - 1] == empty:
            b -= 1
        yield _of_hashes(hashed[codes[a:b]], size) if a < b else np.empty(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    """So many first shingles of a set, of which a similar set has at least one among its own first."""
    return n - (percent * n + 99) // 100 + 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Tree:
    """A packed R-tree over count vectors: leaves of points near in size, each node with the greatest coordinates below it.

    `labels` are the components known so far. Those that fill a leaf get leaves of their own, so that nodes inside one
    component can be passed over whole.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, labels: np.ndarray):
        _, own, times = np.unique(labels, return_inverse=True, return_counts=True)
        crowd = np.where(times[own] >= LEAF, own + 1, 0)
        self.order = np.lexsort((points.argmax(axis=1), sizes, crowd))
        self.sizes, self.labels = sizes[self.order].astype(np.int64), own[self.order]
        self.points = points[self.order].astype(np.uint8 if points.max(initial=0) < 256 else np.int32)
        self.levels = [(None, self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][1]) > LEAF:
            _, tops, low, high = self.levels[-1]
            cuts = np.arange(0, len(tops), LEAF)
            self.levels.append((np.append(cuts, len(tops)), np.maximum.reduceat(tops, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def merge(self, a: int, b: int) -> None:
        """The points at places a and b belong together from now on."""
        self.labels[self.labels == self.labels[b]] = self.labels[a]

    def possible(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each place its later places of other components that sizes and summed coordinate minima leave possible.

        Components are read as each place is reached, so merges in between save the comparisons that follow.
        """
        n = len(self.sizes)
        for start in range(0, n, LEAF):
            stop = min(n, start + LEAF)
            at = self._near(start, stop, percent)
            for place in range(start, stop):
                later = at[(at > place) & (self.labels[at] != self.labels[place])]
                later = later[self._bound(self.points[place], self.sizes[place], self.sizes[place], self.points[later], self.sizes[later], self.sizes[later], percent)]
                if len(later):
                    yield place, later

    def _near(self, start: int, stop: int, percent: int) -> np.ndarray:
        """Places from `start` on that the leaf's greatest coordinates leave possible, without nodes of its only component."""
        top, low, high = self.points[start:stop].max(axis=0), self.sizes[start:stop].min(), self.sizes[start:stop].max()
        only = self.labels[start] if (self.labels[start:stop] == self.labels[start]).all() else None
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            cuts, tops, lows, highs = self.levels[depth]
            at = at[self._bound(top, low, high, tops[at], lows[at], highs[at], percent)]
            width = LEAF**depth
            at = at[(at + 1) * width > start]
            if only is not None and len(at):
                other = np.concatenate([[0], np.cumsum(self.labels != only)])
                at = at[other[np.minimum((at + 1) * width, len(self.labels))] > other[at * width]]
            if depth:
                n = cuts[at + 1] - cuts[at]
                at = np.repeat(cuts[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return at

    @staticmethod
    def _bound(top, low, high, tops, lows, highs, percent) -> np.ndarray:
        keep = (100 * highs >= percent * low) & (100 * high >= percent * lows)
        at = np.flatnonzero(keep)
        overlap = np.minimum(tops[at], top).sum(axis=1, dtype=np.int64)
        keep[at] = (100 + percent) * overlap >= percent * (low + lows[at])
        return keep


def tree_links(sets: list[np.ndarray], labels: np.ndarray, parts: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the components `labels` of these sets, as pairs of their places.

    With `parts` (0 or 1) only pairs across the two parts are compared. The exact overlap of one set with all that the
    tree leaves possible is counted by marking its shingles.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    ends = np.cumsum(sizes)
    point = np.repeat(np.arange(len(sets)) * GROUPS, sizes) + (flat % np.uint64(GROUPS)).astype(np.int64)
    tree = Tree(sizes, np.bincount(point, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS), labels)
    values, flat = np.unique(flat, return_inverse=True)
    marks, links = np.zeros(len(values), np.int8), []
    for place, later in tree.possible(percent):
        a, others = tree.order[place], tree.order[later]
        if parts is not None:
            across = parts[others] != parts[a]
            later, others = later[across], others[across]
        own = flat[ends[a] - sizes[a] : ends[a]]
        marks[own] = 1
        for i in range(0, len(others), 1000):
            some = others[i : i + 1000]
            both = np.add.reduceat(marks[gathered(flat, ends[some] - sizes[some], sizes[some])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for hit in np.flatnonzero(100 * both >= percent * (sizes[a] + sizes[some] - both)):
                if tree.labels[later[i + hit]] != tree.labels[place]:
                    links.append((int(a), int(some[hit])))
                    tree.merge(place, later[i + hit])
        marks[own] = 0
    return links


def _frequent(docs: DataFrame, size: int) -> dict[int, int]:
    """The most frequent shingles: shingles that recur within a task's rows, added up. Its bound is `FREQUENT`."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 2
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(times[often])], ["shingle", "n"])

        for batch in batches:
            for own in each_shingles(batch.column(0), size):
                held.append(own)
                n += len(own)
            if n > 4_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counted = docs.mapInArrow(local, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") > 10).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    return {r["shingle"]: r["n"] for r in top.toLocalIterator()}


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Every row with its class (hash of its set), set size, first shingles, two least hashes and count vector."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    often = _frequent(rows.select("text"), size)
    values = np.sort(np.fromiter(often, np.int64, len(often)).view(np.uint64)) if often else np.empty(0, np.uint64)
    times = np.array([often[int(v)] for v in values.view(np.int64)], np.int64)
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField("row", T.LongType()), T.StructField("class", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("first", longs), T.StructField("least", longs), T.StructField("counts", ints),
    ])
    arrow = arrow_schema(schema)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            classes, sizes, first, least, counts = [], [], [], [], []
            for own in each_shingles(batch.column("text"), size):
                sizes.append(len(own))
                if not len(own):
                    for x in (classes, first, least, counts):
                        x.append(None)
                    continue
                classes.append(int(np.frombuffer(xxhash.xxh64_digest(own.tobytes()), "<i8")[0]))
                at = np.searchsorted(values, own)
                seen = np.zeros(len(own), np.int64)
                hit = at < len(values)
                hit[hit] = values[at[hit]] == own[hit]
                seen[hit] = times[at[hit]]
                first.append(own[np.argsort(seen, kind="stable")][: prefix_size(len(own), percent)].view(np.int64))
                least.append([int(own[:1].view(np.int64)[0]), int(mix64(own * _SECOND).min().view(np.int64))])
                counts.append(np.bincount((own % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("text"), batch.column("id"), pa.array(np.arange(row, row + batch.num_rows), pa.int64()), pa.array(classes, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())),
            ], names=schema.names).cast(arrow)
            row += batch.num_rows

    return rows.mapInArrow(sketch, schema)


def _bound(a: Column, b: Column) -> Column:
    """Summed coordinate minima of two count vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _passes(n_a: Column, n_b: Column, percent: int) -> Column:
    return (100 * n_b >= percent * n_a) & (100 * n_a >= percent * n_b)


def _texts(ends: DataFrame, reps: DataFrame, sketches: DataFrame) -> DataFrame:
    """(class, text) of one row of each class in `ends`; a filter of fixed size keeps most other texts from being moved."""
    wanted = store(ends.join(reps.select("class", "row"), "class"))
    bit = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    bits = wanted.df.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    filled = np.zeros(FILTER_BITS + 65536, bool)
    for r in bits.toLocalIterator():
        own = np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little")
        base = (r["part"] - 1) * 32768
        filled[base : base + len(own)] = own
    filled = np.packbits(filled)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((filled[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    near = sketches.select("row", "text", bit.alias("bit"))
    near = near.mapInArrow(within, near.schema).drop("bit")
    return store(near.join(wanted.df, "row").select("class", "text")).df


def verified(pairs: DataFrame, reps: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, by the texts of one row of each class."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), reps, sketches)
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(each_shingles(batch.column("text_a"), size), each_shingles(batch.column("text_b"), size))
            kept = [similar(x, y, percent) for x, y in both]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: the least node that it reaches, by alternating large and small stars.

    Each step is written to the shared folder; a hub's links are rows of a join, never one list.
    """
    ordered = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = store(ordered(links)).df, None
    while True:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(ordered(large)).df
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = store(ordered(small)).df
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _shared_firsts(sketches: DataFrame, buckets: int) -> DataFrame:
    """(shingle, class) for every first shingle that two classes or more have; packed by hash on the way."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("first")
            values = listed.flatten().to_numpy().view(np.uint64)
            lengths = np.diff(listed.offsets.to_numpy())
            owners = np.repeat(batch.column("class").fill_null(0).to_numpy(), lengths)
            if len(values):
                rows = [(b, packed(values[at].tobytes(), 1), packed(owners[at].tobytes(), 1)) for b, at in by_bucket(values, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "shingles", "owners"])

    def share(group: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(unpacked(x), np.uint64) for x in group["shingles"].to_pylist()])
        owners = np.concatenate([np.frombuffer(unpacked(x), np.int64) for x in group["owners"].to_pylist()])
        order = np.lexsort((owners, values))
        values, owners = values[order], owners[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        values, owners = values[new], owners[new]
        start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        several = np.repeat(np.diff(np.append(start, len(values))) > 1, np.diff(np.append(start, len(values))))
        return pa.table({"shingle": pa.array(values[several].view(np.int64)), "class": pa.array(owners[several])})

    sent = sketches.where("n > 0").select("class", "first").mapInArrow(send, "bucket int, shingles binary, owners binary")
    return sent.groupBy("bucket").applyInArrow(share, "shingle bigint, class bigint")


def _each_tree(rows: DataFrame, payload: DataFrame, load: Column, found: Callable[..., tuple[list, list]], names: tuple[str, str]) -> DataFrame:
    """`found` on the rows of every tree, as distinct pairs of longs named `names`.

    `rows`: (lead, class, n, root). The classes of a lead are dealt to parts of bounded rows and bytes (`load`), and there
    is one tree for each pair of parts, so that none grows with its group. `payload` brings the last column by class.
    `found` takes the lead, classes, roots, parts of a tree of two parts (else None) and payloads. Trees of one component
    are passed over.
    """
    sizes = rows.groupBy("lead").agg(load.cast("int").alias("t")).where("t > 1")
    parts = rows.join(sizes, "lead", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    own = parts.withColumn("own", F.pmod(F.xxhash64("class"), F.col("t")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    keys = ["lead", "i", "j"]
    keyed = own.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "root").join(payload, "class")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: group[name].to_numpy()
            if len(np.unique(column("root"))) < 2:
                return
            across = None if held[0]["i"][0] == held[0]["j"][0] else column("own") != column("i")
            pairs = found(group["lead"][0].as_py(), column("class"), column("root"), across, group.column(group.num_columns - 1).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], list(names))

        for batch in batches:
            if not batch.num_rows:
                continue
            turns = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (batch.column(k).to_numpy() for k in keys)], axis=0)) + 1
            cuts = [0, *turns.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and any(held[-1][k][0] != batch[k][a] for k in keys):
                    yield from finish()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish()

    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, f"{names[0]} bigint, {names[1]} bigint").distinct()


def _tree_links(rows: DataFrame, points: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components that meet under one lead; a spanning forest for each tree.

    First the trees over the count vectors name the classes that have a possible partner under their lead, a row each and
    no pairs. Only their texts are moved (`texts` of a table of classes), and the trees over these verify and link.
    """
    n_rows = F.ceil(F.count(F.lit(1)) / TREE)

    def hopeful(lead: int, classes: np.ndarray, roots: np.ndarray, parts: np.ndarray | None, counts: pa.Array) -> tuple[list, list]:
        vectors = counts.flatten().to_numpy().reshape(len(classes), -1)
        tree, named = Tree(vectors.sum(axis=1), vectors, roots), np.zeros(len(classes), bool)
        for place, later in tree.possible(percent):
            a, others = tree.order[place], tree.order[later]
            others = others if parts is None else others[parts[others] != parts[a]]
            named[others] = True
            named[a] |= len(others) > 0
        own = classes[named]
        return [lead] * len(own), own

    def linked(lead: int, classes: np.ndarray, roots: np.ndarray, parts: np.ndarray | None, own: pa.Array) -> tuple[list, list]:
        links = tree_links(list(each_shingles(own, size)), roots, parts, percent)
        return [min(classes[a], classes[b]) for a, b in links], [max(classes[a], classes[b]) for a, b in links]

    left = _each_tree(rows, points.select("class", "counts"), n_rows, hopeful, ("lead", "class"))
    left = store(left.join(rows, ["lead", "class"])).df
    load = F.greatest(n_rows, F.ceil(F.sum(F.col("n") * 8) / TREE_BYTES))
    return _each_tree(left, texts(left.select("class").distinct()), load, linked, ("a", "b"))


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of every row, a row of each class with the least id, and the (node, root) of classes with links; all written."""
    batches_of(docs.sparkSession)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total_bytes(docs, text_col)[1] // BUCKET_BYTES + 1)
    sketches = store(_sketches(docs, id_col, text_col, size, percent)).df
    filled = sketches.where("n > 0")
    reps = store(filled.groupBy("class").agg(F.min("row").alias("row"), F.min("id").alias("id"))).df
    points = store(filled.select("row", "n", "least", "counts").join(reps.select("row", "class"), "row").drop("row")).df

    keyed = store(points.select("class", "n", F.posexplode("least").alias("which", "key"))).df

    def stars(placed: DataFrame, order: Column) -> DataFrame:
        """Pairs of the head of each least hash with the classes of other components, as far as their sizes allow."""
        heads = placed.groupBy("which", "key").agg(F.min_by(F.struct("class", "n", "root"), order).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
        met = placed.join(heads, ["which", "key"]).where((F.col("root") != F.col("head.root")) & _passes(F.col("n"), F.col("head.n"), percent))
        return met.select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b")).distinct()

    def possible(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        """The pairs that the bound leaves possible; vectors are moved only here, not with every least hash."""
        end = lambda name: vectors.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("counts").alias(f"counts_{name}"))
        bound = (100 + percent) * _bound(F.col("counts_a"), F.col("counts_b")) >= percent * (F.col("n_a") + F.col("n_b"))
        return pairs.join(end("a"), "a").join(end("b"), "b").where(bound).select("a", "b")

    pairs = store(possible(stars(keyed.withColumn("root", F.col("class")), F.col("class")), points)).df
    links = store(verified(pairs, reps, sketches, size, percent)).df
    roots = components(links)
    # The turns look at the crowded least hashes and the vectors of their classes alone.
    crowds = keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= CROWD).drop("m")
    crowded = store(keyed.join(crowds, ["which", "key"])).df
    vectors = store(points.select("class", "n", "counts").join(crowded.select("class").distinct(), "class", "left_semi")).df
    for turn in range(TURNS):
        placed = crowded.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        new = stars(placed, F.xxhash64(F.lit(turn), "class")).join(pairs, ["a", "b"], "left_anti")
        more = store(possible(new, vectors)).df
        if more.isEmpty():
            break
        pairs = pairs.unionByName(more)
        links = store(links.unionByName(verified(more, reps, sketches, size, percent))).df
        roots = components(links)

    shared = store(_shared_firsts(sketches, buckets).join(roots.withColumnRenamed("node", "class"), "class", "left")
                   .withColumn("root", F.coalesce("root", "class"))).df
    mark = F.xxhash64("class")
    members = shared.groupBy("shingle").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("class").alias("lead"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(mark).alias("xor"), F.sum(mark.cast("decimal(38,0)")).alias("sum"),
    )
    # Shingles with the same classes would repeat the same comparisons; one of them is enough. The shingles of a group of
    # near copies mostly have the same least class, which stands for them all: each vector is moved once for such a lead.
    mixed = members.where("low <> high").groupBy("m", "xor", "sum").agg(F.min_by(F.struct("shingle", "lead"), "shingle").alias("own")).select("own.*")
    met = shared.join(mixed, "shingle").select("lead", "class", "root").distinct()
    rows = store(met.join(points.select("class", "n"), "class")).df
    found = _tree_links(rows, points, lambda ends: _texts(ends, reps, sketches), size, percent)
    links = store(links.unionByName(found)).df
    roots = components(links)
    return sketches, reps, roots


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles and component_id, the least id that links reach, its own included.

    Words stand between ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has one shingle, a null or
    empty text has none and is linked with nothing (its component is its own id). Two sets link when their Jaccard
    similarity is `percent` hundredths or more. Equal sets are one class, told by 64-bit hashes; links between classes are
    verified on their shingles. Null ids belong to the component of their class but never name it unless all ids are null.
    Repeated rows and ids are kept; an empty table gives no rows.
    """
    sketches, reps, roots = _linked(docs, id_col, text_col, size, percent)
    named = reps.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")).select("class", "root", "id")
    least_id = named.groupBy("root").agg(F.min("id").alias("component"))
    known = named.join(least_id, "root").select("class", "component")
    return sketches.select("id", "class", "n").join(known, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )
