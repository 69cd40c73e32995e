"""The operators against plain Python versions, on small and empty tables."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankaudit.llm import (
    chunks, content_sort, external_shuffle, jaccard_join, lattice_model, piece_lattice, positional_index, rank_profiles, substrings,
    token_files, toxicity,
)

from . import brute
from .conftest import got, passages

tokenizers = pytest.importorskip("public_tokenizers")


def expected(rows):
    return sorted(rows, key=repr)


# ---- exact dedup ---------------------------------------------------------------------


def test_content_sort(small):
    df, rows = small
    found = got(content_sort.exact_groups(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == expected(brute.exact(rows))


def test_content_sort_over_many_partitions(spark):
    rows = [(i, "same text" if i % 3 else f"other {i}") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(content_sort.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        kept = content_sort.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x[0] for x in brute.exact(rows) if x[3])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == expected(brute.exact(rows))


def test_without_copies_keeps_columns_and_one_row_each(small):
    df, rows = small
    kept = content_sort.without_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(x[3] for x in brute.exact(rows))


def plans_of(monkeypatch, module):
    """The plans of what `module` writes, as they are written."""
    plans, whole = [], module.store
    monkeypatch.setattr(module, "store", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan()), whole(df))[1])
    return plans


def test_without_copies_moves_a_text_once(small, monkeypatch):
    """The rows that are dealt hold the text, and not its normalised form beside it."""
    df, _ = small
    plans = plans_of(monkeypatch, content_sort)
    content_sort.without_copies(df)
    plan = plans[0]
    while plan.nodeName() != "RepartitionByExpression":
        plan = plan.children().head()
    assert "_c_text#" in plan.output().toString() and "_norm#" not in plan.output().toString()


# ---- sharding -----------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 2000])
def test_external_shuffle(small, bucket_bytes):
    df, rows = small
    mixed = external_shuffle.shuffled_buckets(df, bucket_bytes=bucket_bytes)
    placed = external_shuffle.shards(mixed, 16).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(((r.doc_id, r.text) for r in placed), key=repr) == sorted(rows, key=repr)
    sizes = {}
    for r in placed:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1


def test_shuffle_of_one_repeated_id_is_scattered(spark):
    df = spark.createDataFrame([(1, "text" * 50)] * 3000 + [(i, "b") for i in range(2, 50)], "doc_id bigint, text string")
    sizes = [r["count"] for r in external_shuffle.shuffled_buckets(df, bucket_bytes=60_000).groupBy("_bucket").count().collect()]
    assert sum(sizes) == 3048 and max(sizes) < 1500


def test_fisher_yates_is_a_seeded_permutation():
    a = external_shuffle.fisher_yates(1000, 7, 3)
    assert sorted(a) == list(range(1000)) and (a == external_shuffle.fisher_yates(1000, 7, 3)).all()
    assert (a != external_shuffle.fisher_yates(1000, 8, 3)).any() and external_shuffle.fisher_yates(0, 1, 1).size == 0


# ---- token files ---------------------------------------------------------------------


def test_token_files(spark, small):
    from tokenizers import Tokenizer

    df, rows = small
    df = df.where("doc_id is not null and doc_id <> 21")
    path = tokenizers.path("byte_bpe_50k.json")
    read = token_files.read_token_files(token_files.write_token_files(df, path), df.schema["doc_id"].dataType, with_ids=True)
    rows = [r for r in rows if r[0] not in (None, 21)]
    assert got(read, "id", "start", "n_tokens", "ids_crc32") == expected(brute.token_files(rows, Tokenizer.from_file(path)))


def test_frames_are_independent_and_checked(tmp_path):
    import pyarrow as pa
    import pyarrow.fs as pafs

    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 5, 200_000, 1, 70_000)]
    path = str(tmp_path / "file")
    with pafs.LocalFileSystem().open_output_stream(path) as out:
        writer = token_files.FrameWriter(out, 2)
        for ids in documents:
            writer.add(ids)
        writer.close(pa.array(range(5)))
    with pafs.LocalFileSystem().open_input_file(path) as source:
        reader = token_files.FrameReader(source)
        asked = []
        whole = reader._frame
        reader._frame = lambda i: asked.append(i) or whole(i)
        assert (reader.ids(4) == documents[4]).all() and len(set(asked)) < len(reader.table) - 1
        assert all((reader.ids(i) == d).all() for i, d in enumerate(documents))
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pafs.LocalFileSystem().open_input_file(path) as source, pytest.raises(Exception):
        token_files.FrameReader(source).ids(1)


def test_units_encode_like_whole_texts():
    encoder = token_files.encoder_of(tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", "!!", "　", "\xa0", "<|endoftext|>", "日本", "_", "|", "don't", "-", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        own = token_files.units(text.encode(), encoder.special)
        assert encoder.encode(own)[1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


# ---- decontamination -------------------------------------------------------------------


def test_positional_index(spark, small):
    df, rows = small
    _, shared = passages()
    words = shared.split(" ")
    items = [(1, shared), (10, " ".join(words[5:14])), (2, "one"), (3, None), (4, "..."), (5, " ".join(words[30:55]).upper()), (6, "never seen here at all")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 50):
        found = positional_index.find_leaks(df, table, block_bytes=block)
        found = found.select("doc_id", "n_words", "n_hit", F.size("item_ids").alias("n"), F.sha2(F.array_join("item_ids", ","), 256).alias("h"), (F.col("n_hit") > 0).alias("c"))
        assert got(found, "*") == expected(brute.leaks(rows, items))


def test_near_matches_allow_moved_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x gamma beta delta"), (3, "alpha beta far away from the word gamma delta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id bigint, text string")
    found = {r.doc_id: r for r in positional_index.find_leaks(docs, items, slop=2).collect()}
    assert {k: sorted(m.kind for m in r.matches) for k, r in found.items()} == {1: ["near", "phrase"], 2: ["near"], 3: []}
    assert {k: r.n_hit for k, r in found.items()} == {1: 4, 2: 0, 3: 0}


def test_near_matches_of_the_registered_query(spark, small, tmp_path):
    from rankaudit.llm.queries import QUERIES

    df, rows = small
    words = passages()[1].split(" ")
    swapped = [*words[:20], words[21], words[20], *words[22:40]]
    moved = [(70, " ".join(["lead", *swapped, "tail"])), (71, " ".join(words[44:50] + ["between"] + words[50:56])), (72, " ".join(words[44:49] + ["a", "b", "c"] + words[49:54]))]
    items = [(1, " ".join(words)), (2, "one"), (3, None), (4, "Words, two"), (5, " ".join(words[44:54]).upper())]
    df.select("doc_id", "text").unionByName(spark.createDataFrame(moved, "doc_id bigint, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = got(QUERIES["near_matches"](spark, str(tmp_path)), "doc_id", "n_words", "n_near", "n_items", "items_sha256", "only_near")
    assert found == expected(brute.near_leaks(rows + moved, items))
    assert {k: only for k, *_, only in found}[71] and {k: n for k, _, n, *_ in found}[72] == 0


# ---- substrings ---------------------------------------------------------------------


@pytest.mark.parametrize("window", [35, 5, 12, 21])
def test_substrings(small, window):
    df, rows = small
    found = substrings.remove_repeats(df, window=window)
    found = found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))
    assert got(found, "*") == expected(brute.substrings(rows, window))


def test_covers_hold_every_difference():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substrings_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 500)
    monkeypatch.setattr(chunks.write_chunks, "__defaults__", (500,))
    rows, _ = passages()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))
    assert got(found, "*") == expected(brute.substrings(rows))


# ---- Jaccard join -------------------------------------------------------------------


def test_jaccard_join(small):
    df, rows = small
    assert got(jaccard_join.near_groups(df), "doc_id", "n_shingles", "component_id") == expected(brute.components(rows))


def test_turns_of_early_links_do_not_list_least_hashes_again(spark, monkeypatch):
    """The least hashes are listed and written once, however many turns follow, and without the vectors."""
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(80)], []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(words)))
    plans = plans_of(monkeypatch, jaccard_join)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(jaccard_join.near_groups(df), "doc_id", "n_shingles", "component_id") == expected(brute.components(rows))
    assert sum("posexplode(least" in p.toString() for p in plans) == 1


@pytest.mark.parametrize("percent", [60, 85])
def test_jaccard_join_without_early_links(spark, monkeypatch, percent):
    """Only the trees may find links here; small trees force several parts per partition."""
    monkeypatch.setattr(jaccard_join, "TREE", 3)
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijkl") + rng.choice("mnop") for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(60):
        words = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(words)))
    whole, calls = jaccard_join.verified, []

    def second_only(pairs, *rest):
        calls.append(1)
        return whole(pairs.where("false") if len(calls) == 1 else pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verified", second_only)
    monkeypatch.setattr(jaccard_join, "_passes", lambda a, b, p: F.lit(False))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = got(jaccard_join.near_groups(df, percent=percent), "doc_id", "n_shingles", "component_id")
    assert found == expected(brute.components(rows, percent)) and len({x[2] for x in found}) < 60


@pytest.mark.parametrize("size", [1, 4])
def test_shingles_of_a_column_are_those_of_its_texts(size):
    import pyarrow as pa

    rng = random.Random(8)
    letters = ["a", "B", "\u00c9", "\u00a0", "\u3000", "\x1c", "\x85", "\x00", *" \t\n\x0b\x0c\r"]
    texts = [None, "", " ", "\n\t ", "one", " one  Two ", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500))]
    column = pa.array(["before"] + texts)[1:]
    plain = [jaccard_join.shingles((t or "").encode(), jaccard_join._WordHashes(), size) for t in texts]
    assert [x.tolist() for x in jaccard_join.each_shingles(column, size)] == [x.tolist() for x in plain]
    assert list(jaccard_join.each_shingles(column[:0], size)) == []
    for x, t in zip(plain, texts):
        assert len(x) == len({tuple(w[i : i + size]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - size + 1)) if w})


def test_tree_finds_all_pairs_that_the_bound_allows():
    rng = np.random.default_rng(4)
    points = rng.poisson(3, (300, 16)).astype(np.int32)
    points[150:] = points[:150]
    sizes = points.sum(axis=1).astype(np.int64)
    tree = jaccard_join.Tree(sizes, points, np.arange(300) // 20 % 9)
    found = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for a, later in tree.possible(85) for b in later}
    for i in range(300):
        for j in range(i + 1, 300):
            bound = np.minimum(points[i], points[j]).sum()
            apart = i // 20 % 9 != j // 20 % 9
            assert ((i, j) in found) == bool(apart and 185 * bound >= 85 * (sizes[i] + sizes[j]))


@pytest.mark.parametrize("parts", [False, True])
def test_tree_links_span_the_components(parts):
    """The same components as all pairs give, from no more links than there are sets."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (12, 80)).astype(np.uint64)
    sets = []
    for i in range(400):
        own = base[i % 12].copy()
        own[rng.choice(80, rng.integers(0, 9), replace=False)] = rng.integers(0, 2**63)
        sets.append(np.unique(own))
    labels = np.where(np.arange(400) % 5 == 0, np.arange(400) % 12, 1000 + np.arange(400))
    sides = np.arange(400) // 12 % 2 if parts else None
    roots = {int(x): int(x) for x in labels}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    found = dict(roots)
    for i in range(400):
        for j in range(i):
            if (sides is None or sides[i] != sides[j]) and jaccard_join.similar(sets[i], sets[j], 85):
                roots[root(int(labels[i]))] = root(int(labels[j]))
    whole = {x: root(x) for x in roots}
    links = jaccard_join.tree_links(sets, labels, sides, 85)
    assert len(links) < len(set(labels.tolist()))
    assert all(jaccard_join.similar(sets[a], sets[b], 85) for a, b in links)
    roots = found
    for a, b in links:
        roots[root(int(labels[a]))] = root(int(labels[b]))
    groups = lambda of: {frozenset(x for x in of if of[x] == r) for r in set(of.values())}
    assert groups({x: root(x) for x in roots}) == groups(whole)


def test_tree_of_near_equal_points_yields_few_links():
    """Thousands of sets that are all alike: links grow with the sets, not with their square."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(4000)]
    assert len(jaccard_join.tree_links(sets, np.arange(4000), None, 85)) == 3999


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (500, 400), (400, 500)]
    found = dict((r.node, r.root) for r in jaccard_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)} | {400: 400, 500: 400}


# ---- language -----------------------------------------------------------------------


def test_rank_profiles(spark, small):
    rng = random.Random(8)
    sound = {"aa": "kalimo sato rina", "bb": "schtrung verkeit zwom", "cc": "éaux çon lée"}
    rows = [(i, " ".join(rng.choice(sound[l].split(" ")) + rng.choice("xyz") for _ in range(20)), l if i < 80 else None) for i, l in ((i, rng.choice("abc") * 2) for i in range(100))]
    rows += [(200, None, "aa"), (201, "12 34 !", "bb"), (202, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in rank_profiles.predict_languages(df, F.lit(True)).collect()}
    assert all(found[i].lang_pred == l for i, _, l in rows if l and i < 80)
    assert [found[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert all(0.0 <= r.score <= 1.0 for r in found.values())


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abc é12.\n日") for _ in range(500))
    whole = rank_profiles.gram_counts(text)
    for piece in (3, 7, 100, 250):
        monkeypatch.setattr(rank_profiles, "PIECE", piece)
        again = rank_profiles.gram_counts(text)
        assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()


# ---- toxicity -----------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(6)
    plain = "river stone light walk morning garden quiet road window paper".split()
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if toxic := i % 5 == 0:
            words[rng.randrange(30)] = rng.choice(["zorkish", "zorkling", "blaggard"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "quiet garden " * 5000), (None, "paper road"), (903, "you ZORKISH!")]
    labels += [(5, 1), (77777, 1), (None, 1), (903, None)]
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = {r.doc_id: r._score for r in toxicity.score(docs, toxicity.fit_model(docs, known, ~held)).collect()}
    assert len(found) == len(rows) and all(0.0 <= s <= 1.0 for s in found.values())
    assert all((found[i] >= 0.3) == (i % 5 == 0) for i in range(400))
    assert max(found[900], found[901], found[902], found[None]) < 0.3 <= found[903]


def test_disguised_words_and_weights_of_words():
    import re
    import time

    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("abÉ\u00b2\u0663_1@$*! .-") for _ in range(rng.randint(0, 30)))
        assert toxicity.disguised(text) == re.findall(r"[^\W\d_]+(?:[0-9@$*!]+[^\W\d_]+)+", text), text
    began = time.process_time()
    assert toxicity.disguised("x" * 200_000 + " a1b") == ["a1b"]  # took minutes when every letter was a start
    assert time.process_time() - began < 5
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    counts = {e: (rng.randint(0, 9), rng.randint(1, 9)) for w in words[:40] for e in toxicity.entries(w)}
    lexicon = toxicity.Lexicon(counts, 12, 30)
    for own in (None, 0, 1):
        plain = [max([0.0, *(lexicon.weigh(*counts[e], own) for e in toxicity.entries(w) if e in counts)]) for w in words]
        assert lexicon.weights(words, own).tolist() == plain
    assert toxicity.Lexicon({"ab": (3, 0)}, 12, 30).weights(["ab", "b"], 1).tolist()[1] == 0.0
    assert toxicity.Lexicon({"ab": (3, 0)}, 12, 30).weights(["b"], 0).tolist() == [0.0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r._score for r in toxicity.score(docs, toxicity.fit_model(docs, none, F.lit(True))).collect()} == {0.0}


# ---- pieces and the language model ---------------------------------------------------


def test_piece_lattice_keeps_one_copy_of_its_words(spark, small, monkeypatch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, written, store = spark.conf.get(key), [], piece_lattice.store
    monkeypatch.setattr(piece_lattice, "store", lambda df: (written.append((df.columns, spark.conf.get(key))), store(df))[1])
    piece_lattice.encode(small[0], tokenizers.path("piece_bpe_32k.model"))
    assert written == [(["chunk", "bucket", "lengths", "ids"], "true")]
    assert spark.conf.get(key) == before


def test_freed_memory_goes_back():
    from rankaudit.llm import common

    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1])

    common.give_back()
    blocks = [bytearray(100_000) for _ in range(2_000)]
    last = bytearray(100_000)
    del blocks
    kept = held()
    common.give_back()
    assert kept - held() > 20_000 and len(last) == 100_000


def test_piece_lattice_equals_the_library(spark, small):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df, rows = small
    encoded = piece_lattice.encode(df, path)
    assert got(encoded, "doc_id", "ids") == expected([(k, model.encode(t or "")) for k, t in rows])
    decoded = piece_lattice.decode(encoded, path)
    assert got(decoded, "doc_id", "text") == expected([(k, t or "") for k, t in rows])


def test_encode_decodes_in_the_same_task(spark, small, monkeypatch):
    path, rows = tokenizers.path("piece_bpe_32k.model"), []
    store = piece_lattice.store
    monkeypatch.setattr(piece_lattice, "store", lambda df: (rows.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))), store(df))[1])
    monkeypatch.setattr(piece_lattice, "PARTS", 3)
    both = piece_lattice.encode(small[0], path, decoded="spelt")
    assert rows[-1] >= 1000  # words come to the cogroups in batches of rows, not of chunks
    tasks = both._jdf.queryExecution().executedPlan().toString()
    assert tasks.count("MapInArrow") == 1
    assert got(both, "doc_id", "ids", "spelt") == got(piece_lattice.decode(piece_lattice.encode(small[0], path), path), "doc_id", "ids", "text")


def test_viterbi_fold_finds_the_best_sum(spark):
    rng = random.Random(9)
    alphabet = "abcd"
    names = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(60)} | set(alphabet))
    pieces = piece_lattice.Pieces({p: i for i, p in enumerate(names)}, {p: -rng.randint(1, 1000) / 64 for p in names}, list(range(1000, 1256)))
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(80)} | {"ab" * 150})

    def best(word):
        into = [0.0] + [None] * len(word)
        for e in range(1, len(word) + 1):
            into[e] = max(into[s] + pieces.scores[word[s:e]] for s in range(max(0, e - 4), e) if word[s:e] in pieces.scores)
        return into[-1]

    table = spark.createDataFrame([(0, w) for w in words], "bucket int, word string")
    for r in piece_lattice.segment(table, pieces).collect():
        parts = [names[i] for i in r.ids]
        assert "".join(parts) == r.word and sum(pieces.scores[p] for p in parts) == pytest.approx(best(r.word))


def test_lattice_sums_all_segmentations():
    vocabulary = lattice_model.Vocabulary(["▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab"], np.log(np.full(8 + 256, 1 / 264)))
    lattice = lattice_model.Lattice(lattice_model.Finder(vocabulary), vocabulary.scores)

    def ways(text):
        if not text:
            return 1.0
        total = sum(ways(text[len(p):]) / 264 for p in vocabulary.pieces if text.startswith(p))
        if text[0] not in vocabulary.pieces:
            total += ways(text[1:]) / 264 ** len(text[0].encode())
        return total

    words = ["a", "ab", "abab", "babaab", "aéb", "日", "", "ab" * 6]
    assert np.exp(lattice.log_probabilities(words)) == pytest.approx([ways("▁" + w) for w in words])
    counts = lattice.expected_counts(["ab"], np.ones(1))
    paths = [(1, 264.0**-1), (2, 264.0**-2), (2, 264.0**-2), (3, 264.0**-3)]  # pieces and probability of every way to write it
    assert counts.sum() == pytest.approx(sum(n * p for n, p in paths) / sum(p for _, p in paths))


def test_language_model(spark, small):
    import math
    from collections import Counter

    df, rows = small
    learn = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))
    found = lattice_model.score_texts(df, learn, tokenizers.path("piece_bpe_32k.model"), rounds=2).collect()
    split = [(k, brute.SPACE_WORD.findall(brute.lower(t or ""))) for k, t in rows]
    train = [w for k, w in split if k is not None and k % 5 != 1]
    counts = Counter(x for w in train for x in [*w, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(k), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), 6)) for k, w in split)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


# ---- empty tables --------------------------------------------------------------------


def test_empty_tables(spark, empty):
    path = tokenizers.path("piece_bpe_32k.model")
    items = spark.createDataFrame([], "item_id bigint, text string")
    results = [
        content_sort.exact_groups(empty), content_sort.without_copies(empty), external_shuffle.shards(external_shuffle.shuffled_buckets(empty), 16),
        token_files.read_token_files(token_files.write_token_files(empty, tokenizers.path("byte_bpe_50k.json")), empty.schema["doc_id"].dataType),
        positional_index.find_leaks(empty, items), substrings.remove_repeats(empty), jaccard_join.near_groups(empty),
        rank_profiles.predict_languages(empty, F.lit(True)), toxicity.score(empty, toxicity.fit_model(empty, items.withColumn("toxic", F.lit(1)).withColumnRenamed("item_id", "doc_id"), F.lit(True))),
        piece_lattice.decode(piece_lattice.encode(empty, path), path), lattice_model.score_texts(empty, F.lit(True), path),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_crowded_near_copies_are_linked_in_turns(spark, monkeypatch):
    """Copies of one text with several changes each: similar to some of the others only."""
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(90)] = f"c{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(jaccard_join.near_groups(df), "doc_id", "n_shingles", "component_id") == expected(brute.components(rows))


@pytest.mark.parametrize("width, fits, wide", [(2, 65535, 65536), (4, 2**32 - 1, 2**32)])
def test_ids_beyond_their_width_are_refused(width, fits, wide):
    writer = token_files.FrameWriter(io.BytesIO(), width)
    writer.add(np.array([0, fits], np.int64))
    for wrong in (wide, -1):
        with pytest.raises(ValueError, match="does not fit"):
            writer.add(np.array([0, wrong], np.int64))
    assert writer.tokens == 2
