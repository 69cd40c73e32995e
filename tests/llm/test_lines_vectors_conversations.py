"""Line dedup, whitening and conversation repair against plain Python versions."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankaudit.llm import conversation_repair, feast_whitening, line_bitmaps

from . import brute
from .conftest import got


def expected(rows):
    return sorted(rows, key=repr)


# ---- line dedup ----------------------------------------------------------------------


def lines(rng, n):
    shared = [f"  Shared line number {i} éé " for i in range(6)] + ["\tSHARED LINE NUMBER 0 éé", "short", "", "exactly 19 code pts.", "exactly 19 code pés"]
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    return "\n".join(rng.choice(shared) if rng.random() < 0.6 else own() for _ in range(n))


def line_rows():
    rng = random.Random(11)
    rows = [(i, lines(rng, rng.randint(0, 12))) for i in range(60)]
    hot = "the one line that every document of the table holds"
    rows = [(k, f"{t}\n{hot}" if k % 3 else t) for k, t in rows]
    rows += [(None, hot), (None, None), (None, hot + "\r"), (70, ""), (71, None), (72, "\n\n"), (73, hot), (73, hot), (73, f"other\n{hot}\n{hot}")]
    rows += [(74, "a line of two documents only, one"), (75, "a line of two documents only, one")]
    rows += [(80, "\n".join(f"line {i % 700} of a very long document {hot}" for i in range(30_000)))]
    rows += [(81, f"line 5 of a very long document {hot}"), (-1, f"line 5 of a very long document {hot}")]
    return rows


@pytest.mark.parametrize("partitions", ["4", "37"])
def test_line_bitmaps(spark, partitions):
    rows = line_rows()
    full = [(k, t, "e", "s", 1, "clash", 7, 8, 9, 0, 1, "keep") for k, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, _id string, chunk int, high int, low int, at int, id int, keep string"
    df = spark.createDataFrame(full, schema).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_bitmaps.keep_bitmaps(df, with_text=True).withColumn("kept_sha256", F.sha2("kept_text", 256)).cache()
        assert found.columns == ["doc_id", "n_lines", "n_dropped", "keep", "kept_text", "kept_sha256"]
        assert got(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected(brute.shared_lines(rows))
        for r in found.collect():
            mask = line_bitmaps.unpacked_bitmap(bytes(r.keep), r.n_lines)
            assert len(mask) == r.n_lines and int((~mask).sum()) == r.n_dropped
        found.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_line_bitmaps_of_other_bounds_ids_and_nothing(spark, empty, small):
    rows = [(f"d{i}", f"some line\nline {i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, "name string, body string")
    found = line_bitmaps.keep_bitmaps(df, "name", "body", min_chars=5, min_documents=2, with_text=True).withColumn("h", F.sha2("kept_text", 256))
    assert got(found, "name", "n_lines", "n_dropped", "h") == expected(brute.shared_lines(rows, 5, 2))
    assert line_bitmaps.keep_bitmaps(empty).count() == 0
    assert got(line_bitmaps.keep_bitmaps(small[0]), "doc_id", "n_lines", "n_dropped") == expected(x[:3] for x in brute.shared_lines(small[1]))
    with pytest.raises(ValueError):
        line_bitmaps.keep_bitmaps(df, "name", "body", min_documents=1)


def test_a_key_over_many_partitions_is_decided_from_its_edges():
    """Every cut of a sorted table into partitions gives the same lines."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from rankaudit.llm.common import arrow_schema

    runs = [(1, d) for d in (9, 8, 8, 7, 5, 5)] + [(2, 4), (2, 3)] + [(3, d) for d in (6, 6, 6, 2)] + [(4, 1), (4, None), (4, None)]
    want = {i for i, (k, d) in enumerate(runs) if len({x for y, x in runs if y == k}) > 2 and d != max((x for y, x in runs if y == k), key=lambda x: (x is not None, x or 0))}
    schema = T.StructType().add("high", "long").add("low", "long").add("id", "long").add("chunk", "long").add("lines", T.ArrayType(T.LongType())).add("open", "boolean").add("documents", T.ArrayType(T.LongType()))
    arrow = arrow_schema(schema)

    def batch(part):
        return pa.RecordBatch.from_pylist([{"high": runs[i][0], "low": 0, "id": runs[i][1], "chunk": i, "lines": [i]} for i in part], schema=pa.schema(list(arrow)[:5]))

    for cuts in [c for n in range(4) for c in itertools.combinations(range(1, len(runs)), n)]:
        parts = [range(a, b) for a, b in zip((0, *cuts), (*cuts, len(runs)))]
        gone, still, edges = set(), [], {}
        for part in parts:
            half = len(part) // 2
            batches = [batch(part[:half]), batch(part[half:])]
            for out in line_bitmaps._decided(iter(batches), 3, arrow):
                for r in out.to_pylist():
                    if r["documents"] is not None:
                        edges.setdefault(r["high"], []).extend(r["documents"])
                    elif r["open"]:
                        still.append(r)
                    else:
                        gone.add(r["chunk"])
        for r in still:
            ids = edges[r["high"]]
            if len(set(ids)) > 2 and r["id"] != max(ids, key=lambda x: (x is not None, x or 0)):
                gone.add(r["chunk"])
        assert gone == want, cuts


# ---- whitening -----------------------------------------------------------------------


def vector_rows():
    rng = np.random.default_rng(4)
    mixing = rng.standard_normal((12, 12))
    rows = [(i, [float(c) for c in (rng.standard_normal(12) @ mixing).astype(np.float32)]) for i in range(200)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (300, None), (301, [float("nan")] * 12), (302, [1.0] * 11 + [float("inf")]), (303, [1.0] * 11 + [None])]
    rows += [(304, [-float("inf")] + [0.0] * 11), (305, [0.0] * 12)]
    return rows


def test_whitening(spark):
    rows = vector_rows()
    full = [(k, v, 1, 2, "n", 3.0) for k, v in rows]
    df = spark.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, x int, id string, whitened double").repartition(7)
    found = feast_whitening.whiten(df).toPandas()
    ids, n, deviation, explained, whitened = brute.whitened(rows)
    assert sorted(map(str, found["vec_id"].astype("Int64"))) == sorted(str(k) if k is not None else "<NA>" for k in ids for _ in range(8))
    assert set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9
    for c in range(8):
        own = found[found["component"] == c + 1]
        assert np.allclose(own["explained"], explained[c], rtol=1e-9)
        key = lambda pairs: sorted(pairs, key=lambda p: (p[0], abs(p[1])))
        have = key((int(d), w) for d, w in zip(own["deviation"], own["whitened"]))
        want = key(zip(deviation, whitened[:, c]))
        assert [x for x, _ in have] == [x for x, _ in want]
        a, b = np.array([x for _, x in have]), np.array([x for _, x in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_few_equal_ragged_and_huge_vectors(spark, empty):
    schema = "vec_id bigint, embedding array<double>"
    whiten = lambda rows: feast_whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert whiten([]) == [] and whiten([(1, None)]) == [] and whiten([(1, [])]) == []
    assert whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = whiten([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0])])
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whiten([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e12, 5.0])])
    assert {r["component"] for r in huge} <= {1, 2} and all(np.isfinite(r["whitened"]) for r in huge)


def test_exact_sums_do_not_depend_on_the_rows_order(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(9) * 1e6).tolist()) for i in range(400)]
    schema = "vec_id bigint, embedding array<double>"
    parts = [feast_whitening.statistics(feast_whitening.fit_list(spark.createDataFrame(r, schema).repartition(p)), 9) for r, p in ((rows, 1), (rows[::-1], 11))]
    assert parts[0].sums == parts[1].sums and (parts[0].covariance == parts[1].covariance).all() and parts[0].trace == parts[1].trace


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "low rank", "graded"])
def test_components_are_those_of_a_full_solution(kind):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    spectrum = {
        "random": np.sort(rng.random(40))[::-1] * 100, "clustered": np.r_[[7.0] * 3, 7 - 1e-9, [3.0] * 20, np.full(16, 0.5)], "equal": np.full(40, 2.0),
        "low rank": np.r_[[5.0, 4.0, 1.0], np.zeros(37)], "graded": 10.0 ** -np.arange(40),
    }[kind]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = feast_whitening.leading_components(v, 8)
    full = np.linalg.eigh(v)[0][::-1]
    assert len(values) == min(8, int((full > feast_whitening.rounding(v)).sum()))
    assert np.abs(values - full[: len(values)]).max() < 1e-12 * full[0]
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * full[0] and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    for s in (full[0] * 2, full.mean() * 1.01, full[5] * 0.999 + full[6] * 0.001, -1.0):
        assert np.abs(full - s).min() < 1e-12 * full[0] or feast_whitening.count_above(v, s) == int((full > s).sum())
    found = feast_whitening.intervals(v, 8)
    assert sum(c for *_, c in found) >= len(values) and all(int(((full > a) & (full < b)).sum()) == c for a, b, c in found)


# ---- conversations -------------------------------------------------------------------


def conversation_rows():
    rng = random.Random(6)
    texts = ["Well.", "Well. ", "cut", "  ", "", None, "Why?", "a\nb!", "No. more"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
    rows = []
    for conv in range(120):
        turns = [rng.choice([None, *range(8)]) if rng.random() < 0.2 else t for t in range(rng.randint(1, 5))]
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    rows += [(None, t, "user", "Null id.") for t in (None, 0, 1)] + [(500, 10**12, "user", "Far."), (500, -5, "assistant", "Near.")]
    rows += [(conv, 0, "user", "Alone.") for conv in range(600, 640)]
    return rows


def test_conversation_repair(spark):
    rows = conversation_rows()
    full = [(*r, "x", 1, 2, 3) for r in rows]
    df = spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, plan string, copies int, conv int, digest int").repartition(6)
    harmed = conversation_repair.damaged(df)
    plans = conversation_repair.plan_repairs(harmed)
    columns = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    want = brute.repairs(rows)
    assert got(conversation_repair.with_digests(harmed, plans), *columns) == want
    assert any(w[6] == 0 and w[7] == "" for w in want) and len({w[0] for w in want}) == len(want)
    by_conv = {}
    for r in conversation_repair.repaired_messages(harmed, plans).collect():
        by_conv.setdefault(r["conv"], {})[r["place"]] = r
    for conv, *_, audit, digest in want:
        own = [by_conv.get(conv, {})[i] for i in range(len(by_conv.get(conv, {})))]
        assert brute.sha("\n".join(f"{r['role']}:{r['text']}" for r in own)) == digest and [r["edit"] for r in own] == [x for x in audit if x != "D"]


def test_conversations_without_damage_or_rows(spark, empty):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Hello."), (3, 0, None, None)]
    found = conversation_repair.plan_repairs(conversation_repair.messages(spark.createDataFrame(rows, schema)))
    assert got(found, "conv", "blank", "cost", "audit") == [(1, 0, 0, "KK"), (2, 0, 3, "IK"), (3, 1, 4, "D")]
    none = conversation_repair.damaged(spark.createDataFrame([], schema))
    assert conversation_repair.with_digests(none, conversation_repair.plan_repairs(none)).count() == 0


def table_of(codes):
    """Least cost and audit by a table over rows and roles, for codes as the search takes them."""
    best = {conversation_repair.NONE: (0, "")}

    def insert(own):
        own = dict(own)
        for _ in range(2):
            for q, (c, a) in list(own.items()):
                then = conversation_repair.AFTER[q]
                own[then] = min(own.get(then, (1 << 60, "")), (c + 3, a + "I"))
        return own

    for code in codes:
        new = {}
        for q, (c, a) in insert(best).items():
            for letter, more, then in conversation_repair.EDITS[code][q]:
                new[then] = min(new.get(then, (1 << 60, "")), (c + more, a + letter))
        best = new
    return min(v for q, v in insert(best).items() if q in (conversation_repair.NONE, conversation_repair.ASSISTANT))


def test_search_and_blocks_agree_with_a_table():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 30, 60] * 12:
        codes = bytes(rng.randrange(12) for _ in range(n))
        want = table_of(codes)
        assert conversation_repair.best_edits(codes) == want, codes
        for block in (1, 3, 8):
            blocks = conversation_repair.Blocks(block)
            for code in codes:
                blocks.add(code)
            assert blocks.end() == want, (codes, block)


@pytest.mark.parametrize("kind", ["users", "systems", "mixed", "repeats"])
def test_long_conversations_take_linear_time(kind):
    rng = random.Random(2)
    codes = {"users": [3] * 20_000, "systems": [0] * 20_000, "mixed": [rng.randrange(12) for _ in range(20_000)], "repeats": [5] * 20_000}[kind]
    start, blocks = time.time(), conversation_repair.Blocks()
    for code in codes:
        blocks.add(code)
    cost, audit = blocks.end()
    assert time.time() - start < 20 and len(audit) >= len(codes) and (cost, audit) == table_of(codes)
