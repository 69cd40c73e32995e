"""A small table with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, _id string, chunk int, bucket int, row string"


def passages():
    rng = random.Random(5)
    vocabulary = [a + b for a in ("the", "on", "er", "Wh", "an", "st", "é") for b in ("", "ing", "ou", "nd", ".", "ed,")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = text(60), text(120).split(" ")
    rows = [(None, "null id " + text(5)), (0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "one"), (5, "o\nne "), (6, "Two words")]
    rows += [(10 + i, f"{text(20)} {shared} {text(15)}") for i in range(4)]
    rows += [(20, " ".join(base)), (21, " ".join(base)), (21, " ".join(base))]
    for i in range(8):
        changed = list(base)
        changed[(i * 13) % 120] = f"changed{i}"
        if i > 3:
            changed[(i * 7) % 120] = f"again{i}"
        rows.append((30 + i, " ".join(changed)))
    rows += [(40, text(4000)), (41, "loop again " * 80), (42, "日本語 テキスト\tÀÉ ß " + shared), (43, "x" * 5000), (44, "a<|endoftext|>b  c\r\n")]
    rows += [(50 + i, text(30)) for i in range(12)]
    return rows, shared


@pytest.fixture(scope="session")
def small(spark):
    rows, _ = passages()
    full = [(k, t, "en", "s", 1, "clash", 7, 8, "r") for k, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
