"""Run registered queries against their oracles: python -m checks.compare <sf_dir> [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from rankaudit.plans.catalog import QUERIES
from rankaudit.session import drop_scratch, local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, every value as text, rows sorted."""
    def text(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "NULL"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    out = pd.DataFrame({c: df[c].map(text) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(set(spark_df.columns) ^ set(sql_df.columns))}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    for c in spark_df.columns:
        for df in (spark_df, sql_df):
            if df[c].dtype.kind in "iu" and spark_df[c].dtype.kind == "f" or df[c].dtype.kind in "iu" and sql_df[c].dtype.kind == "f":
                df[c] = df[c].astype(float)
    a, b = normal(spark_df), normal(sql_df)
    differ = (a != b)
    if not differ.values.any():
        return "ok"
    columns = [c for c in a.columns if differ[c].any()]
    row = differ.any(axis=1).idxmax()
    return f"{int(differ.any(axis=1).sum())} rows differ in {columns}\n   spark {a.loc[row].to_dict()}\n   sql   {b.loc[row].to_dict()}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            spark_time = time.time() - start
            start = time.time()
            if name not in ORACLE:
                print(f"{name:26s} rows {len(got)} spark {spark_time:.1f}s (no oracle)", flush=True)
                continue
            want = con.sql(ORACLE[name]).df()
            verdict = compare(got, want)
        except Exception as error:  # report and go on
            verdict, spark_time, got = f"ERROR {str(error)[:600]}", 0.0, []
        bad += verdict != "ok"
        print(f"{name:26s} {verdict} ({len(got)} rows, spark {spark_time:.1f}s, sql {time.time() - start:.1f}s)", flush=True)
    drop_scratch(spark)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
