"""Run registered queries in Spark and their SQL twins in DuckDB and compare the values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        return v

    rows = [tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {
        c: (got[c].dtype.kind, want[c].dtype.kind)
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and not {got[c].dtype.kind, want[c].dtype.kind} <= set("iufO")
    }
    if kinds:
        return f"dtypes {kinds}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from cohortflow.session import build_session, clean

    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con, failed = entry.queries(), entry.oracle_sql(), connect(sf_dir), 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            failed += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"rows {name}: {len(got)} rows, spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(sql[name]).df()
            problem = compare(got, want)
        except Exception as exc:  # noqa: BLE001
            problem = f"duckdb {type(exc).__name__}: {str(exc)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got)} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s {problem}", flush=True)
    print("failed:", failed)
    clean(spark)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
