from __future__ import annotations

import os
import shutil

import duckdb
from oracle import compare, connect
from pyspark.sql import functions as F

from cohortflow.functions.hashing import NUDGE, canonical_value
from cohortflow.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def with_table(tmp_path, name, sql):
    """The smallest tables with one of them replaced."""
    for f in os.listdir(SF):
        shutil.copy(f"{SF}/{f}", tmp_path / f)
    os.chmod(tmp_path / f"{name}.parquet", 0o644)
    duckdb.connect().execute(f"COPY ({sql.format(t=f'{SF}/{name}.parquet')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_digits_next_to_a_tie(spark):
    ties = [-0.06659995764493942, 0.20467838644981384, 0.09495414793491364, -0.08756910264492035, 123.45678915, 9.9999999995, 1234567890.5, 12345678905.0, 1.00000000005e20, 3.1234567895e-9]
    # Doubles next to the value that the nudge takes to the tie, exact ties and plain values.
    values = [v * k for v in ties for k in (1, 1 / NUDGE, (1 - 2e-16) / NUDGE, (1 + 3e-16) / NUDGE)] + [0.0, 1.0, -2.5, 1e10, 1e9, 999999999.95, 1e-12, 1.7e308]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", canonical_value(F.col("x"), "double").alias("t")).collect()
    texts = ["%.9e" % (r.x * NUDGE if r.x else 0.0) for r in got]
    assert [r.t for r in got] == [f"{len(t)}:{t}" for t in texts]


def test_fingerprints_next_to_a_tie(spark, tmp_path):
    sf = with_table(tmp_path, "supplier", "SELECT * REPLACE (CASE WHEN s_suppkey % 2 = 0 THEN -0.06659995764493942 ELSE 0.20467838644981384 END::DOUBLE AS s_acctbal) FROM '{t}'")
    con = connect(sf)
    for name in ("table_fingerprint", "run_hashes"):
        assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()) == ""


def test_zeros_of_log_like_events(spark, tmp_path):
    sf = with_table(tmp_path, "events", "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS value) FROM '{t}'")
    assert compare(QUERIES["log_like_layer"](spark, sf).toPandas(), connect(sf).execute(SQL["log_like_layer"]).df()) == ""
