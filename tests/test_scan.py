from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortflow.operators import scan


def frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    # One key holds two thirds of the rows and one value repeats often.
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.67, "hot", rng.choice(list("abc"), n)), "v": np.round(rng.normal(size=n), 2)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 0.0
    return pdf, spark.createDataFrame(pdf)


def test_average_ranks_match_pandas_under_skew(spark):
    pdf, df = frame(spark)
    got = scan.average_ranks(df, ["k"], "v", F.lit(1), "t").toPandas()
    want = pdf.assign(rank=pdf.groupby("k").v.rank()).drop_duplicates(["k", "v"])
    both = got.merge(want, on=["k", "v"], suffixes=("", "_w"))
    assert len(both) == len(want) == len(got)
    assert np.allclose(both["rank"], both["rank_w"])


def test_prefix_scan_splits_a_hot_key(spark):
    pdf = pd.DataFrame({"k": ["hot"] * 500 + ["cold"] * 5, "o": list(range(500)) + list(range(5)), "v": np.arange(505) % 7})
    df = spark.createDataFrame(pdf).withColumn(scan.BUCKET, (F.col("o") / 20).cast("int"))
    out = scan.prefix_scan(df, ["k"], ["o"], sums={"s": F.col("v")}, maxes={"m": F.col("v")}, maxes_before={"b": F.col("o")}).toPandas()
    want = pdf.sort_values(["k", "o"])
    want["s"] = want.groupby("k").v.cumsum()
    want["m"] = want.groupby("k").v.cummax()
    want["b"] = want.groupby("k").o.shift()
    out = out.sort_values(["k", "o"])
    assert (out.s.to_numpy() == want.s.to_numpy()).all()
    assert (out.m.to_numpy() == want.m.to_numpy()).all()
    assert np.array_equal(out.b.to_numpy(dtype=float), want.b.to_numpy(dtype=float), equal_nan=True)


def test_shuffled_position_is_a_permutation(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id")).withColumn("d", F.md5("id"))
    out = scan.shuffled_position(df, ["g"], "d", ["id"]).toPandas().sort_values("position")
    assert out.position.tolist() == list(range(1, 1001))
    assert out.d.tolist() == sorted(out.d.tolist())


def test_exact_quantiles(spark):
    values = np.random.default_rng(3).integers(0, 40, 777).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"time": values}))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert np.allclose(scan.exact_quantiles(df, "time", probs, "q"), np.quantile(values, probs))
