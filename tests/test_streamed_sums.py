"""Moments of rows in pieces, and sums of units without a call for each."""

from __future__ import annotations

import numpy as np
import pytest

from cohortflow.operators import attribution, linear


@pytest.mark.parametrize("most", [linear.SHARED_BYTES, 60])
def test_residuals_need_no_regrouping(spark, monkeypatch, most):
    monkeypatch.setattr(linear, "SHARED_BYTES", most)  # 60 bytes: a block of one row and one of two targets
    rng = np.random.default_rng(4)
    n, names, targets = 12, ["rna:a", "rna:b"], ["P", "Q", "R"]
    x, y, coef = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
    t = [[0, 1, 2], [1], [2, 0]]
    rows = spark.createDataFrame([(f"i{k}", "c", x[k].tolist(), t[k % 3], [float(y[k, j]) for j in t[k % 3]]) for k in range(n)], "instance_id string, condition string, x array<double>, t array<int>, y array<double>")
    coefs = spark.createDataFrame([(k, coef[k].tolist(), 0.5) for k in (0, 1)], "t int, coef array<double>, intercept double")
    told = [(r.instance_id, j, e) for r in linear.residuals(rows, coefs, 3, ["instance_id"]).collect() for j, e in zip(r.t, r.e, strict=True)]
    want = {(f"i{k}", j): x[k] @ coef[j] + 0.5 - y[k, j] for k in range(n) for j in t[k % 3] if j < 2}
    assert len(told) == len(want) and all(e == pytest.approx(want[i, j]) for i, j, e in told)
    heads = [linear.Header(spark.createDataFrame([(v, i) for i, v in enumerate(h)], "name string, at int"), len(h)) for h in (names, targets)]
    got = {(r.source, r.target): r.permutation_delta for r in attribution.permutation_delta(rows, coefs, *heads, 3, 2, 4).collect()}
    pairs = attribution.permuted_partners(rows, 2, 4).collect()
    for s, source in enumerate(names):
        for j, target in enumerate(targets[:2]):
            gaps = [(want[f"i{k}", j], coef[j, s] * (x[int(r.partner_id[1:]), s] - x[k, s])) for r in pairs if ((k := int(r.instance_id[1:])) is not None) and (r.instance_id, j) in want]
            assert got[source, target] == pytest.approx(np.mean([(e + d) ** 2 - e**2 for e, d in gaps]))
    assert len(got) == 4


def test_units_are_summed_as_they_stream_past(spark):
    """A unit over many batches and tasks, single ones, and one without a name, without a Python call for each unit."""
    rng = np.random.default_rng(8)
    names = linear.Header(spark.createDataFrame([("rna:a", 0), ("rna:b", 1)], "name string, at int"), 2)
    base = spark.createDataFrame([("rna:b", 0.25)], "source string, baseline_value double")
    unit = ["hot" if k % 3 else None if k % 5 == 0 else f"U{k}" for k in range(900)]
    x = rng.normal(size=(900, 3))
    rows = spark.createDataFrame(list(zip(unit, x.tolist())), "group_id string, x array<double>").repartition(7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = attribution.unit_gaps(rows, names, 3, base).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(set(unit))
    for r in got:
        mine = x[[k for k in range(900) if unit[k] == r.group_id], :2]
        assert r.n == 3 * len(mine) and np.allclose(np.frombuffer(r.gap), (2 * mine - [0.0, 0.25]).sum(axis=0))
