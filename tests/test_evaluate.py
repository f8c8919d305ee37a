from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from cohortflow.operators import evaluate, resample


def cells(spark, true, pred, features):
    rows = [
        ("m", f"i{i}", f"u{i}", f, None if true[i][j] is None else float(true[i][j]), float(pred[i][j]))
        for i in range(len(true)) for j, f in enumerate(features)
    ]
    return spark.createDataFrame(rows, "model string, instance_id string, group_id string, feature string, y_true double, y_pred double")


def test_constant_feature_is_undefined(spark):
    df = cells(spark, [[1, 2], [1, 3], [1, 4]], [[0.5, 2.1], [0.4, 2.8], [0.6, 4.2]], ["const", "var"])
    per = {r.feature: r for r in evaluate.per_feature(df, ["model"]).collect()}
    assert per["const"].pcc is None and per["const"].spearman is None and per["const"].n_valid == 3
    assert per["var"].pcc == pytest.approx(0.981981, abs=1e-6) and per["var"].r2 == pytest.approx(0.955)
    s = evaluate.scalars(df, ["model"]).first()
    assert (s.n_pcc, s.n_total, s.n_undefined_pcc) == (1, 2, 1)
    assert s.pcc_macro == pytest.approx(0.981981, abs=1e-6)
    assert [s.mse, s.mae, s.r2_pooled, s.pcc_pooled] == pytest.approx([0.143333, 0.333333, 0.8925, 0.992764], abs=1e-6)


def test_coverage(spark):
    df = cells(spark, [[1, None], [2, 3]], [[1.1, 0], [1.8, 3.2]], ["a", "b"])
    instances, features = df.select("model", "instance_id").distinct(), df.select("feature").distinct()
    c = evaluate.coverage(df, instances, features, ["model"]).first()
    assert (c.n_observed, c.n_possible, c.coverage) == (3, 4, 0.75)
    s = evaluate.grouped_scores(df, ["model"]).first()
    assert [s.mse, s.mae] == pytest.approx([0.03, 0.166667], abs=1e-6)


def test_macro_against_pooled_r2(spark):
    df = cells(spark, [[0, 0], [1, 10], [2, 20], [3, 30]], [[0, 5], [1, 5], [2, 5], [3, 5]], ["a", "b"])
    s = evaluate.scalars(df, ["model"]).first()
    assert [s.r2_macro, s.r2_pooled] == pytest.approx([0.1, -0.035078], abs=1e-6)
    assert s.n_pcc == 1


def test_non_finite_prediction_is_observed_but_not_scored(spark):
    df = cells(spark, [[1], [2], [3]], [[1], [float("nan")], [float("inf")]], ["a"])
    s = evaluate.grouped_scores(df, ["model"]).first()
    assert (s.n_observed, s.n_valid, s.mse, s.pcc) == (3, 1, 0.0, None)
    assert evaluate.non_finite_predictions(df, ["model"]).first().n_non_finite == 2


def spearman_reference(t, p):
    a, b = pd.Series(t).rank(), pd.Series(p).rank()
    return np.corrcoef(a, b)[0, 1]


def test_spearman_paths_agree_with_ties_and_a_hot_value(spark):
    rng = np.random.default_rng(0)
    t = np.where(rng.random(400) < 0.35, 0.0, np.round(rng.normal(size=400), 1))
    p = np.round(t + rng.normal(size=400), 1)
    df = cells(spark, t[:, None], p[:, None], ["f"])
    want = spearman_reference(t, p)
    assert evaluate.spearman(df, ["model"]).first().spearman == pytest.approx(want)
    assert evaluate.spearman_bounded(df, ["model"]).first().spearman == pytest.approx(want)


def test_bootstrap_equals_expanding_the_draws(spark):
    rng = np.random.default_rng(5)
    units = [f"u{i}" for i in range(7)]
    rows = [("m", f"{u}-{k}", u, f, float(rng.normal()), float(rng.normal())) for u in units for k in range(3) for f in "ab"]
    df = spark.createDataFrame(rows, "model string, instance_id string, group_id string, feature string, y_true double, y_pred double")
    got = resample.bootstrap_metrics(df, ["model"], "group_id", 4, 9).toPandas().set_index("replicate").sort_index()
    drawn = resample.drawn_units(df, ["model"], "group_id", 4, 9).toPandas()
    times = {(d["replicate"], r.group_id): d["times"] for r in drawn.itertuples() for d in r.drawn}
    pdf = df.toPandas()
    for rep in range(4):
        part = pd.concat([pdf[pdf.group_id == u] for u in units for _ in range(times.get((rep, u), 0))])
        assert sum(v for (r, _), v in times.items() if r == rep) == len(units)
        pcc = [np.corrcoef(g.y_true, g.y_pred)[0, 1] for _, g in part.groupby("feature")]
        rho = [spearman_reference(g.y_true.to_numpy(), g.y_pred.to_numpy()) for _, g in part.groupby("feature")]
        r2 = [1 - ((g.y_true - g.y_pred) ** 2).sum() / ((g.y_true - g.y_true.mean()) ** 2).sum() for _, g in part.groupby("feature")]
        want = [((part.y_true - part.y_pred) ** 2).mean(), (part.y_true - part.y_pred).abs().mean(), np.mean(pcc), np.mean(rho), np.mean(r2)]
        assert got.loc[rep, ["mse", "mae", "pcc", "spearman", "r2"]].to_numpy(dtype=float) == pytest.approx(want)


def test_interval_needs_two_replicates(spark):
    df = spark.createDataFrame([("m", 0, 1.0, None), ("m", 1, 3.0, 2.0)], "model string, replicate int, mse double, pcc double")
    out = {r.metric: r for r in resample.percentile_interval(df, ["model"], ["mse", "pcc"]).collect()}
    assert out["mse"].low == pytest.approx(1.05) and out["pcc"].low is None


def test_alignment_and_primary(spark):
    a = spark.createDataFrame([("i", "f"), ("i", "g")], "instance_id string, feature string")
    b = spark.createDataFrame([("i", "f"), ("j", "f")], "instance_id string, feature string")
    assert evaluate.prediction_mismatch(a, b).count() == 2
    table = spark.createDataFrame([(0.5,)], "pcc_macro double")
    assert evaluate.primary_value(table, "macro_pcc").first().primary_value == 0.5
    assert "not a computed name" in evaluate.primary_value(table, "nope").first().warning


def test_bootstrap_in_arrays_equals_the_expanded_form(spark):
    rng = np.random.default_rng(8)
    rows = []
    for m, n in (("a", 9), ("b", 2), ("c", 1)):
        for u in range(n):
            for k in range(3):
                t, p = np.round(rng.normal(size=2), 1)
                rows += [
                    (m, f"u{u}", "ties", float(t), float(p)), (m, f"u{u}", "constant", 0.1, float(p)),
                    (m, f"u{u}", "tiny", 1e9 + float(t), float(t)), (m, f"u{u}", "gaps", float(t) if k else None, float("nan") if k == 2 else float(p)),
                ]
        rows.append((m, "u0", "single", 1.0, 2.0))
    df = spark.createDataFrame(rows, "model string, group_id string, feature string, y_true double, y_pred double")
    order = lambda out: out.toPandas().sort_values(["model", "replicate"]).reset_index(drop=True)
    held = order(resample.bootstrap_metrics(df, ["model"], "group_id", 40, 3))
    expanded = order(resample.bootstrap_metrics(df, ["model"], "group_id", 40, 3, held=0))
    mixed = order(resample.bootstrap_metrics(df, ["model"], "group_id", 40, 3, held=40 * 4))
    assert len(held) == 120
    for other in (expanded, mixed):
        pd.testing.assert_frame_equal(held, other, check_dtype=False, rtol=1e-9)


def test_bootstrap_multiplicities_are_the_draws(spark):
    units = spark.createDataFrame([(m, f"u{i}") for m, n in (("a", 300), ("b", 1)) for i in range(n)], "model string, group_id string")
    packed = resample.multiplicities(units, ["model"], "group_id", 50, 3).collect()
    want = {(r.model, r.group_id): {d.replicate: d.times for d in r.drawn} for r in resample.drawn_units(units, ["model"], "group_id", 50, 3).collect()}
    got = {(r.model, r.group_id): {i: int(n) for i, n in enumerate(np.frombuffer(r.times, np.uint16)) if n} for r in packed}
    assert got == want and sum(sum(v.values()) for (m, _), v in got.items() if m == "a") == 300 * 50


def test_bootstrap_of_no_cells(spark):
    df = spark.createDataFrame([], "model string, group_id string, feature string, y_true double, y_pred double")
    assert resample.bootstrap_ci(df, ["model"], "group_id", 10, 1).count() == 0
