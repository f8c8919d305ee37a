from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from cohortflow.operators import linear, tiles


def data(spark, n=200, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = np.column_stack([x @ rng.normal(size=p) + 1.5, x @ rng.normal(size=p)]) + 0.1 * rng.normal(size=(n, 2))
    y[rng.random(y.shape) < 0.2] = np.nan
    keep = ~np.isnan(y).all(axis=1)
    x, y = x[keep], y[keep]
    rows = [(x[i].tolist(), [j for j in (0, 1) if not np.isnan(y[i, j])], [float(v) for v in y[i] if not np.isnan(v)]) for i in range(len(x))]
    return x, y, spark.createDataFrame(rows, "x array<double>, t array<int>, y array<double>").repartition(3)


def closed_form(x, y, alpha, intercept=True, penalty=0):
    y = np.where(np.isnan(y), np.nanmean(y, axis=0), y)
    if not intercept:
        return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y), np.zeros(y.shape[1])
    xc, yc = x - x.mean(0), y - y.mean(0)
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]) + penalty, xc.T @ yc)
    return b, y.mean(0) - x.mean(0) @ b


@pytest.mark.parametrize("intercept", [True, False])
def test_ridge_equals_the_closed_form_with_missing_targets(spark, intercept):
    x, y, df = data(spark)
    fit = linear.ridge_fit(linear.moments(df, 4), 0.7, intercept=intercept).toPandas().sort_values("t")
    b, c = closed_form(x, y, 0.7, intercept)
    assert np.allclose(np.stack(fit.coef).T, b) and np.allclose(fit.intercept, c)


def entries(spark, matrix):
    return spark.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))], "i int, j int, value double")


def test_graph_penalty(spark):
    x, y, df = data(spark)
    lap = 3.0 * np.array([[1, -1, 0, 0], [-1, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0.0]])
    fit = linear.ridge_fit(linear.moments(df, 4), 0.7, entries(spark, lap)).toPandas().sort_values("t")
    assert np.allclose(np.stack(fit.coef).T, closed_form(x, y, 0.7, penalty=lap)[0])


def test_path_equals_single_fits(spark):
    _, _, df = data(spark)
    mom = linear.moments(df, 4)
    alphas = [0.01, 1.0, 50.0]
    path = linear.ridge_path(mom, alphas).toPandas().set_index("t")
    for k, alpha in enumerate(alphas):
        one = linear.ridge_fit(mom, alpha).toPandas().set_index("t")
        for t in (0, 1):
            assert np.allclose(path.coefs[t][k], one.coef[t]) and path.intercepts[t][k] == pytest.approx(one.intercept[t])


def test_inputs_are_laid_out_in_name_order(spark):
    cells = spark.createDataFrame(
        [("o1", "rna", "b", 2.0), ("o1", "rna", "b", 1.5), ("o1", "protein", "a", 1.0), ("o2", "rna", "c", None), ("o2", "rna", "b", 4.0)],
        "observation_id string, modality string, feature string, scaled double",
    )
    names = linear.feature_header(cells, ["rna", "protein"])
    assert names.n == 3 and [r.name for r in names.table.orderBy("at").collect()] == ["protein:a", "rna:b", "rna:c"]
    got = {r.observation_id: r.inputs for r in linear.input_vectors(cells, names, ["observation_id"], "scaled").collect()}
    assert got == {"o1": [1.0, 2.0, None], "o2": [None, 4.0, None]}


def test_many_targets_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(linear, "HELD_BYTES", 1)  # every batch is passed on
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 5)), rng.normal(size=(80, 150))
    rows = [(x[i].tolist(), list(range(150)), y[i].tolist()) for i in range(80)]
    fit = linear.ridge_fit(linear.moments(spark.createDataFrame(rows, "x array<double>, t array<int>, y array<double>").repartition(3), 5), 0.7).toPandas().sort_values("t")
    assert list(fit.t) == list(range(150)) and np.allclose(np.stack(fit.coef).T, closed_form(x, y, 0.7)[0])


def wide_data(spark, n, p, targets, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 0.5
    y = x[:, :5] @ rng.normal(size=(5, targets)) + 0.1 * rng.normal(size=(n, targets)) + 2
    y[rng.random(y.shape) < 0.2] = np.nan
    rows = [(x[i].tolist(), [j for j in range(targets) if not np.isnan(y[i, j])], [float(v) for v in y[i] if not np.isnan(v)]) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "x array<double>, t array<int>, y array<double>").repartition(4)


def placed(fit, targets):
    out = fit.toPandas().sort_values("t")
    assert list(out.t) == list(range(targets))
    return np.stack(out.coef).T, out.intercept.to_numpy()


@pytest.mark.parametrize("n, p", [(70, 100), (60, 40)])
@pytest.mark.parametrize("direct", [16, 400])
@pytest.mark.parametrize("intercept", [True, False])
def test_tiles_equal_the_closed_form(spark, monkeypatch, n, p, direct, intercept):
    """Dual and primal systems, inverted at once and eliminated tile by tile."""
    monkeypatch.setattr(tiles, "BLOCK", 16)
    monkeypatch.setattr(tiles, "WIDE", 4)
    x, y, df = wide_data(spark, n, p, 6)
    out = tiles.ridge(df, p, [0.7, 20.0], None, intercept, direct).toPandas().sort_values("t")
    for k, alpha in enumerate([0.7, 20.0]):
        b, c = closed_form(x, y, alpha, intercept)
        assert np.allclose(np.stack([v[k] for v in out.coefs]).T, b) and np.allclose([v[k] for v in out.intercepts], c)


@pytest.mark.parametrize("direct", [16, 400])
def test_sparse_penalty_on_tiles(spark, monkeypatch, direct):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    monkeypatch.setattr(linear, "DIRECT", direct)
    x, y, df = wide_data(spark, 30, 50, 3)
    lap = np.zeros((50, 50))
    for i, j in [(0, 1), (1, 40), (20, 33)]:
        lap[[i, j], [i, j]] += 2.0
        lap[[i, j], [j, i]] -= 2.0
    b, c = closed_form(x, y, 0.7, penalty=lap)
    coef, shift = placed(linear.ridge_fit(linear.moments(df, 50), 0.7, entries(spark, lap)), 3)
    assert np.allclose(coef, b) and np.allclose(shift, c)


def test_twenty_thousand_columns(spark):
    """More columns than one solve holds, and than rows: the dual system, against its closed form in numpy."""
    n, p = 90, 20_000
    x, y, df = wide_data(spark, n, p, 3)
    coef, shift = placed(linear.ridge_fit(linear.moments(df, p), 5.0), 3)
    yc = np.where(np.isnan(y), np.nanmean(y, axis=0), y)
    xc, ym = x - x.mean(0), yc - yc.mean(0)
    b = xc.T @ np.linalg.solve(xc @ xc.T + 5.0 * np.eye(n), ym)
    assert np.allclose(coef, b) and np.allclose(shift, yc.mean(0) - x.mean(0) @ b)


def test_three_hundred_thousand_targets(spark):
    rng = np.random.default_rng(4)
    n, p, many = 12, 3, 300_000
    x, y = rng.normal(size=(n, p)), rng.normal(size=(n, many))
    rows = spark.createDataFrame([(x[i].tolist(), i) for i in range(n)], "x array<double>, i int").repartition(3)
    table = spark.sparkContext.broadcast(y)

    def targets(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([np.arange(many)], pa.list_(pa.int32())), pa.array([table.value[row.column(1)[0].as_py()]], pa.list_(pa.float64()))], names=["x", "t", "y"])

    fit = linear.ridge_fit(linear.moments(rows.mapInArrow(targets, "x array<double>, t array<int>, y array<double>"), p), 0.7).toPandas().sort_values("t")
    assert len(fit) == many and np.allclose(np.stack(fit.coef).T, closed_form(x, y, 0.7)[0])


@pytest.mark.parametrize("shared", [1 << 25, 400])
def test_predictions_by_blocks(spark, monkeypatch, shared):
    """Coefficients that go to every task, and a grid of blocks; targets without coefficients are left out."""
    monkeypatch.setattr(linear, "SHARED_BYTES", shared)
    x, y, df = wide_data(spark, 40, 6, 9)
    rng = np.random.default_rng(5)
    coef, shift = rng.normal(size=(2, 9, 6)), rng.normal(size=(2, 9))
    rows = spark.createDataFrame([(t, m, coef[m, t].tolist(), float(shift[m, t])) for t in range(8) for m in range(2)], "t int, model int, coef array<double>, intercept double")
    named = df.withColumn("id", F.monotonically_increasing_id())
    want = sorted((r.id, t, m, v, float(np.dot(r.x, coef[m, t]) + shift[m, t])) for r in named.collect() for t, v in zip(r.t, r.y) if t < 8 for m in range(2))
    got = sorted((r.id, r.t, r.model, r.y_true, r.y_pred) for r in linear.predict(named, rows, 6, ["id"]).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    paths = rows.where("t < 8").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("model", "coef", "intercept"))).alias("e")).select("t", F.col("e.coef").alias("coefs"), F.col("e.intercept").alias("intercepts"))
    for r in linear.sweep_scores(named, paths, 6, [0.1, 1.0]).collect():
        gaps = np.array([w[3] - w[4] for w in want if w[2] == r.trial])
        assert (r.mse, r.mae, r.n) == (pytest.approx((gaps**2).mean()), pytest.approx(np.abs(gaps).mean()), len(gaps))


def test_column_ranges_and_back(spark):
    x, y, df = wide_data(spark, 60, 8, 3)
    ranges = [(0, 3), (6, 8)]
    keep = [0, 1, 2, 6, 7]
    b, c = closed_form(x[:, keep], y, 0.7)
    coef, shift = placed(linear.spread(linear.ridge_fit(linear.moments(df, 8).part(ranges), 0.7), ranges, 8), 3)
    assert np.allclose(coef[keep], b) and not coef[[3, 4, 5]].any() and np.allclose(shift, c)


def test_spline_basis_sums_to_one_with_its_first_column(spark):
    times = spark.createDataFrame(pd.DataFrame({"time": np.linspace(0, 8, 33), "condition": "a"}))
    knots = linear.spline_knots(times, 4)
    assert knots == (0.0, [4.0], 8.0)
    out = np.array([r.x for r in linear.spline_design(times, "time", linear.condition_header(times), knots).orderBy("time").collect()])
    basis = out[:, 1:]
    assert basis.shape[1] == 4 and (basis >= -1e-12).all()
    assert np.allclose(basis[-1], [0, 0, 0, 1]) and np.allclose(basis[0], 0)
    # The left-out first column is (1 - t/4)^3 before the inner knot and 0 after it.
    t = np.linspace(0, 8, 33)
    assert np.allclose(1 - basis.sum(axis=1), np.where(t < 4, (1 - t / 4) ** 3, 0))


def test_spline_names_follow_the_design(spark):
    df = spark.createDataFrame([(1.0, "a"), (7.0, "b"), (9.0, "b")], "time double, condition string")
    knots = (0.0, [4.0], 8.0)
    conditions = linear.condition_header(df)
    rows = linear.spline_design(df, "time", conditions, knots).orderBy("time").collect()
    assert len(rows) == 3 and linear.outside_range(df, "time", knots).count() == 1
    names = linear.spline_header(conditions, 4)
    basis = [f"bs(time)[{i}]" for i in range(4)]
    assert [r.name for r in names.table.orderBy("at").collect()] == ["Intercept", "C(condition)[T.b]", *basis, *[f"{b}:C(condition)[T.b]" for b in basis]]
    assert len(rows[0].x) == names.n == 10
    assert rows[0].x[1] == 0.0 and rows[0].x[6:] == [0.0] * 4 and rows[1].x[2:6] == rows[1].x[6:] and rows[2].x[2:6] == [0.0] * 4


def test_log_uniform_is_seeded():
    a = linear.log_uniform(1e-3, 1e3, 20, 1)
    assert a == linear.log_uniform(1e-3, 1e3, 20, 1) and all(1e-3 <= v <= 1e3 for v in a)
