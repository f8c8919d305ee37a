"""Ridge, spline, sweep and benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions.numeric import rounded
from cohortflow.operators import evaluate, linear
from cohortflow.plans.proxies import GROUP_MIN_TIME, event_forecast, order_forecast
from cohortflow.plans.registry import query
from cohortflow.plans.runs import LastValue, Ridge, TimeSpline, benchmark_predictions, tune
from cohortflow.plans.sql import fragment, metric_sql, r6, with_query

ALPHA = 1.0
M = metric_sql()


def _round(df, *names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def gauss_jordan(name: str, matrix: str) -> None:
    """Fragment ``<name>_rec`` reducing the augmented matrix ``matrix(p, m)`` to the identity."""
    fragment(
        f"{name}_rec",
        f"""SELECT 1 AS k, p, m FROM {matrix}
        UNION ALL SELECT k + 1, p, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k])
          ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM {name}_rec WHERE k <= p""",
        matrix,
    )
    fragment(f"{name}_solved", f"SELECT p, m FROM {name}_rec WHERE k = p + 1", f"{name}_rec")


def normal_equations(name: str, design: str, targets: str, alpha: str, intercept: bool, penalty: str | None = None) -> None:
    """Fragments for centred (or raw) ridge normal equations of ``design(id, j, x)`` and
    ``targets(id, t, y)`` up to ``<name>_coef(t, j, coef)`` and ``<name>_icpt(t, intercept)``."""
    fragment(f"{name}_xm", f"SELECT j, avg(x) AS xm, count(*) AS n, sum(x) AS sx FROM {design} GROUP BY j", design)
    fragment(f"{name}_ym", f"SELECT t, avg(y) AS ym FROM {targets} GROUP BY t", targets)
    xa, xb = ("(a.x - xa.xm)", "(b.x - xb.xm)") if intercept else ("a.x", "b.x")
    extra = f"+ coalesce((SELECT sum(w) FROM {penalty} q WHERE q.i = a.j AND q.j = b.j), 0)" if penalty else ""
    fragment(
        f"{name}_gram",
        f"""SELECT a.j AS i, b.j AS j, sum({xa} * {xb}) + CASE WHEN a.j = b.j THEN {alpha} ELSE 0 END {extra} AS v
        FROM {design} a JOIN {design} b USING (id) JOIN {name}_xm xa ON xa.j = a.j JOIN {name}_xm xb ON xb.j = b.j GROUP BY a.j, b.j""",
        design, f"{name}_xm", *([penalty] if penalty else []),
    )
    right = (
        "sum((a.x - xa.xm) * (y.y - m.ym))"
        if intercept
        else "sum(a.x * y.y) + any_value(m.ym) * (any_value(xa.sx) - sum(a.x))"
    )
    fragment(
        f"{name}_rhs",
        f"""SELECT a.j AS i, y.t, {right} AS v FROM {design} a JOIN {targets} y USING (id)
        JOIN {name}_ym m ON m.t = y.t JOIN {name}_xm xa ON xa.j = a.j GROUP BY a.j, y.t""",
        design, targets, f"{name}_ym", f"{name}_xm",
    )
    fragment(
        f"{name}_aug",
        f"""SELECT (SELECT count(*) FROM {name}_xm) AS p, list(row ORDER BY i) AS m FROM (
          SELECT i, list(v ORDER BY side, c) AS row FROM (SELECT i, 0 AS side, j::VARCHAR AS c0, j AS c, v FROM {name}_gram
            UNION ALL SELECT i, 1, t, (SELECT count(*) FROM {name}_ym y2 WHERE y2.t < r.t) + 1, v FROM {name}_rhs r) GROUP BY i)""",
        f"{name}_gram", f"{name}_rhs", f"{name}_ym", f"{name}_xm",
    )
    gauss_jordan(name, f"{name}_aug")
    fragment(
        f"{name}_coef",
        f"""SELECT y.t, x.j, s.m[x.j][s.p + y.at] AS coef FROM {name}_solved s,
          {name}_xm x, (SELECT t, row_number() OVER (ORDER BY t) AS at FROM {name}_ym) y""",
        f"{name}_solved", f"{name}_xm", f"{name}_ym",
    )
    fragment(
        f"{name}_icpt",
        f"SELECT c.t, any_value(m.ym) - sum(c.coef * x.xm) AS intercept FROM {name}_coef c JOIN {name}_xm x USING (j) JOIN {name}_ym m ON m.t = c.t GROUP BY c.t",
        f"{name}_coef", f"{name}_xm", f"{name}_ym",
    )


fragment("p1_names", "SELECT modality || ':' || feature AS name, modality, feature, row_number() OVER (ORDER BY modality || ':' || feature) AS j FROM (SELECT DISTINCT modality, feature FROM p1_cells)", "p1_cells")
fragment("p1_fill", "SELECT feature, avg(scaled) AS fill FROM p1_scaled WHERE split = 'train' GROUP BY 1", "p1_scaled")
fragment("p1_conds", "SELECT condition, row_number() OVER (ORDER BY condition) AS c FROM (SELECT DISTINCT condition FROM p1_inst WHERE split = 'train')", "p1_inst")
fragment(
    "p1_design_all",
    """SELECT i.instance_id AS id, n.j, coalesce(c.scaled, f.fill, 0) AS x, n.name FROM p1_inst i CROSS JOIN p1_names n
      LEFT JOIN p1_scaled c ON c.observation_id = i.history_observation AND c.feature = n.feature LEFT JOIN p1_fill f ON f.feature = n.feature
    UNION ALL SELECT instance_id, (SELECT count(*) FROM p1_names) + 1, target_time, 'target_time' FROM p1_inst
    UNION ALL SELECT instance_id, (SELECT count(*) FROM p1_names) + 2, coalesce(delta_t, 0), 'delta_t' FROM p1_inst
    UNION ALL SELECT instance_id, (SELECT count(*) FROM p1_names) + 2 + c, CASE WHEN i.condition = k.condition THEN 1.0 ELSE 0.0 END, 'condition_' || k.condition FROM p1_inst i CROSS JOIN p1_conds k""",
    "p1_inst", "p1_names", "p1_scaled", "p1_fill", "p1_conds",
)
fragment("p1_ytrain", "SELECT instance_id AS id, feature AS t, y_true AS y FROM p1_targets WHERE split = 'train'", "p1_targets")
fragment("p1_design", "SELECT d.id, d.j, d.x FROM p1_design_all d WHERE id IN (SELECT id FROM p1_ytrain)", "p1_design_all", "p1_ytrain")
normal_equations("rg", "p1_design", "p1_ytrain", str(ALPHA), True)
fragment(
    "rg_pred",
    """SELECT t.split, t.instance_id, t.group_id, t.feature, t.y_true, any_value(k.intercept) + sum(d.x * c.coef) AS y_pred
    FROM p1_targets t JOIN p1_design_all d ON d.id = t.instance_id JOIN rg_coef c ON c.t = t.feature AND c.j = d.j JOIN rg_icpt k ON k.t = t.feature
    GROUP BY t.split, t.instance_id, t.group_id, t.feature, t.y_true""",
    "p1_targets", "p1_design_all", "rg_coef", "rg_icpt",
)


@query(
    "ridge_coef",
    with_query(
        f"""SELECT c.t AS target, n.name AS feature, {r6('c.coef', 'coefficient')} FROM rg_coef c JOIN (SELECT DISTINCT j, name FROM p1_design_all) n USING (j)
        UNION ALL SELECT t, 'intercept', {r6('intercept')} FROM rg_icpt""",
        "rg_coef", "rg_icpt", "p1_design_all",
    ),
)
def ridge_coef(spark, sf):
    return _round(Ridge(event_forecast(spark, sf), ALPHA).explain(), "coefficient")


SCORES = f"count(*) AS n_observed, count(*) AS n_valid, {r6(M['mse'], 'mse')}, {r6(M['mae'], 'mae')}, {r6('sqrt(' + M['mse'] + ')', 'rmse')}, {r6(M['pcc'], 'pcc')}, {r6(M['r2'], 'r2')}"
SCORE_NAMES = ["mse", "mae", "rmse", "pcc", "r2"]


@query("ridge_scores", with_query(f"SELECT split, {SCORES} FROM (SELECT *, y_true AS t, y_pred AS p FROM rg_pred) GROUP BY split", "rg_pred"))
def ridge_scores(spark, sf):
    scored = Ridge(event_forecast(spark, sf), ALPHA).predict()
    return _round(evaluate.grouped_scores(scored, ["split"]).drop("_defined"), *SCORE_NAMES)


TRIALS, SWEEP_SEED = 8, 5
_ALPHAS = linear.log_uniform(1e-3, 1e3, TRIALS, SWEEP_SEED)
for _k, _a in enumerate(_ALPHAS):
    normal_equations(f"sw{_k}", "p1_design", "p1_ytrain", repr(_a), True)
fragment(
    "sweep_trials",
    " UNION ALL ".join(
        f"""SELECT {k}::BIGINT AS trial, {a!r}::DOUBLE AS alpha, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae, count(*) AS n
        FROM (SELECT t.instance_id, t.feature, t.y_true, any_value(k.intercept) + sum(d.x * c.coef) AS y_pred FROM p1_targets t
          JOIN p1_design_all d ON d.id = t.instance_id JOIN sw{k}_coef c ON c.t = t.feature AND c.j = d.j JOIN sw{k}_icpt k ON k.t = t.feature
          WHERE t.split = 'val' GROUP BY ALL)"""
        for k, a in enumerate(_ALPHAS)
    ),
    "p1_targets", "p1_design_all", *[f"sw{k}_{part}" for k in range(TRIALS) for part in ("coef", "icpt")],
)


@query("sweep_val", with_query(f"SELECT trial, {r6('alpha', 'alpha')}, {r6('mse', 'mse')}, {r6('mae', 'mae')}, n, (trial = (SELECT arg_min(trial, mse) FROM sweep_trials)) AS best FROM sweep_trials", "sweep_trials"))
def sweep_val(spark, sf):
    trials, best = tune(event_forecast(spark, sf), "ridge", TRIALS, SWEEP_SEED)
    return _round(trials.withColumn("best", F.col("alpha") == best["alpha"]), "alpha", "mse", "mae")


SPLINE_DF = 4


def _bernstein_free_sql(x: str, low: str, inner: list[str], high: str) -> list[str]:
    """The truncated-knot B-spline columns written out for SQL, first column dropped."""
    knots = [low] * 4 + inner + [high] * 4
    level = []
    last = 3 + len(inner)
    for i in range(len(knots) - 1):
        if i < 3 or i > last:
            level.append("0.0")
        else:
            close = "<=" if i == last else "<"
            level.append(f"(CASE WHEN {x} >= {knots[i]} AND {x} {close} {knots[i + 1]} THEN 1.0 ELSE 0.0 END)")
    for d in (1, 2, 3):
        level = [
            "("
            + f"coalesce(({x} - {knots[i]}) / nullif({knots[i + d]} - {knots[i]}, 0) * {level[i]}, 0) + "
            + f"coalesce(({knots[i + d + 1]} - {x}) / nullif({knots[i + d + 1]} - {knots[i + 1]}, 0) * {level[i + 1]}, 0))"
            for i in range(len(level) - 1)
        ]
    return level[1:]


fragment("sp_obs", "SELECT o.observation_id, o.condition, o.time, u.split FROM p1_obs o JOIN p1_units u USING (unit)", "p1_obs", "p1_units")
fragment("sp_keep", "SELECT DISTINCT observation_id FROM p1_scaled WHERE modality = 'protein' AND scaled IS NOT NULL AND split = 'train'", "p1_scaled")
fragment(
    "sp_knots",
    "SELECT min(time) AS lo, quantile_cont(time, 0.5) AS mid, max(time) AS hi FROM sp_obs JOIN sp_keep USING (observation_id)",
    "sp_obs", "sp_keep",
)


def _spline_rows(source: str, ident: str, time: str, inner: tuple[str, ...] = ("k.mid",)) -> str:
    basis = _bernstein_free_sql("x.time", "k.lo", list(inner), "k.hi")
    cols = ["1.0", "CASE WHEN x.condition = 'c1' THEN 1.0 ELSE 0.0 END", *basis, *[f"{b} * CASE WHEN x.condition = 'c1' THEN 1.0 ELSE 0.0 END" for b in basis]]
    return f"SELECT id, unnest(range(1, {len(cols) + 1})) AS j, unnest(xs) AS x FROM (SELECT x.id, [{', '.join(f'({c})::DOUBLE' for c in cols)}] AS xs FROM (SELECT {ident} AS id, {time} AS time, condition FROM {source}) x, sp_knots k WHERE x.time BETWEEN k.lo AND k.hi)"


fragment("sp_design", _spline_rows("sp_obs JOIN sp_keep USING (observation_id)", "observation_id", "time"), "sp_obs", "sp_keep", "sp_knots")
fragment("sp_y", "SELECT observation_id AS id, feature AS t, scaled AS y FROM p1_scaled WHERE modality = 'protein' AND scaled IS NOT NULL AND split = 'train'", "p1_scaled")
normal_equations("sp", "sp_design", "sp_y", str(ALPHA), False)
fragment("sp_design_all", _spline_rows("p1_inst", "instance_id", "target_time"), "p1_inst", "sp_knots")
fragment(
    "sp_pred",
    """SELECT t.split, t.instance_id, t.feature, t.y_true, sum(d.x * c.coef) AS y_pred FROM p1_targets t JOIN sp_design_all d ON d.id = t.instance_id
    JOIN sp_coef c ON c.t = t.feature AND c.j = d.j GROUP BY ALL""",
    "p1_targets", "sp_design_all", "sp_coef",
)


@query(
    "spline_coef",
    with_query(f"SELECT t AS target, j AS position, {r6('coef', 'coefficient')} FROM sp_coef", "sp_coef"),
)
def spline_coef(spark, sf):
    model = TimeSpline(event_forecast(spark, sf), SPLINE_DF, ALPHA)
    named = linear.named_targets(model.coefs, model.data.target_names)
    out = named.select(F.col("feature").alias("target"), F.posexplode("coef").alias("p", "coefficient"))
    return _round(out.select("target", (F.col("p") + 1).cast("bigint").alias("position"), "coefficient"), "coefficient")


@query("spline_scores", with_query(f"SELECT split, {SCORES} FROM (SELECT *, y_true AS t, y_pred AS p FROM sp_pred) GROUP BY split", "sp_pred"))
def spline_scores(spark, sf):
    scored = TimeSpline(event_forecast(spark, sf), SPLINE_DF, ALPHA).predict()
    return _round(evaluate.grouped_scores(scored, ["split"]).drop("_defined"), *SCORE_NAMES)


SPLINE_TRIALS = 4
_SPLINE_ALPHAS = linear.log_uniform(1e-3, 1e2, SPLINE_TRIALS, SWEEP_SEED)
fragment("sp3_design", _spline_rows("sp_obs JOIN sp_keep USING (observation_id)", "observation_id", "time", ()), "sp_obs", "sp_keep", "sp_knots")
fragment("sp3_design_all", _spline_rows("p1_inst", "instance_id", "target_time", ()), "p1_inst", "sp_knots")
_SPLINE_FITS = [(df, k, f"sw{df}_{k}", "sp3" if df == 3 else "sp") for df in (3, 4) for k in range(SPLINE_TRIALS)]
for _df, _k, _name, _of in _SPLINE_FITS:
    normal_equations(_name, f"{_of}_design", "sp_y", repr(_SPLINE_ALPHAS[_k]), False)
fragment(
    "spline_trials",
    " UNION ALL ".join(
        f"""SELECT {k}::BIGINT AS trial, {_SPLINE_ALPHAS[k]!r}::DOUBLE AS alpha, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae, count(*) AS n, {df}::BIGINT AS spline_df
        FROM (SELECT t.instance_id, t.feature, t.y_true, sum(d.x * c.coef) AS y_pred FROM p1_targets t JOIN {of}_design_all d ON d.id = t.instance_id
          JOIN {name}_coef c ON c.t = t.feature AND c.j = d.j WHERE t.split = 'val' GROUP BY ALL)"""
        for df, k, name, of in _SPLINE_FITS
    ),
    "p1_targets", "sp_design_all", "sp3_design_all", *[f"{name}_coef" for _, _, name, _ in _SPLINE_FITS],
)


@query("spline_sweep", with_query(f"SELECT trial, {r6('alpha', 'alpha')}, {r6('mse', 'mse')}, {r6('mae', 'mae')}, n, spline_df FROM spline_trials", "spline_trials"))
def spline_sweep(spark, sf):
    """Validation error over spline widths and penalties."""
    trials, _ = tune(event_forecast(spark, sf), "time_spline", SPLINE_TRIALS, SWEEP_SEED)
    return _round(trials, "alpha", "mse", "mae")


@query(
    "benchmark_models",
    with_query(
        " UNION ALL ".join(
            f"SELECT '{name}' AS model, split, {SCORES} FROM (SELECT split, y_true AS t, y_pred AS p FROM {src} WHERE split = 'val') GROUP BY split"
            for name, src in (("last_value", "p1_lv"), ("ridge", "rg_pred"), ("time_spline", "sp_pred"))
        ),
        "p1_lv", "rg_pred", "sp_pred",
    ),
)
def benchmark_models(spark, sf):
    """Fit on train, predict validation, score every model in one grouped pass."""
    models = {"last_value": {}, "ridge": {"alpha": ALPHA}, "time_spline": {"spline_df": SPLINE_DF, "alpha": ALPHA}}
    cells = benchmark_predictions(event_forecast(spark, sf), models)
    return _round(evaluate.grouped_scores(cells, ["model", "split"]).drop("_defined"), *SCORE_NAMES)


# Cross-sectional study: last values come from train condition x time means.
fragment("p2_keys", "SELECT DISTINCT o.condition, o.time FROM p2_obs o JOIN p2_units u USING (unit) WHERE u.split = 'train'", "p2_obs", "p2_units")
fragment(
    "p2_inst",
    f"""SELECT o.unit || ':' || o.time::VARCHAR AS instance_id, o.unit AS group_id, o.condition, o.batch, u.split, o.time AS target_time, o.observation_id
    FROM p2_obs o JOIN p2_units u USING (unit) WHERE o.time >= {GROUP_MIN_TIME}""",
    "p2_obs", "p2_units",
)
fragment(
    "p2_asof",
    """SELECT condition, target_time, key_condition, key_time, tier > 0 AS used_fallback FROM (
      SELECT q.condition, q.target_time, k.condition AS key_condition, k.time AS key_time,
        CASE WHEN k.condition = q.condition AND k.time < q.target_time THEN 0 WHEN k.condition = q.condition THEN 1 ELSE 2 END AS tier,
        row_number() OVER (PARTITION BY q.condition, q.target_time ORDER BY CASE WHEN k.condition = q.condition AND k.time < q.target_time THEN 0 WHEN k.condition = q.condition THEN 1 ELSE 2 END,
          abs(q.target_time - k.time), k.time, k.condition) AS rn
      FROM (SELECT DISTINCT condition, target_time FROM p2_inst) q CROSS JOIN p2_keys k) WHERE rn = 1""",
    "p2_inst", "p2_keys",
)
fragment("p2_means", "SELECT condition, time, modality, feature, avg(scaled) AS mean FROM p2_scaled WHERE split = 'train' GROUP BY ALL", "p2_scaled")
fragment(
    "p2_lv",
    """SELECT i.split, i.instance_id, i.group_id, c.feature, c.scaled AS y_true, coalesce(m.mean, 0) AS y_pred FROM p2_inst i
    JOIN p2_scaled c ON c.observation_id = i.observation_id AND c.modality = 'protein' AND c.scaled IS NOT NULL
    JOIN p2_asof a ON a.condition = i.condition AND a.target_time = i.target_time
    LEFT JOIN p2_means m ON m.condition = a.key_condition AND m.time = a.key_time AND m.feature = c.feature""",
    "p2_inst", "p2_scaled", "p2_asof", "p2_means",
)


@query("group_instances", with_query("SELECT instance_id, group_id, condition, batch, split, target_time FROM p2_inst", "p2_inst"))
def group_instances(spark, sf):
    return order_forecast(spark, sf).instances.select("instance_id", "group_id", "condition", "batch", "split", "target_time")


@query("asof_group_mean", with_query("SELECT * FROM p2_asof", "p2_asof"))
def asof_group_mean(spark, sf):
    return order_forecast(spark, sf).keys


@query("condition_time_means", with_query(f"SELECT condition, time, modality, feature, {r6('mean', 'mean')} FROM p2_means", "p2_means"))
def condition_time_means(spark, sf):
    return _round(order_forecast(spark, sf).means, "mean")


@query("group_last_value_scores", with_query(f"SELECT split, {SCORES} FROM (SELECT *, y_true AS t, y_pred AS p FROM p2_lv) GROUP BY split", "p2_lv"))
def group_last_value_scores(spark, sf):
    cells = LastValue(order_forecast(spark, sf)).predict()
    return _round(evaluate.grouped_scores(cells, ["split"]).drop("_defined"), *SCORE_NAMES)


fragment("p2_names", "SELECT modality, feature, modality || ':' || feature AS name, row_number() OVER (ORDER BY modality || ':' || feature) AS j FROM (SELECT DISTINCT modality, feature FROM p2_cells)", "p2_cells")
fragment("p2_conds", "SELECT condition, row_number() OVER (ORDER BY condition) AS c FROM (SELECT DISTINCT condition FROM p2_keys)", "p2_keys")
fragment(
    "p2_rowx",
    """SELECT a.condition, a.target_time, n.j, coalesce(m.mean, 0) AS x FROM p2_asof a CROSS JOIN p2_names n
      LEFT JOIN p2_means m ON m.condition = a.key_condition AND m.time = a.key_time AND m.modality = n.modality AND m.feature = n.feature
    UNION ALL SELECT condition, target_time, (SELECT count(*) FROM p2_names) + 1, target_time FROM p2_asof
    UNION ALL SELECT condition, target_time, (SELECT count(*) FROM p2_names) + 2, target_time - key_time FROM p2_asof
    UNION ALL SELECT a.condition, target_time, (SELECT count(*) FROM p2_names) + 2 + k.c, CASE WHEN a.condition = k.condition THEN 1.0 ELSE 0.0 END FROM p2_asof a CROSS JOIN p2_conds k""",
    "p2_asof", "p2_names", "p2_means", "p2_conds",
)
fragment(
    "p2_y",
    """SELECT i.instance_id AS id, i.split, i.condition, i.target_time, c.feature AS t, c.scaled AS y FROM p2_inst i
    JOIN p2_scaled c ON c.observation_id = i.observation_id AND c.modality = 'protein' AND c.scaled IS NOT NULL""",
    "p2_inst", "p2_scaled",
)
# Rows share a design vector per (condition, time), so SQL sums them by that key.
fragment("p2_ytrain", "SELECT * FROM p2_y WHERE split = 'train'", "p2_y")
fragment("p2_rows", "SELECT condition, target_time, count(DISTINCT id) AS w FROM p2_ytrain GROUP BY ALL", "p2_ytrain")
fragment("gr_xm", "SELECT j, sum(w * x) / sum(w) AS xm FROM p2_rowx JOIN p2_rows USING (condition, target_time) GROUP BY j", "p2_rowx", "p2_rows")
fragment("gr_ym", "SELECT t, avg(y) AS ym FROM p2_ytrain GROUP BY t", "p2_ytrain")
fragment(
    "gr_gram",
    f"""SELECT a.j AS i, b.j AS j, sum(r.w * (a.x - xa.xm) * (b.x - xb.xm)) + CASE WHEN a.j = b.j THEN {ALPHA} ELSE 0 END AS v
    FROM p2_rows r JOIN p2_rowx a USING (condition, target_time) JOIN p2_rowx b USING (condition, target_time)
    JOIN gr_xm xa ON xa.j = a.j JOIN gr_xm xb ON xb.j = b.j GROUP BY a.j, b.j""",
    "p2_rows", "p2_rowx", "gr_xm",
)
fragment(
    "gr_rhs",
    """SELECT a.j AS i, s.t, sum((a.x - xa.xm) * s.s) AS v FROM (SELECT condition, target_time, y.t, sum(y.y - m.ym) AS s FROM p2_ytrain y JOIN gr_ym m ON m.t = y.t GROUP BY ALL) s
    JOIN p2_rowx a USING (condition, target_time) JOIN gr_xm xa ON xa.j = a.j GROUP BY a.j, s.t""",
    "p2_ytrain", "gr_ym", "p2_rowx", "gr_xm",
)
fragment(
    "gr_aug",
    """SELECT (SELECT count(*) FROM gr_xm) AS p, list(row ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY side, c) AS row FROM (
      SELECT i, 0 AS side, j AS c, v FROM gr_gram UNION ALL SELECT i, 1, (SELECT count(*) FROM gr_ym y2 WHERE y2.t < r.t) + 1, v FROM gr_rhs r) GROUP BY i)""",
    "gr_gram", "gr_rhs", "gr_ym", "gr_xm",
)
gauss_jordan("gr", "gr_aug")
fragment(
    "gr_coef",
    "SELECT y.t, x.j, s.m[x.j][s.p + y.at] AS coef FROM gr_solved s, gr_xm x, (SELECT t, row_number() OVER (ORDER BY t) AS at FROM gr_ym) y",
    "gr_solved", "gr_xm", "gr_ym",
)
fragment(
    "gr_score",
    """SELECT k.condition, k.target_time, c.t, any_value(m.ym) + sum((k.x - x.xm) * c.coef) AS y_pred FROM p2_rowx k JOIN gr_coef c USING (j) JOIN gr_xm x USING (j) JOIN gr_ym m ON m.t = c.t GROUP BY ALL""",
    "p2_rowx", "gr_coef", "gr_xm", "gr_ym",
)


@query(
    "group_ridge_scores",
    with_query(
        f"SELECT split, {SCORES} FROM (SELECT y.split, y.y AS t, s.y_pred AS p FROM p2_y y JOIN gr_score s ON s.condition = y.condition AND s.target_time = y.target_time AND s.t = y.t) GROUP BY split",
        "p2_y", "gr_score",
    ),
)
def group_ridge_scores(spark, sf):
    cells = Ridge(order_forecast(spark, sf), ALPHA).predict()
    return _round(evaluate.grouped_scores(cells, ["split"]).drop("_defined"), *SCORE_NAMES)
