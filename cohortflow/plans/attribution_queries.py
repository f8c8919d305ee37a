"""Attribution, perturbation and stability queries on the event ridge model."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions.numeric import rounded
from cohortflow.operators import attribution
from cohortflow.plans.model_queries import ALPHA
from cohortflow.plans.proxies import EVENT_ASSAY, event_cells, event_forecast, table
from cohortflow.plans.registry import query
from cohortflow.plans.runs import Explained, Prior, Ridge
from cohortflow.plans.sql import fragment, r6, with_query
from cohortflow.session import stage

STABILITY_SEED, PERM_SEED, N_SEEDS = 13, 17, 3
CONFIG = attribution.StabilityConfig(top_k_per_target=3)


def _round(df, *names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def explained(spark, sf):
    return Explained(Ridge(event_forecast(spark, sf), ALPHA), CONFIG, N_SEEDS, PERM_SEED)


# Only instances with an observed target are scored, so the design rows follow the targets.
fragment("ex_val", "SELECT DISTINCT instance_id, group_id, condition FROM p1_targets WHERE split = 'val'", "p1_targets")
fragment("ex_coef", "SELECT n.name AS source, c.t AS target, c.coef, c.j FROM rg_coef c JOIN p1_names n USING (j)", "rg_coef", "p1_names")
fragment(
    "ex_base",
    """SELECT c.modality || ':' || c.feature AS source, avg(c.scaled) AS base FROM (SELECT DISTINCT instance_id, history_observation FROM p1_targets WHERE split = 'train') i
    JOIN p1_scaled c ON c.observation_id = i.history_observation AND c.scaled IS NOT NULL GROUP BY 1""",
    "p1_targets", "p1_scaled",
)
fragment(
    "ex_attr",
    """SELECT v.instance_id, v.group_id, c.source, c.target, b.baseline, c.coef * CASE b.baseline WHEN 'zeros' THEN d.x WHEN 'train_mean' THEN d.x - coalesce(m.base, 0) ELSE 0 END AS value
    FROM ex_val v JOIN p1_design_all d ON d.id = v.instance_id JOIN ex_coef c ON c.j = d.j LEFT JOIN ex_base m ON m.source = c.source
    CROSS JOIN (SELECT unnest(['zeros', 'train_mean', 'last_observation']) AS baseline) b""",
    "ex_val", "p1_design_all", "ex_coef", "ex_base",
)


@query("ig_linear", with_query(f"SELECT instance_id, group_id, source, target, baseline, {r6('value', 'value')} FROM ex_attr", "ex_attr"))
def ig_linear(spark, sf):
    return _round(explained(spark, sf).attributions(), "value")


fragment(
    "ex_abl",
    """SELECT c.source, c.target, avg(abs(c.coef * d.x)) AS ablation_delta FROM ex_val v JOIN p1_design_all d ON d.id = v.instance_id JOIN ex_coef c ON c.j = d.j GROUP BY ALL""",
    "ex_val", "p1_design_all", "ex_coef",
)


@query("ablation_delta", with_query(f"SELECT source, target, {r6('ablation_delta', 'ablation_delta')} FROM ex_abl", "ex_abl"))
def ablation_delta(spark, sf):
    return _round(explained(spark, sf).ablation(), "ablation_delta")


fragment(
    "ex_pairs",
    f"""SELECT s.seed, a.instance_id, b.instance_id AS partner_id FROM (SELECT instance_id, condition, row_number() OVER (PARTITION BY condition ORDER BY md5(instance_id), instance_id) AS pos FROM ex_val) a
    JOIN (SELECT seed, instance_id, condition, row_number() OVER (PARTITION BY condition, seed ORDER BY md5('{PERM_SEED}:' || seed::VARCHAR || ':' || instance_id), instance_id) AS pos
      FROM ex_val CROSS JOIN (SELECT unnest(range({N_SEEDS})) AS seed)) b USING (condition, pos) JOIN (SELECT unnest(range({N_SEEDS})) AS seed) s ON s.seed = b.seed""",
    "ex_val",
)
fragment(
    "ex_perm",
    """SELECT source, target, avg(delta) AS permutation_delta FROM (
      SELECT c.source, c.target, p.seed, avg((t.y_pred + c.coef * (dx.x - d.x) - t.y_true) ** 2) - avg((t.y_pred - t.y_true) ** 2) AS delta
      FROM rg_pred t JOIN ex_pairs p ON p.instance_id = t.instance_id JOIN ex_coef c ON c.target = t.feature
      JOIN p1_design_all d ON d.id = p.instance_id AND d.j = c.j JOIN p1_design_all dx ON dx.id = p.partner_id AND dx.j = c.j
      WHERE t.split = 'val' GROUP BY c.source, c.target, p.seed) GROUP BY source, target""",
    "rg_pred", "ex_pairs", "ex_coef", "p1_design_all",
)


@query("permutation_delta", with_query(f"SELECT source, target, {r6('permutation_delta', 'permutation_delta')} FROM ex_perm", "ex_perm"))
def permutation_delta(spark, sf):
    return _round(explained(spark, sf).permutation(), "permutation_delta")


fragment("st_mean", "SELECT source, target, avg(value) AS mean_attribution FROM ex_attr GROUP BY ALL", "ex_attr")
fragment("st_units", "SELECT group_id, row_number() OVER (ORDER BY md5(group_id), group_id) - 1 AS idx, row_number() OVER (ORDER BY group_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM ex_val)", "ex_val")
fragment(
    "st_boot",
    f"""SELECT d.replicate, a.source, a.target, avg(a.value) AS value FROM (
      SELECT r.replicate, u.group_id FROM (SELECT r.replicate, ('0x' || substr(md5('{STABILITY_SEED}:' || r.replicate::VARCHAR || ':' || idx::VARCHAR), 1, 15))::BIGINT % n AS pick
        FROM st_units, (SELECT unnest(range({CONFIG.n_bootstrap})) AS replicate) r) r JOIN st_units u ON u.idx = r.pick) d
    JOIN ex_attr a USING (group_id) GROUP BY ALL""",
    "st_units", "ex_attr",
)
fragment(
    "st_fold",
    f"""SELECT f.fold, a.source, a.target, avg(a.value) AS value FROM (SELECT group_id, ntile({CONFIG.n_folds}) OVER (ORDER BY group_id) AS fold FROM st_units) f JOIN ex_attr a USING (group_id) GROUP BY ALL""",
    "st_units", "ex_attr",
)
_SIGN = "CASE WHEN {v} >= 1e-12 THEN 1 WHEN {v} <= -1e-12 THEN -1 ELSE 0 END"
fragment(
    "st_table",
    f"""SELECT *, 0.5 * sign_consistency + 0.5 * selection_frequency AS stability FROM (
      SELECT m.source, m.target, m.mean_attribution, 0.5 * b.sb + 0.5 * f.sf AS sign_consistency, b.rank_median, b.selection_frequency, b.bootstrap_low, b.bootstrap_high, x.ablation_delta, p.permutation_delta
      FROM st_mean m JOIN (SELECT k.source, k.target, avg(CASE WHEN {_SIGN.format(v='k.value')} = {_SIGN.format(v='m.mean_attribution')} OR {_SIGN.format(v='m.mean_attribution')} = 0 THEN 1.0 ELSE 0.0 END) AS sb,
          median(k.rk) AS rank_median, avg(CASE WHEN k.rk <= {CONFIG.top_k_per_target} THEN 1.0 ELSE 0.0 END) AS selection_frequency, quantile_cont(k.value, 0.025) AS bootstrap_low, quantile_cont(k.value, 0.975) AS bootstrap_high
        FROM (SELECT *, row_number() OVER (PARTITION BY replicate, target ORDER BY abs(value) DESC, source) AS rk FROM st_boot) k JOIN st_mean m USING (source, target) GROUP BY ALL) b USING (source, target)
      JOIN (SELECT k.source, k.target, avg(CASE WHEN {_SIGN.format(v='k.value')} = {_SIGN.format(v='m.mean_attribution')} OR {_SIGN.format(v='m.mean_attribution')} = 0 THEN 1.0 ELSE 0.0 END) AS sf FROM st_fold k JOIN st_mean m USING (source, target) GROUP BY ALL) f USING (source, target)
      LEFT JOIN ex_abl x USING (source, target) LEFT JOIN ex_perm p USING (source, target))""",
    "st_mean", "st_boot", "st_fold", "ex_abl", "ex_perm",
)
ST_NUMBERS = ["mean_attribution", "sign_consistency", "rank_median", "selection_frequency", "bootstrap_low", "bootstrap_high", "ablation_delta", "permutation_delta", "stability"]
_PASS = f"(sign_consistency >= {CONFIG.min_sign_consistency} AND selection_frequency >= {CONFIG.min_selection_frequency} AND stability >= {CONFIG.min_stability})"
_DIRECTION = "CASE WHEN mean_attribution > 1e-12 THEN 'up' WHEN mean_attribution < -1e-12 THEN 'down' ELSE 'unknown' END"


@query(
    "stability_table",
    with_query(
        f"""SELECT source || '->protein:' || target AS candidate_id, source, 'protein:' || target AS target, split_part(source, ':', 1) AS source_modality, split_part(source, ':', 2) AS source_id,
          'protein' AS target_modality, target AS target_id, {', '.join(r6(n, n) for n in ST_NUMBERS)}, {_PASS} AS passed_stability, {_DIRECTION} AS predicted_direction,
          'hypothesis' AS claim_kind, '{attribution.CAVEAT}' AS caveat FROM st_table""",
        "st_table",
    ),
)
def stability_table(spark, sf):
    return _round(attribution.ordered_candidates(explained(spark, sf).stability(seed=STABILITY_SEED)), *ST_NUMBERS)


@query(
    "stable_top_n",
    with_query(f"SELECT source || '->protein:' || target AS candidate_id, {r6('stability', 'stability')}, {_DIRECTION} AS predicted_direction FROM st_table WHERE {_PASS} ORDER BY st_table.stability DESC, abs(mean_attribution) DESC, source || '->' || target LIMIT 4", "st_table"),
)
def stable_top_n(spark, sf):
    top = attribution.select_stable(explained(spark, sf).stability(seed=STABILITY_SEED), 4)
    return _round(top.select("candidate_id", "stability", "predicted_direction"), "stability")


def event_prior(spark, sf):
    """Edges between the types of consecutive events, vectors of mean values, two pathway families."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    following = events.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("next_type"))
    # One pass over the pairs and one over the events; what is kept of them is a row a type or a pair of types.
    counts = stage(events.join(following, "event_id").where("event_type <> next_type").groupBy("event_type", "next_type").agg(F.count("*").alias("n")), "prior-counts")
    types = stage(events.groupBy("event_type").agg(F.avg("value").alias("v")), "prior-types")
    top = counts.agg(F.max("n").alias("top"))
    assay = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in EVENT_ASSAY.items()])
    edges = counts.withColumn("top", top.scalar()).select(
        assay("event_type").alias("source_modality"), F.col("event_type").alias("source_id"), assay("next_type").alias("target_modality"), F.col("next_type").alias("target_id"),
        F.lit("functional_association").alias("edge_type"), F.lit(False).alias("directed"), (F.col("n") / F.col("top")).alias("score"),
    )
    vectors = types.select(
        assay("event_type").alias("modality"), F.col("event_type").alias("feature"),
        F.array(F.lit(0.0), F.when(F.col("event_type") == "signup", 0.0).otherwise(F.col("v"))).alias("embedding"),
    )
    pathways = types.where("event_type IN ('click', 'view')").select(F.lit("PW1").alias("pathway_id"), F.lit("rna").alias("modality"), F.col("event_type").alias("feature")).union(
        types.where("event_type = 'purchase'").select(F.lit("PW1-PROT"), F.lit("protein"), "event_type")
    )
    return Prior(edges, pathways, vectors, 2)


FLAGS_SQL = """WITH n AS (SELECT DISTINCT CASE WHEN event_type IN ('purchase','error') THEN 'protein:' ELSE 'rna:' END || event_type AS node, event_type FROM events),
      e AS (SELECT a.event_type AS s, b.event_type AS t, count(*)::DOUBLE / max(count(*)) OVER () AS score FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type <> b.event_type GROUP BY ALL),
      k AS (SELECT s, t FROM e),
      c AS (SELECT a.node AS source, b.node AS target, a.event_type AS s, b.event_type AS t FROM n a CROSS JOIN n b WHERE b.event_type IN ('purchase', 'error')),
      f AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE (k.s = c.s AND k.t = c.t) OR (k.s = c.t AND k.t = c.s)) OR (c.s IN ('click','view','purchase') AND c.t IN ('click','view','purchase')) AS edge FROM c)
    SELECT source, target, edge AS prior_edge_used, NOT edge AS de_novo_model_edge, s <> 'signup' AND t <> 'signup' AS embedding_supported FROM f"""


@query("prior_flags", FLAGS_SQL)
def prior_flags(spark, sf):
    prior = event_prior(spark, sf)
    cells = event_cells(spark, sf)
    sources = cells.select(F.concat_ws(":", "modality", "feature").alias("source")).distinct()
    targets = cells.where("modality = 'protein'").agg(F.array_sort(F.collect_set(F.concat_ws(":", "modality", "feature"))).alias("t"))
    candidates = sources.select("source", F.explode(targets.scalar()).alias("target"))
    return attribution.prior_flags(candidates, prior.edges, prior.pathways, prior.embeddings)


fragment("pf_flags", FLAGS_SQL)


@query(
    "candidates",
    with_query(
        f"""SELECT t.source || '->protein:' || t.target AS candidate_id, split_part(t.source, ':', 1) AS source_modality, split_part(t.source, ':', 2) AS source_id, 'protein' AS target_modality, t.target AS target_id,
          {', '.join(r6('t.' + n, n) for n in ST_NUMBERS)}, f.prior_edge_used, f.embedding_supported, f.de_novo_model_edge, {_PASS} AS passed_stability, {_DIRECTION} AS predicted_direction,
          'hypothesis' AS claim_kind, '{attribution.CAVEAT}' AS caveat FROM st_table t JOIN pf_flags f ON f.source = t.source AND f.target = 'protein:' || t.target""",
        "st_table", "pf_flags",
    ),
)
def candidates(spark, sf):
    """The full candidate table: stability, perturbation and prior flags."""
    table_ = explained(spark, sf).candidates(event_prior(spark, sf), seed=STABILITY_SEED)
    return _round(table_.drop("source", "target"), *ST_NUMBERS)
