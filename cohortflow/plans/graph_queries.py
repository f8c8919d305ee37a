"""Graph, pathway, embedding and arm queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortflow.functions.numeric import rounded
from cohortflow.operators import arms, graph, validate
from cohortflow.plans.proxies import order_cells, order_forecast, table
from cohortflow.plans.registry import query
from cohortflow.plans.runs import Prior, prior_arms
from cohortflow.plans.sql import fragment, r6, with_query
from cohortflow.session import dealt, stage


def _round(df, *names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


# Supply graph: directed part -> supplier edges and undirected customer - supplier edges.
fragment(
    "g_edges",
    """SELECT 'part' AS sm, l_partkey::VARCHAR AS s, 'supplier' AS tm, l_suppkey::VARCHAR AS t, 'gene_regulation' AS edge_type, true AS directed, round(avg(l_discount) * 10, 6) AS score
      FROM lineitem GROUP BY l_partkey, l_suppkey
    UNION ALL SELECT 'customer', o_custkey::VARCHAR, 'supplier', l_suppkey::VARCHAR, 'functional_association', false, round(avg(l_tax) * 10, 6)
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
)
fragment(
    "g_weights",
    """SELECT i, j, sum(score) AS weight FROM (SELECT sm || ':' || s AS i, tm || ':' || t AS j, score FROM g_edges UNION ALL SELECT tm || ':' || t, sm || ':' || s, score FROM g_edges)
    WHERE i <> j GROUP BY i, j""",
    "g_edges",
)


def supply_edges(spark, sf):
    lines = table(spark, sf, "lineitem")
    rows = lines.count()
    text = lambda c: F.col(c).cast("string")
    parts = dealt(lines, rows, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_discount") * 10, 6).alias("score")).select(
        F.lit("part").alias("source_modality"), text("l_partkey").alias("source_id"),
        F.lit("supplier").alias("target_modality"), text("l_suppkey").alias("target_id"),
        F.lit("gene_regulation").alias("edge_type"), F.lit(True).alias("directed"), "score",
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    met = dealt(lines, rows, "l_orderkey").join(dealt(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_tax")
    pairs = dealt(met, rows, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.round(F.avg("l_tax") * 10, 6).alias("score"))
    return parts.unionByName(
        pairs.select(
            F.lit("customer").alias("source_modality"), text("o_custkey").alias("source_id"),
            F.lit("supplier").alias("target_modality"), text("l_suppkey").alias("target_id"),
            F.lit("functional_association").alias("edge_type"), F.lit(False).alias("directed"), "score",
        )
    )


@query("graph_weights", with_query(f"SELECT i, j, {r6('weight', 'weight')} FROM g_weights", "g_weights"))
def graph_weights(spark, sf):
    return _round(graph.symmetric_weights(supply_edges(spark, sf)), "weight")


@query("degree", with_query(f"SELECT i AS node, {r6('sum(weight)', 'degree')} FROM g_weights GROUP BY i", "g_weights"))
def degree(spark, sf):
    return _round(graph.degree(graph.symmetric_weights(supply_edges(spark, sf))), "degree").withColumnRenamed("i", "node")


@query(
    "laplacian",
    with_query(f"SELECT i, j, {r6('-weight', 'value')} FROM g_weights UNION ALL SELECT i, i, {r6('sum(weight)')} FROM g_weights GROUP BY i", "g_weights"),
)
def laplacian(spark, sf):
    return _round(graph.laplacian(graph.symmetric_weights(supply_edges(spark, sf))), "value")


@query(
    "incidence_degree",
    with_query(
        """SELECT edge_type, directed, node, count(*) AS degree FROM (SELECT edge_type, directed, sm || ':' || s AS node FROM g_edges
        UNION ALL SELECT edge_type, directed, tm || ':' || t FROM g_edges) GROUP BY ALL""",
        "g_edges",
    ),
)
def incidence_degree(spark, sf):
    return graph.incidence_degree(supply_edges(spark, sf))


@query(
    "rewired_degree",
    with_query(
        """SELECT edge_type, directed, node, count(*) AS degree FROM (SELECT edge_type, directed, sm || ':' || s AS node FROM g_edges
        UNION ALL SELECT edge_type, directed, tm || ':' || t FROM g_edges) GROUP BY ALL""",
        "g_edges",
    ),
)
def rewired_degree(spark, sf):
    """Degrees of the rewired graph, which must equal those of the real one."""
    return graph.incidence_degree(graph.rewire(supply_edges(spark, sf), seed=24))


@query(
    "rewired_edges",
    with_query(
        f"""SELECT edge_type, directed, count(*) AS n_edges, {r6('sum(score)', 'score')}, {r6('max(score)', 'top')}, 0::BIGINT AS loops, true AS moved FROM
        (SELECT edge_type, directed, score FROM g_edges UNION ALL SELECT edge_type, directed, score FROM g_edges WHERE s::BIGINT % 3 = 0) GROUP BY ALL""",
        "g_edges",
    ),
)
def rewired_edges(spark, sf):
    """Rows, scores, loops and moved edges of a rewired graph with parallel edges."""
    old = stage(supply_edges(spark, sf), "supply-edges", compression=graph.PACKED)
    new = graph.rewire(old.unionByName(old.where(F.col("source_id").cast("bigint") % 3 == 0)), seed=24)
    group = ["edge_type", "directed"]
    ends = ["source_modality", "source_id", "target_modality", "target_id", *group]
    loop = (F.col("source_modality") == F.col("target_modality")) & (F.col("source_id") == F.col("target_id"))
    moved = new.select(*ends).join(old.select(*ends), ends, "left_anti").select(*group).distinct().withColumn("moved", F.lit(True))
    grouped = new.groupBy(*group).agg(F.count("*").alias("n_edges"), F.sum("score").alias("score"), F.max("score").alias("top"), F.count_if(loop).alias("loops"))
    return _round(grouped.join(moved, group, "left").withColumn("moved", F.coalesce("moved", F.lit(False))), "score", "top")


@query(
    "edge_mapping",
    with_query(
        """SELECT count(*) AS n_edges, count(*) FILTER (WHERE ok) AS n_mapped, count(*) FILTER (WHERE NOT ok) AS n_unmapped FROM (
          SELECT sm || ':' || s IN (SELECT k FROM f) AND tm || ':' || t IN (SELECT k FROM f) AS ok FROM g_edges,
          (SELECT 1)) """.replace("(SELECT k FROM f)", "(SELECT 'part:' || p_partkey::VARCHAR FROM part WHERE p_size > 10 UNION SELECT 'supplier:' || s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 0)"),
        "g_edges",
    ),
)
def edge_mapping(spark, sf):
    features = table(spark, sf, "part").where("p_size > 10").select(F.lit("part").alias("modality"), F.col("p_partkey").cast("string").alias("feature")).union(
        table(spark, sf, "supplier").where("s_acctbal > 0").select(F.lit("supplier"), F.col("s_suppkey").cast("string"))
    )
    return graph.mapping_counts(supply_edges(spark, sf), features)


@query(
    "quadratic_form",
    f"""WITH e AS (SELECT a.vec_id AS i, b.vec_id AS j, 1.0 / (1 + a.label) AS w, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT {r6('sum(2 * w * list_sum(list_transform(list_zip(x, y), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))', 'quadratic_form', 4)} FROM e""",
)
def quadratic_form(spark, sf):
    vectors = table(spark, sf, "embeddings")
    nodes = vectors.select(F.col("vec_id").cast("string").alias("id"), (F.col("vec_id") + 1).cast("string").alias("next"), "label")
    edges = nodes.join(vectors.select(F.col("vec_id").cast("string").alias("next")), "next").select(
        F.lit("v").alias("source_modality"), F.col("id").alias("source_id"), F.lit("v").alias("target_modality"), F.col("next").alias("target_id"),
        F.lit("functional_association").alias("edge_type"), F.lit(False).alias("directed"), (1.0 / (1 + F.col("label"))).alias("score"),
    )
    states = vectors.select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("node"), F.col("embedding").cast("array<double>").alias("state"))
    out = graph.quadratic_form(graph.symmetric_weights(edges), states)
    return out.withColumn("quadratic_form", rounded(F.col("quadratic_form"), 4))


@query(
    "val_edges",
    """SELECT p_partkey AS id, reason FROM (SELECT p_partkey, CASE WHEN score NOT BETWEEN 0 AND 1 THEN 'score_out_of_range'
        WHEN contains(nm, 'string') AND kind = 'physical_ppi' THEN 'functional_source_as_physical'
        WHEN contains(nm, 'string') AND kind = 'gene_regulation' THEN 'functional_source_as_regulation'
        WHEN kind IN ('gene_regulation', 'gene_protein_coding') AND NOT directed THEN 'directed_type_undirected'
        WHEN kind IN ('physical_ppi', 'functional_association', 'pathway_comembership') AND directed THEN 'undirected_type_directed' END AS reason
      FROM (SELECT p_partkey, p_size / 40.0 AS score, replace(lower(CASE WHEN p_brand < 'Brand#15' THEN ' String DB' ELSE p_brand END), ' ', '') AS nm,
        CASE p_type WHEN 'ECONOMY' THEN 'physical_ppi' WHEN 'STANDARD' THEN 'gene_regulation' WHEN 'PROMO' THEN 'gene_protein_coding' ELSE 'functional_association' END AS kind,
        p_retailprice > 950 AS directed FROM part)) WHERE reason IS NOT NULL""",
)
def val_edges(spark, sf):
    kind = F.when(F.col("p_type") == "ECONOMY", "physical_ppi").when(F.col("p_type") == "STANDARD", "gene_regulation").when(F.col("p_type") == "PROMO", "gene_protein_coding").otherwise("functional_association")
    edges = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") / 40.0).alias("score"),
        F.when(F.col("p_brand") < "Brand#15", " String DB").otherwise(F.col("p_brand")).alias("source_name"),
        kind.alias("edge_type"), (F.col("p_retailprice") > 950).alias("directed"), F.lit(False).alias("is_causal"),
    )
    return validate.edge_violations(edges).select("id", "reason")


@query(
    "val_embeddings",
    """SELECT 'half' || (p_partkey % 2)::VARCHAR AS modality, p_partkey::VARCHAR AS feature, 'no_vector' AS reason FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'half' || (vec_id % 2)::VARCHAR, vec_id::VARCHAR, 'unknown_feature' FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'half' || (vec_id % 2)::VARCHAR, vec_id::VARCHAR, 'wrong_length' FROM embeddings WHERE label = 3""",
)
def val_embeddings(spark, sf):
    half = lambda c: F.concat(F.lit("half"), (F.col(c) % 2).cast("string")).alias("modality")
    vectors = table(spark, sf, "embeddings").select(
        half("vec_id"), F.col("vec_id").cast("string").alias("feature"),
        F.when(F.col("label") == 3, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"),
    )
    features = table(spark, sf, "part").select(half("p_partkey"), F.col("p_partkey").cast("string").alias("feature"))
    return validate.embedding_violations(vectors, features, 64)


@query(
    "feature_embeddings",
    f"""SELECT p_partkey::VARCHAR AS feature, vec_id IS NOT NULL AS mapped, {r6('coalesce(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 0)', 'total')}
    FROM part LEFT JOIN embeddings ON p_partkey = vec_id""",
)
def feature_embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.lit("vec").alias("modality"), F.col("vec_id").cast("string").alias("feature"), F.col("embedding").cast("array<double>").alias("embedding"))
    features = table(spark, sf, "part").select(F.lit("vec").alias("modality"), F.col("p_partkey").cast("string").alias("feature"))
    out = graph.feature_embeddings(features, vectors, 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)
    return out.select("feature", "mapped", rounded(total).alias("total"))


# Catalogue graph: brand -> type edges, neighbouring kept brands of a type, one pathway per type.
fragment("c_pairs", "SELECT p_brand, p_type, n::DOUBLE / max(n) OVER () AS score FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)")
fragment("c_kept", "SELECT p_brand, p_type, score FROM c_pairs", "c_pairs")


def catalogue_pairs(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.select("p_brand", "p_type", (F.col("n") / top.scalar()).alias("score"))


def catalogue_edges(spark, sf):
    kept = catalogue_pairs(spark, sf)
    directed = kept.select(
        F.lit("rna").alias("source_modality"), F.col("p_brand").alias("source_id"), F.lit("protein").alias("target_modality"), F.col("p_type").alias("target_id"),
        F.lit("gene_regulation").alias("edge_type"), F.lit(True).alias("directed"), "score",
    )
    # A type has at most one row per brand, so this window is as small as the brand list.
    following = Window.partitionBy("p_type").orderBy("p_brand")
    chain = kept.withColumns({"_n": F.lead("p_brand").over(following), "_s": F.lead("score").over(following)}).where("_n IS NOT NULL")
    return directed.unionByName(
        chain.select(
            F.lit("rna").alias("source_modality"), F.col("p_brand").alias("source_id"), F.lit("rna").alias("target_modality"), F.col("_n").alias("target_id"),
            F.lit("pathway_comembership").alias("edge_type"), F.lit(False).alias("directed"), F.least("score", "_s").alias("score"),
        )
    )


def catalogue_pathways(spark, sf):
    return catalogue_pairs(spark, sf).select(F.col("p_type").alias("pathway_id"), F.lit("rna").alias("modality"), F.col("p_brand").alias("feature"))


@query(
    "pathway_activity",
    with_query(
        f"""SELECT o.observation_id, p.pathway_id, {r6('coalesce(avg(c.raw), 0)', 'activity')}, count(c.raw) > 0 AS mask
        FROM (SELECT DISTINCT observation_id FROM p2_cells WHERE modality = 'rna') o CROSS JOIN (SELECT DISTINCT p_type AS pathway_id FROM c_kept) p
        LEFT JOIN (SELECT x.observation_id, k.p_type, x.raw FROM p2_cells x JOIN c_kept k ON x.feature = k.p_brand AND x.modality = 'rna') c
          ON c.observation_id = o.observation_id AND c.p_type = p.pathway_id GROUP BY o.observation_id, p.pathway_id""",
        "p2_cells", "c_kept",
    ),
)
def pathway_activity(spark, sf):
    pathways = stage(catalogue_pathways(spark, sf), "pathways")  # written, so that its size is known and the cells need not move to meet it
    return _round(graph.pathway_activity(order_cells(spark, sf, ("rna",)), pathways, ["observation_id"], "raw"), "activity")


RUNS_SQL = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'no_prior' WHEN '2-HIGH' THEN 'graph_only' WHEN '3-MEDIUM' THEN 'embedding_only' WHEN '4-NOT SPECIFIED' THEN 'combined' ELSE 'random_graph' END AS arm,
  (CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995 THEN -1 ELSE 1 END * year(o_orderdate))::BIGINT AS seed, avg(o_totalprice) / 1e5 AS mse, stddev_pop(o_totalprice) / 1e5 AS mae,
  avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS pcc_macro FROM orders GROUP BY ALL"""


def _runs(spark, sf):
    """Priorities as arms and years as seeds. The baseline's runs of 1995 have a seed of their own, so that both are unpaired."""
    p, year = F.col("o_orderpriority"), F.year("o_orderdate")
    arm = F.when(p == "1-URGENT", "no_prior").when(p == "2-HIGH", "graph_only").when(p == "3-MEDIUM", "embedding_only").when(p == "4-NOT SPECIFIED", "combined").otherwise("random_graph")
    seed = F.when((p == "1-URGENT") & (year == 1995), -year).otherwise(year)
    return table(spark, sf, "orders").groupBy(arm.alias("arm"), seed.cast("bigint").alias("seed")).agg(
        (F.avg("o_totalprice") / 1e5).alias("mse"), (F.stddev_pop("o_totalprice") / 1e5).alias("mae"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("pcc_macro"),
    )


@query(
    "arm_deltas",
    f"""WITH r AS ({RUNS_SQL}) SELECT r.arm, r.seed, {r6('r.mse - b.mse', 'delta_mse')}, {r6('r.pcc_macro - b.pcc_macro', 'delta_pcc')}
    FROM r JOIN r b ON b.seed = r.seed AND b.arm = 'no_prior'""",
)
def arm_deltas(spark, sf):
    return _round(arms.paired_deltas(_runs(spark, sf)), "delta_mse", "delta_pcc")


def _ci_sql(col: str, name: str) -> str:
    half = f"coalesce(1.96 * stddev_samp({col}) / sqrt(count({col})), 0)"
    return f"{r6(f'avg({col})', name + '_mean')}, {r6(f'avg({col}) - {half}', name + '_low')}, {r6(f'avg({col}) + {half}', name + '_high')}, count({col}) AS {name}_n"


@query(
    "arm_summary",
    f"""WITH r AS ({RUNS_SQL}), d AS (SELECT r.*, r.mse - b.mse AS dm, r.pcc_macro - b.pcc_macro AS dp FROM r LEFT JOIN r b ON b.seed = r.seed AND b.arm = 'no_prior')
    SELECT arm, count(*) AS n_seeds, {_ci_sql('mse', 'mse')}, {_ci_sql('mae', 'mae')}, {_ci_sql('pcc_macro', 'pcc_macro')}, {_ci_sql('dm', 'delta_mse')}, {_ci_sql('dp', 'delta_pcc')},
      CASE arm WHEN 'no_prior' THEN 0 WHEN 'graph_only' THEN 1 WHEN 'embedding_only' THEN 2 WHEN 'combined' THEN 3 ELSE 4 END AS arm_rank FROM d GROUP BY arm""",
)
def arm_summary(spark, sf):
    out = arms.arm_summary(_runs(spark, sf))
    return _round(out, *[f"{m}_{part}" for m in ("mse", "mae", "pcc_macro", "delta_mse", "delta_pcc") for part in ("mean", "low", "high")])


@query(
    "arm_graph_note",
    f"""WITH r AS ({RUNS_SQL}) SELECT {r6("avg(mse) FILTER (WHERE arm = 'graph_only')", 'graph_mse')}, {r6("avg(mse) FILTER (WHERE arm = 'random_graph')", 'random_mse')},
      abs(avg(mse) FILTER (WHERE arm = 'graph_only') - avg(mse) FILTER (WHERE arm = 'random_graph')) < 0.02 AS no_gain_claim FROM r""",
)
def arm_graph_note(spark, sf):
    return _round(arms.graph_note(arms.arm_summary(_runs(spark, sf))), "graph_mse", "random_mse")


ARM_SEEDS = [20260901, 20260902, 20260903]


def catalogue_prior(spark, sf, names):
    """One vector per feature: the mean embedding of the label its position maps to."""
    labels = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = labels.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("e")).select("label", F.col("e.v").alias("embedding"))
    index = names.table.select(F.substring_index("name", ":", 1).alias("modality"), F.expr("substr(name, instr(name, ':') + 1)").alias("feature"), (F.col("at") % 10).alias("label"))
    return Prior(catalogue_edges(spark, sf), catalogue_pathways(spark, sf), mean.join(index, "label").drop("label"), 64)


@query("arm_runs")
def arm_runs(spark, sf):
    """Five prior arms x seeds on the order study: same split, evaluator and parameters."""
    data = order_forecast(spark, sf)
    runs = prior_arms(data, catalogue_prior(spark, sf, data.names), ARM_SEEDS)
    return _round(runs, "mse", "mae", "pcc_macro", "primary_value")
