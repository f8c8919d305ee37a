"""Validation, alignment, normalisation, split, forecast and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions.numeric import rounded
from cohortflow.operators import align, evaluate, forecast, idmap, normalize, qc, resample, split, validate
from cohortflow.plans.proxies import SEED, event_cells, event_forecast, event_observations, event_sheet, event_study, order_cells, order_study, table
from cohortflow.plans.registry import query
from cohortflow.plans.runs import LastValue
from cohortflow.plans.sql import fragment, metric_sql, r6, with_query
from cohortflow.session import stage

M = metric_sql()


def _round(df, *names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


@query(
    "val_unique_key",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def val_unique_key(spark, sf):
    dup = validate.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return dup.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query(
    "val_na_tokens",
    """SELECT p_partkey::VARCHAR AS part_id, field, value FROM (
      SELECT p_partkey, 'second_word' AS field, split_part(p_name, ' ', 3) AS value FROM part
      UNION ALL SELECT p_partkey, 'brand', CASE WHEN p_brand = 'Brand#7' THEN ' NA ' ELSE p_brand END FROM part
      UNION ALL SELECT p_partkey, 'type', p_type FROM part)
    WHERE trim(value) IN ('', 'NA', 'NaN', 'nan', 'None', 'null', '.') OR value IS NULL""",
)
def val_na_tokens(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("part_id"),
        F.split_part("p_name", F.lit(" "), F.lit(3)).alias("second_word"),
        F.when(F.col("p_brand") == "Brand#7", " NA ").otherwise(F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("type"),
    )
    return validate.na_tokens(parts, "part_id", ["second_word", "brand", "type"])


@query(
    "val_identity_key",
    with_query(
        """SELECT unit, time, modality, count(*) AS n FROM (SELECT DISTINCT unit, time, modality, feature FROM p1_cells)
        GROUP BY ALL HAVING count(*) > 1""",
        "p1_cells",
    ),
)
def val_identity_key(spark, sf):
    cells = event_cells(spark, sf).select(F.col("experimental_unit_id").alias("unit"), "time", "modality", "feature").distinct()
    return validate.duplicate_keys(cells, ["unit", "time", "modality"])


@query(
    "val_declared_modality",
    "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')",
)
def val_declared_modality(spark, sf):
    declared = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    return validate.undeclared(table(spark, sf, "events").select("event_id", "event_type"), "event_type", declared)


@query(
    "val_times_per_unit",
    with_query(
        """SELECT unit, n_times, n_subjects, reason FROM (
          SELECT unit, count(DISTINCT time) AS n_times, count(DISTINCT unit) AS n_subjects, 'several_times' AS reason FROM p1_cells GROUP BY unit)
        WHERE n_times > 1
        UNION ALL SELECT unit, count(DISTINCT time), count(DISTINCT unit), 'one_time' FROM p1_cells GROUP BY unit HAVING count(DISTINCT time) < 2""",
        "p1_cells",
    ),
)
def val_times_per_unit(spark, sf):
    sheet = event_sheet(event_cells(spark, sf))
    bad = validate.cross_section_violations(sheet)
    short = validate.longitudinal_violations(sheet).withColumn("reason", F.lit("one_time"))
    return bad.unionByName(short).withColumnRenamed("experimental_unit_id", "unit")


@query(
    "val_cross_section_units",
    """SELECT o_custkey::VARCHAR AS unit, count(DISTINCT year(o_orderdate)) AS n_times, count(DISTINCT o_orderstatus) AS n_subjects,
      CASE WHEN count(DISTINCT year(o_orderdate)) > 1 THEN 'several_times' ELSE 'several_subjects' END AS reason
    FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) > 1 OR count(DISTINCT o_orderstatus) > 1""",
)
def val_cross_section_units(spark, sf):
    sheet = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("experimental_unit_id"),
        F.year("o_orderdate").cast("double").alias("time"), F.col("o_orderstatus").alias("subject_id"),
    )
    return validate.cross_section_violations(sheet).withColumnRenamed("experimental_unit_id", "unit")


@query(
    "val_fd_observation",
    """WITH s AS (SELECT o_orderkey::VARCHAR AS observation_id, l_suppkey, l_returnflag, year(l_shipdate)::DOUBLE AS time, l_linestatus
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT observation_id, 'experimental_unit_id' AS field, 'error' AS severity FROM s GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1
    UNION ALL SELECT observation_id, 'time', 'error' FROM s GROUP BY 1 HAVING count(DISTINCT time) > 1
    UNION ALL SELECT observation_id, 'condition', 'warning' FROM s GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1
    UNION ALL SELECT observation_id, 'batch', 'warning' FROM s GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1""",
)
def val_fd_observation(spark, sf):
    sheet = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("observation_id"), F.col("l_suppkey").alias("experimental_unit_id"),
        F.year("l_shipdate").cast("double").alias("time"), F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("batch"),
    )
    return validate.observation_conflicts(sheet, strict=("experimental_unit_id", "time"))


@query(
    "val_confound",
    with_query(
        """SELECT count(DISTINCT time) AS n_times, count(DISTINCT batch) AS n_batches, count(DISTINCT (time, batch)) AS n_pairs,
          (count(DISTINCT time) > 1 AND count(DISTINCT batch) = count(DISTINCT time) AND count(DISTINCT (time, batch)) = count(DISTINCT time)) AS confounded
        FROM p2_meta""",
        "p2_meta",
    ),
)
def val_confound(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    obs = (
        t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.year("o_orderdate").cast("double").alias("time"), F.col("r_name").alias("batch"))
    )
    return split.time_batch_confound(obs)


@query(
    "val_assay_values",
    """SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'zero_before_log2' END AS reason FROM customer
    WHERE c_acctbal <= 0""",
)
def val_assay_values(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("balance").alias("modality"), F.col("c_acctbal").alias("raw"))
    return validate.assay_value_violations(cells, [], ["balance"], [], zeros_are_missing=False).select("id", "reason")


@query(
    "val_unfillable_features",
    with_query(
        """SELECT modality, feature, count(normalized) FILTER (WHERE split = 'train' AND condition = 'MACHINERY' AND time = 2001 AND batch = 'ASIA') AS n_train
        FROM p2_norm GROUP BY ALL HAVING n_train = 0
        UNION ALL SELECT 'orders' AS modality, o_custkey::VARCHAR AS feature, count(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS n_train FROM orders GROUP BY ALL HAVING n_train = 0""",
        "p2_norm",
    ),
)
def val_unfillable_features(spark, sf):
    """Features of the order study when one stratum trains, and customers when finished orders do, that have no fill value."""
    stratum = (F.col("condition") == "MACHINERY") & (F.col("time") == 2001) & (F.col("batch") == "ASIA")
    thin = order_study(spark, sf).cells.withColumn("split", F.when(stratum, F.col("split")))
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    cells = table(spark, sf, "orders").select(F.lit("orders").alias("modality"), F.col("o_custkey").cast("string").alias("feature"), split.alias("split"), F.col("o_totalprice").alias("scaled"))
    return validate.unfillable_features(thin, "normalized").unionByName(validate.unfillable_features(cells))


@query(
    "val_manifest_rules",
    """WITH m AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'required' ELSE 'rejected' END AS status,
        (s_suppkey % 2)::BIGINT AS n_unresolved, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS taxon_id,
        CASE s_suppkey % 5 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'repeated_cross_sectional' ELSE 'longitudinal' END AS sampling_design,
        CASE s_suppkey % 7 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'group_level_only' ELSE 'same_biospecimen' END AS pairing_level,
        s_suppkey % 4 = 1 AS paired, CASE WHEN s_suppkey % 11 < 6 THEN s_suppkey % 2 = 0 END AS flag,
        CASE WHEN s_suppkey % 2 = 1 THEN 'donor' ELSE 'experimental_unit' END AS unit FROM supplier)
    SELECT id, 'review' AS rule, CASE WHEN status='approved' AND n_unresolved>0 THEN 'approved_with_open_items'
        WHEN status='required' AND n_unresolved=0 THEN 'required_without_items'
        WHEN status='approved' AND taxon_id IS NULL THEN 'approved_without_taxon'
        WHEN status='approved' AND sampling_design='undeclared' THEN 'approved_without_design'
        WHEN status='approved' AND pairing_level='undeclared' THEN 'approved_without_pairing'
        WHEN status='rejected' THEN 'rejected' ELSE 'needs_review' END AS reason
      FROM m WHERE NOT (status='approved' AND n_unresolved=0 AND taxon_id IS NOT NULL AND sampling_design<>'undeclared' AND pairing_level<>'undeclared')
    UNION ALL SELECT * FROM (SELECT id, 'design', CASE WHEN sampling_design='undeclared' AND flag IS NOT NULL THEN 'undeclared_design_with_flag'
        WHEN sampling_design<>'undeclared' AND flag IS NOT NULL AND flag <> (sampling_design='longitudinal') THEN 'flag_disagrees'
        WHEN sampling_design='repeated_cross_sectional' AND unit='donor' THEN 'cross_section_of_donors'
        WHEN sampling_design<>'undeclared' AND pairing_level='group_level_only' AND paired THEN 'group_level_marked_paired' END AS reason FROM m) WHERE reason IS NOT NULL""",
)
def val_manifest_rules(spark, sf):
    k = F.col("s_suppkey")
    manifests = table(spark, sf, "supplier").select(
        k.alias("id"),
        F.when(k % 3 == 0, "approved").when(k % 3 == 1, "required").otherwise("rejected").alias("status"),
        (k % 2).alias("n_unresolved"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("taxon_id"),
        F.when(k % 5 == 0, "undeclared").when(k % 5 == 1, "repeated_cross_sectional").otherwise("longitudinal").alias("sampling_design"),
        F.when(k % 7 == 0, "undeclared").when(k % 7 == 1, "group_level_only").otherwise("same_biospecimen").alias("pairing_level"),
        (k % 4 == 1).alias("paired_modalities"), F.when(k % 11 < 6, k % 2 == 0).alias("longitudinal"),
        F.when(k % 2 == 1, "donor").otherwise("experimental_unit").alias("unit_of_independence"),
    )
    review = validate.review_violations(manifests).select("id", F.lit("review").alias("rule"), "reason")
    return review.unionByName(validate.design_violations(manifests).select("id", F.lit("design").alias("rule"), "reason"))


@query(
    "val_task_rules",
    """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'subject_forecast' ELSE 'group_time_forecast' END AS kind,
        CASE o_orderkey % 5 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'repeated_cross_sectional' ELSE 'longitudinal' END AS design,
        CASE o_orderkey % 7 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'group_level_only' ELSE 'same_biospecimen' END AS pairing,
        o_orderstatus = 'P' AS unknown, o_totalprice > 200000 AS has_min, o_orderpriority < '3' AS two_inputs FROM orders)
    SELECT id, reason FROM (SELECT id, CASE WHEN unknown THEN 'unknown_modality' WHEN design='undeclared' OR pairing='undeclared' THEN 'undeclared_design'
        WHEN kind='subject_forecast' AND design<>'longitudinal' THEN 'subject_forecast_needs_longitudinal'
        WHEN kind='subject_forecast' AND pairing='group_level_only' AND two_inputs THEN 'group_level_feeds_several_modalities'
        WHEN kind='group_time_forecast' AND NOT has_min THEN 'group_forecast_needs_target_time_min' END AS reason FROM t) WHERE reason IS NOT NULL""",
)
def val_task_rules(spark, sf):
    k = F.col("o_orderkey")
    tasks = table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "subject_forecast").otherwise("group_time_forecast").alias("kind"),
        F.when(F.col("o_orderstatus") == "P", "lipid").otherwise("protein").alias("target_modality"),
        F.when(F.col("o_orderpriority") < "3", F.array(F.lit("rna"), F.lit("protein"))).otherwise(F.array(F.lit("rna"))).alias("input_modalities"),
        F.array(F.lit("rna"), F.lit("protein")).alias("modalities"),
        F.when(k % 5 == 0, "undeclared").when(k % 5 == 1, "repeated_cross_sectional").otherwise("longitudinal").alias("sampling_design"),
        F.when(k % 7 == 0, "undeclared").when(k % 7 == 1, "group_level_only").otherwise("same_biospecimen").alias("pairing_level"),
        F.when(F.col("o_totalprice") > 200000, 1.0).alias("target_time_min"),
    )
    return validate.task_violations(tasks).select("id", "reason")


@query(
    "observations",
    with_query("SELECT observation_id, unit, time, condition, batch, has_rna, has_protein FROM p1_obs", "p1_obs"),
)
def observations(spark, sf):
    sheet = event_sheet(event_cells(spark, sf))
    obs = align.observations(sheet, ["rna", "protein"])
    return obs.select("observation_id", F.col("experimental_unit_id").alias("unit"), "time", "condition", "batch", "has_rna", "has_protein")


@query(
    "dense_spine",
    with_query(
        f"""SELECT o.observation_id, f.modality, f.feature, {r6('c.raw', 'raw')}
        FROM p1_obs o CROSS JOIN (SELECT DISTINCT modality, feature FROM p1_cells) f
        LEFT JOIN p1_cells c ON c.observation_id = o.observation_id AND c.feature = f.feature""",
        "p1_obs", "p1_cells",
    ),
)
def dense_spine(spark, sf):
    cells = event_cells(spark, sf)
    slim = cells.select("observation_id", "modality", "feature", "raw")
    return _round(align.dense_spine(event_observations(cells), slim), "raw")


@query(
    "idmap_one_to_many",
    """WITH f AS (SELECT DISTINCT 'rna' AS modality, p_brand AS source_id FROM part UNION SELECT DISTINCT 'protein', p_type FROM part
        UNION SELECT DISTINCT 'lipid', c_mktsegment FROM customer),
      t AS (SELECT DISTINCT 'rna' AS modality, p_brand AS source_id, 'S' || p_size::VARCHAR AS target_id FROM part WHERE p_size <= 3
        UNION SELECT DISTINCT 'protein', p_type, 'R' || floor(p_retailprice / 500)::BIGINT::VARCHAR FROM part WHERE p_type <> 'ECONOMY'),
      n AS (SELECT modality, source_id, count(*) AS n FROM t GROUP BY ALL)
    SELECT f.modality, f.source_id, CASE WHEN f.modality = 'lipid' THEN f.source_id ELSE t.target_id END AS target_id,
      CASE WHEN f.modality = 'lipid' THEN 'identity' WHEN f.modality = 'rna' THEN 'size' ELSE 'price' END AS target_id_type,
      CASE WHEN f.modality = 'lipid' THEN 1 ELSE coalesce(n.n, 0) END AS n_targets,
      f.modality <> 'lipid' AND coalesce(n.n, 0) > 1 AS ambiguous, f.modality <> 'lipid' AND n.n IS NULL AS unmapped
    FROM f LEFT JOIN t USING (modality, source_id) LEFT JOIN n USING (modality, source_id)""",
)
def idmap_one_to_many(spark, sf):
    return idmap.map_features(*_id_map_inputs(spark, sf))


def _id_map_inputs(spark, sf):
    part = table(spark, sf, "part")
    features = (
        part.select(F.lit("rna").alias("modality"), F.col("p_brand").alias("source_id"))
        .union(part.select(F.lit("protein"), "p_type"))
        .union(table(spark, sf, "customer").select(F.lit("lipid"), "c_mktsegment")).distinct()
    )
    ids = part.where("p_size <= 3").select(
        F.lit("rna").alias("modality"), F.col("p_brand").alias("source_id"),
        F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("target_id"), F.lit("size").alias("target_id_type"),
    ).union(
        part.where("p_type <> 'ECONOMY'").select(
            F.lit("protein"), "p_type", F.concat(F.lit("R"), F.floor(F.col("p_retailprice") / 500).cast("string")), F.lit("price")
        )
    )
    return features, ids


@query(
    "idmap_summary",
    """WITH f AS (SELECT DISTINCT 'rna' AS modality, p_brand AS source_id FROM part UNION SELECT DISTINCT 'protein', p_type FROM part
        UNION SELECT DISTINCT 'lipid', c_mktsegment FROM customer),
      t AS (SELECT DISTINCT 'rna' AS modality, p_brand AS source_id, 'S' || p_size::VARCHAR AS target_id FROM part WHERE p_size <= 3
        UNION SELECT DISTINCT 'protein', p_type, 'R' || floor(p_retailprice / 500)::BIGINT::VARCHAR FROM part WHERE p_type <> 'ECONOMY'),
      c AS (SELECT modality, source_id, CASE WHEN modality = 'lipid' THEN 1 ELSE count(target_id) END AS k FROM f LEFT JOIN t USING (modality, source_id) GROUP BY modality, source_id)
    SELECT modality, count(*) AS n_features, count(*) FILTER (WHERE k > 0) AS n_mapped, count(*) FILTER (WHERE k = 0) AS n_unmapped,
      count(*) FILTER (WHERE k > 1) AS n_ambiguous, sum(k)::BIGINT AS n_pairs FROM c GROUP BY modality""",
)
def idmap_summary(spark, sf):
    return idmap.map_summary(idmap.map_features(*_id_map_inputs(spark, sf)))


@query(
    "json_path_values",
    "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
def json_path_values(spark, sf):
    return idmap.values_at_path(table(spark, sf, "events"), "props", ["k"], ["event_id"])


@query(
    "cpm_log1p",
    with_query(f"SELECT observation_id, feature, {r6('normalized', 'normalized')} FROM p2_norm WHERE modality = 'rna'", "p2_norm"),
)
def cpm_log1p(spark, sf):
    cells = order_cells(spark, sf, ("rna",))
    out = normalize.normalize_cells(cells, normalize.assay_configs({"rna": "raw_counts"}))
    return _round(out.select("observation_id", "feature", "normalized"), "normalized")


@query(
    "intensity_log2",
    with_query(f"SELECT observation_id, feature, {r6('normalized', 'normalized')} FROM p2_norm WHERE modality = 'protein'", "p2_norm"),
)
def intensity_log2(spark, sf):
    cells = order_cells(spark, sf, ("protein",))
    out = normalize.normalize_cells(cells, normalize.assay_configs({"protein": "intensity"}))
    return _round(out.select("observation_id", "feature", "normalized"), "normalized")


@query(
    "normalization_record",
    with_query(
        """SELECT 'rna' AS modality, 'bulk_rna_counts' AS strategy, (SELECT count(*) FROM p1_obs) -
            (SELECT count(*) FROM (SELECT observation_id FROM p1_cells WHERE modality='rna' GROUP BY 1 HAVING sum(raw) > 0)) AS n_zero_library_samples,
            NULL::BIGINT AS n_zeros_as_missing, false AS learns_statistics
        UNION ALL SELECT 'protein', 'protein_intensity', NULL, (SELECT count(*) FROM p1_cells WHERE modality='protein' AND raw = 0), false""",
        "p1_obs", "p1_cells",
    ),
)
def normalization_record(spark, sf):
    cells = event_cells(spark, sf)
    return normalize.normalization_record(event_observations(cells), cells, normalize.assay_configs({"rna": "raw_counts", "protein": "intensity"}))


@query(
    "scaler_fit",
    with_query(
        f"SELECT modality, feature, {r6('mean', 'mean')}, {r6('scale', 'scale')}, coalesce(std < 1e-12, false) AS zero_variance, n_fit FROM p2_scaler",
        "p2_scaler",
    ),
)
def scaler_fit(spark, sf):
    return _round(order_study(spark, sf).scaler, "mean", "scale").withColumn("zero_variance", F.coalesce("zero_variance", F.lit(False)))


@query(
    "scaler_record",
    with_query(
        """SELECT modality, count(*) AS n_features, count(*) FILTER (WHERE std < 1e-12) AS n_zero_variance,
          (SELECT count(*) FROM p1_obs JOIN p1_units USING (unit) WHERE split = 'train') AS n_fit_samples,
          modality || '_standard_scaler' AS transformer_name, 'train' AS fit_split FROM p1_scaler GROUP BY modality""",
        "p1_scaler", "p1_obs", "p1_units",
    ),
)
def scaler_record(spark, sf):
    study = event_study(spark, sf)
    return normalize.scaler_record(study.scaler, study.observations)


@query(
    "scaled_cells",
    with_query(f"SELECT observation_id, modality, feature, split, {r6('scaled', 'scaled')} FROM p1_scaled", "p1_scaled"),
)
def scaled_cells(spark, sf):
    return _round(event_study(spark, sf).cells.select("observation_id", "modality", "feature", "split", "scaled"), "scaled")


@query(
    "imputed_inputs",
    with_query(
        f"""SELECT o.observation_id, f.feature, {r6('coalesce(c.scaled, f.fill)', 'imputed')}
        FROM (SELECT observation_id FROM p1_obs JOIN p1_units USING (unit) WHERE split = 'val') o
        CROSS JOIN (SELECT feature, avg(scaled) FILTER (WHERE split = 'train') AS fill FROM p1_scaled GROUP BY 1) f
        LEFT JOIN p1_scaled c ON c.observation_id = o.observation_id AND c.feature = f.feature""",
        "p1_obs", "p1_units", "p1_scaled",
    ),
)
def imputed_inputs(spark, sf):
    study = event_study(spark, sf)
    val = normalize.subset(study.observations, "val")
    spine = align.dense_spine(val, study.cells.select("observation_id", "modality", "feature", "scaled"))
    filled = normalize.impute_cells(spine, normalize.imputer_fit(study.cells))
    return _round(filled.select("observation_id", "feature", "imputed"), "imputed")


@query(
    "qc_sample",
    with_query(
        f"""SELECT o.observation_id, s.modality, count(n.normalized) AS n_observed, {r6('1 - count(n.normalized) / any_value(s.k)', 'pct_missing')},
          {r6('sum(n.raw) FILTER (WHERE n.normalized IS NOT NULL)', 'total_signal')}, {r6('median(n.raw) FILTER (WHERE n.normalized IS NOT NULL)', 'median_signal')}
        FROM p1_obs o CROSS JOIN (SELECT modality, count(DISTINCT feature) AS k FROM p1_norm GROUP BY 1) s
        LEFT JOIN p1_norm n ON n.observation_id = o.observation_id AND n.modality = s.modality GROUP BY o.observation_id, s.modality""",
        "p1_obs", "p1_norm",
    ),
)
def qc_sample(spark, sf):
    study = event_study(spark, sf)
    return _round(qc.per_sample_qc(study.observations, study.cells), "pct_missing", "total_signal", "median_signal")


QC_FEATURE = f"""SELECT modality, feature, count(normalized) AS n_observed, {r6('1 - count(normalized) / (SELECT count(*) FROM p1_obs)', 'pct_missing')},
  {r6('avg(raw) FILTER (WHERE normalized IS NOT NULL)', 'mean')}, {r6('stddev_pop(raw) FILTER (WHERE normalized IS NOT NULL)', 'std')},
  coalesce(count(normalized) > 0 AND stddev_pop(raw) FILTER (WHERE normalized IS NOT NULL) < 1e-12, false) AS zero_variance
FROM p1_norm GROUP BY modality, feature"""


@query("qc_feature", with_query(QC_FEATURE, "p1_norm", "p1_obs"))
def qc_feature(spark, sf):
    study = event_study(spark, sf)
    return _round(qc.per_feature_qc(study.observations, study.cells), "pct_missing", "mean", "std")


@query(
    "qc_summary",
    with_query(
        f"""SELECT s.modality, any_value(s.n) AS n_observations, {r6('1 - any_value(s.obs) / (any_value(s.n) * count(*))', 'pct_missing_overall')},
          any_value(s.empty) AS n_samples_fully_missing, count(*) AS n_features, count(*) FILTER (WHERE f.n_observed = 0) AS n_features_fully_missing,
          count(*) FILTER (WHERE f.zero_variance) AS n_zero_variance_features
        FROM (SELECT modality, count(normalized) AS obs, (SELECT count(*) FROM p1_obs) AS n,
                (SELECT count(*) FROM p1_obs) - count(DISTINCT observation_id) FILTER (WHERE normalized IS NOT NULL) AS empty FROM p1_norm GROUP BY 1) s
        JOIN ({QC_FEATURE}) f USING (modality) GROUP BY s.modality""",
        "p1_obs", "p1_norm",
    ),
)
def qc_summary(spark, sf):
    study = event_study(spark, sf)
    out = qc.qc_summary(qc.per_sample_qc(study.observations, study.cells), qc.per_feature_qc(study.observations, study.cells))
    return _round(out, "pct_missing_overall")


@query("split_groups", with_query("SELECT unit, position, split FROM p1_units", "p1_units"))
def split_groups(spark, sf):
    obs = event_observations(event_cells(spark, sf))
    return split.assign_random(obs, ["experimental_unit_id"], SEED).select(F.col("experimental_unit_id").alias("unit"), "position", "split")


@query(
    "split_assignment",
    with_query(
        """SELECT observation_id, batch, CASE batch WHEN 'ASIA' THEN 'val' WHEN 'EUROPE' THEN 'test' ELSE 'train' END AS split FROM p2_obs""",
        "p2_obs",
    ),
)
def split_assignment(spark, sf):
    obs = order_cells(spark, sf).select("observation_id", "experimental_unit_id", "batch").distinct()
    regions = table(spark, sf, "region").select(
        F.col("r_name").alias("key"),
        F.when(F.col("r_name") == "ASIA", "val").when(F.col("r_name") == "EUROPE", "test").otherwise("train").alias("split"),
    )
    columns = split.group_columns(["batch"], cross_sectional=True)
    units = split.assign_explicit(obs, columns, regions)
    return split.label_observations(obs, units, columns).select("observation_id", "batch", "split")


@query(
    "leakage_guard",
    """WITH s AS (SELECT o_custkey::VARCHAR AS subject, c_nationkey::VARCHAR AS batch,
        CASE WHEN year(o_orderdate) <= 1995 THEN 'train' WHEN year(o_orderdate) = 1996 THEN 'val' ELSE 'test' END AS split
        FROM orders JOIN customer ON o_custkey = c_custkey),
      g AS (SELECT 'subject' AS guard, subject AS value, split FROM s UNION SELECT 'batch', batch, split FROM s)
    SELECT a.guard, a.value, a.split AS left_split, b.split AS right_split FROM g a JOIN g b ON a.guard = b.guard AND a.value = b.value
    WHERE (a.split, b.split) IN (('train','val'), ('train','test'), ('val','test'))""",
)
def leakage_guard(spark, sf):
    year = F.year("o_orderdate")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("subject"), F.col("c_nationkey").alias("batch"),
        F.when(year <= 1995, "train").when(year == 1996, "val").otherwise("test").alias("split"),
    )
    return split.leakage(rows, ["subject", "batch"])


def last_value_cells(spark, sf):
    return LastValue(event_forecast(spark, sf)).predict()


@query(
    "subject_instances",
    with_query(
        "SELECT instance_id, group_id, condition, batch, split, target_time, history_time, delta_t, target_observation, history_observation FROM p1_inst",
        "p1_inst",
    ),
)
def subject_instances(spark, sf):
    return event_forecast(spark, sf).instances.drop("subject_id")


@query(
    "sequence_gaps",
    with_query(
        "SELECT unit, step, time, observation_id, coalesce(time - lag(time) OVER (PARTITION BY unit ORDER BY time), 0) AS step_dt FROM p1_steps", "p1_steps"
    ),
)
def sequence_gaps(spark, sf):
    return forecast.sequence_steps(event_forecast(spark, sf).steps).withColumnRenamed("experimental_unit_id", "unit")


@query(
    "sequence_index",
    with_query(
        """SELECT i.instance_id, i.group_id, i.condition, s.step AS length, i.delta_t AS target_dt FROM p1_inst i
        JOIN p1_steps s ON s.unit = i.group_id AND s.time = i.history_time""",
        "p1_inst", "p1_steps",
    ),
)
def sequence_index(spark, sf):
    data = event_forecast(spark, sf)
    return forecast.sequence_index(data.instances, data.steps)


@query(
    "sequence_values",
    with_query(
        f"""SELECT s.unit, s.step, c.modality, c.feature, {r6('coalesce(c.scaled, 0)', 'value')}, c.scaled IS NOT NULL AS observed
        FROM p1_steps s JOIN p1_scaled c USING (observation_id)""",
        "p1_steps", "p1_scaled",
    ),
)
def sequence_values(spark, sf):
    data = event_forecast(spark, sf)
    out = forecast.sequence_values(forecast.sequence_steps(data.steps), data.study.cells)
    return _round(out, "value").withColumnRenamed("experimental_unit_id", "unit")


@query(
    "last_value_scores",
    with_query(
        f"""SELECT split, count(*) AS n_observed, count(*) AS n_valid, {r6('mse', 'mse')}, {r6('mae', 'mae')}, {r6('sqrt(mse)', 'rmse')}, {r6('pcc', 'pcc')}, {r6('r2', 'r2')}
        FROM (SELECT split, y_true AS t, y_pred AS p, count(*) OVER (PARTITION BY split) AS n,
            avg((y_true-y_pred)*(y_true-y_pred)) OVER (PARTITION BY split) AS mse, avg(abs(y_true-y_pred)) OVER (PARTITION BY split) AS mae,
            covar_pop(y_true, y_pred) OVER (PARTITION BY split) / (stddev_pop(y_true) OVER (PARTITION BY split) * stddev_pop(y_pred) OVER (PARTITION BY split)) AS pcc,
            1 - avg((y_true-y_pred)*(y_true-y_pred)) OVER (PARTITION BY split) / var_pop(y_true) OVER (PARTITION BY split) AS r2 FROM p1_lv)
        GROUP BY split, mse, mae, pcc, r2""",
        "p1_lv",
    ),
)
def last_value_scores(spark, sf):
    cells = last_value_cells(spark, sf)
    out = evaluate.grouped_scores(cells, ["split"]).drop("_defined")
    return _round(out, "mse", "mae", "rmse", "pcc", "r2")


def _rank_cte(source: str, keys: str) -> str:
    return f"""SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY y_true) + (count(*) OVER (PARTITION BY {keys}, y_true) - 1) / 2 AS rt,
      rank() OVER (PARTITION BY {keys} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {keys}, y_pred) - 1) / 2 AS rp FROM {source}"""


METRICS_BY = f"""count(*) AS n_observed, count(*) AS n_valid, {M['mse']} AS mse, {M['mae']} AS mae, sqrt({M['mse']}) AS rmse, {M['pcc']} AS pcc, {M['r2']} AS r2,
  CASE WHEN count(*)>=2 AND max(t)>min(t) AND max(p)>min(p) THEN covar_pop(rt,rp)/(stddev_pop(rt)*stddev_pop(rp)) END AS spearman"""


def scores_sql(source: str, keys: str) -> str:
    return f"SELECT {keys}, {METRICS_BY} FROM (SELECT *, y_true AS t, y_pred AS p FROM ({_rank_cte(source, keys)})) GROUP BY {keys}"


def _rounded_list(names) -> str:
    return ", ".join(r6(n, n) for n in names)


SCORE_COLS = ["mse", "mae", "rmse", "pcc", "r2", "spearman"]


@query(
    "per_feature_metrics",
    with_query(f"SELECT split, feature, n_observed, n_valid, {_rounded_list(SCORE_COLS)} FROM ({scores_sql('p1_lv', 'split, feature')})", "p1_lv"),
)
def per_feature_metrics(spark, sf):
    cells = last_value_cells(spark, sf)
    return _round(evaluate.per_feature(stage(cells, "scored"), ["split"]), *SCORE_COLS)


@query(
    "per_sample_metrics",
    with_query(f"SELECT split, instance_id, group_id, n_observed, n_valid, {_rounded_list([c for c in SCORE_COLS if c != 'r2'])}, {r6('r2', 'r2', 1)} FROM ({scores_sql('p1_lv', 'split, instance_id, group_id')})", "p1_lv"),
)
def per_sample_metrics(spark, sf):
    cells = last_value_cells(spark, sf)
    # Two nearly equal truths give an r2 of large magnitude, so it is kept to one digit here.
    out = evaluate.per_sample(stage(cells, "scored"), ["split"])
    return _round(out, *[c for c in SCORE_COLS if c != "r2"]).withColumn("r2", rounded(F.col("r2"), 1))


@query(
    "macro_metrics",
    with_query(
        f"""SELECT p.split, p.n_observed, p.n_valid, {_rounded_list(['mse', 'mae', 'rmse'])}, {r6('p.pcc', 'pcc_pooled')}, {r6('p.r2', 'r2_pooled')}, {r6('p.spearman', 'spearman_pooled')},
          {r6('m.pcc', 'pcc_macro')}, m.n_pcc, {r6('m.spearman', 'spearman_macro')}, m.n_spearman, {r6('m.r2', 'r2_macro')}, m.n_r2, m.n_total, m.n_total - m.n_pcc AS n_undefined_pcc,
          'protein_macro_pcc' AS primary_metric, {r6('m.pcc', 'primary_value')}, NULL::VARCHAR AS warning
        FROM ({scores_sql('p1_lv', 'split')}) p JOIN (SELECT split, avg(pcc) AS pcc, count(pcc) AS n_pcc, avg(spearman) AS spearman, count(spearman) AS n_spearman,
          avg(r2) AS r2, count(r2) AS n_r2, count(*) AS n_total FROM ({scores_sql('p1_lv', 'split, feature')}) GROUP BY split) m USING (split)""",
        "p1_lv",
    ),
)
def macro_metrics(spark, sf):
    cells = last_value_cells(spark, sf)
    out = evaluate.primary_value(evaluate.scalars(stage(cells, "scored"), ["split"]), "protein_macro_pcc")
    names = ["mse", "mae", "rmse", "pcc_pooled", "r2_pooled", "spearman_pooled", "pcc_macro", "spearman_macro", "r2_macro", "primary_value"]
    return _round(out, *names)


@query(
    "coverage",
    with_query(
        f"""SELECT split, n_instances, n_features, n_observed, n_instances * n_features AS n_possible, {r6('n_observed / (n_instances * n_features)', 'coverage')}
        FROM (SELECT split, count(*) AS n_instances, (SELECT count(DISTINCT feature) FROM p1_cells WHERE modality = 'protein') AS n_features FROM p1_inst GROUP BY 1)
        JOIN (SELECT split, count(*) AS n_observed FROM p1_targets GROUP BY 1) USING (split)""",
        "p1_inst", "p1_targets", "p1_cells",
    ),
)
def coverage(spark, sf):
    data = event_forecast(spark, sf)
    features = data.target_cells.select("feature").distinct()
    return _round(evaluate.coverage(data.targets, data.instances, features, ["split"]), "coverage")


BOOT = 20
BOOT_SEED = 11

fragment(
    "boot_units",
    """SELECT split, group_id AS unit, row_number() OVER (PARTITION BY split ORDER BY md5(group_id), group_id) - 1 AS idx,
      count(*) OVER (PARTITION BY split) AS n_units FROM (SELECT DISTINCT split, group_id FROM p1_lv)""",
    "p1_lv",
)
fragment(
    "boot_draws",
    f"""SELECT u.split, s.replicate, u.unit, u.n_units FROM
      (SELECT split, r.replicate, ('0x' || substr(md5('{BOOT_SEED}:' || r.replicate::VARCHAR || ':' || idx::VARCHAR), 1, 15))::BIGINT % n_units AS pick
       FROM boot_units, (SELECT unnest(range({BOOT})) AS replicate) r) s
      JOIN boot_units u ON u.split = s.split AND u.idx = s.pick""",
    "boot_units",
)
fragment("boot_cells", "SELECT c.*, d.replicate, d.n_units FROM p1_lv c JOIN boot_draws d ON c.split = d.split AND c.group_id = d.unit", "p1_lv", "boot_draws")
fragment(
    "boot_features",
    f"""SELECT split, replicate, n_units, feature, count(*) AS n, {METRICS_BY.split("AS n_valid,", 1)[1]}
    FROM (SELECT *, y_true AS t, y_pred AS p FROM ({_rank_cte('boot_cells', 'split, replicate, feature')})) GROUP BY split, replicate, n_units, feature""",
    "boot_cells",
)


@query(
    "bootstrap_ci",
    with_query(
        f"""SELECT split, metric, {r6('quantile_cont(v, 0.025)', 'low')}, {r6('quantile_cont(v, 0.975)', 'high')}, count(v) AS n_finite,
          any_value(n_units) AS n_units, {BOOT}::BIGINT AS n_replicates
        FROM (SELECT split, n_units, unnest(['mse', 'mae', 'pcc', 'spearman', 'r2']) AS metric, unnest([mse, mae, pcc, spearman, r2]) AS v
          FROM (SELECT split, replicate, n_units, sum(mse * n) / sum(n) AS mse, sum(mae * n) / sum(n) AS mae, avg(pcc) AS pcc, avg(spearman) AS spearman, avg(r2) AS r2
            FROM boot_features GROUP BY split, replicate, n_units)) GROUP BY split, metric""",
        "boot_features",
    ),
)
def bootstrap_ci(spark, sf):
    cells = last_value_cells(spark, sf)
    out = resample.bootstrap_ci(stage(cells, "scored"), ["split"], "group_id", BOOT, BOOT_SEED)
    return _round(out, "low", "high")
