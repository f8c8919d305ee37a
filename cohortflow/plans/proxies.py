"""Measurement-shaped views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.normalize import assay_configs
from cohortflow.operators.split import assign_random
from cohortflow.plans.runs import Forecast, Study, Task, layer_study
from cohortflow.session import dealt, stage

SEED = 7
# Assay of each event type.
EVENT_ASSAY = {"purchase": "protein", "error": "protein", "click": "rna", "signup": "rna", "view": "rna"}
VALUE_TYPES = {"rna": "raw_counts", "protein": "intensity"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudinal cells: a user is a unit, a day is a time, an event type is a feature."""
    assay = F.lit(None).cast("string")
    for feature, modality in EVENT_ASSAY.items():
        assay = F.when(F.col("event_type") == feature, modality).otherwise(assay)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    cells = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", day.alias("day"), "event_type")
        .agg(F.round(F.avg("value"), 6).alias("raw"))
        .select(
            F.concat_ws("@", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("observation_id"),
            F.col("user_id").cast("string").alias("experimental_unit_id"),
            F.col("day").cast("double").alias("time"),
            F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("condition"),
            F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("batch"),
            assay.alias("modality"), F.col("event_type").alias("feature"), "raw",
        )
    )
    return cells


def event_observations(cells: DataFrame) -> DataFrame:
    keys = ["observation_id", "experimental_unit_id", "time", "condition", "batch"]
    return cells.groupBy(*keys).agg(
        F.max(F.col("modality") == "rna").alias("has_rna"), F.max(F.col("modality") == "protein").alias("has_protein")
    ).withColumns({"subject_id": F.col("experimental_unit_id"), "biospecimen_id": F.col("observation_id")})


def event_sheet(cells: DataFrame) -> DataFrame:
    """Sample sheet: one row per observation and assay."""
    return cells.groupBy("observation_id", "experimental_unit_id", "time", "condition", "batch", "modality").agg(
        F.count("*").alias("n_features")
    ).select(
        F.concat_ws(":", "observation_id", "modality").alias("sample_id"), "observation_id", "experimental_unit_id",
        F.col("experimental_unit_id").alias("subject_id"), F.col("observation_id").alias("biospecimen_id"),
        "time", F.lit("day").alias("time_unit"), "condition", "batch", "modality",
        F.concat(F.lit("events-"), "modality").alias("file_id"), F.lit("biological").alias("replicate_type"),
    )


def order_cells(spark: SparkSession, sf_dir: str, modalities: tuple[str, ...] = ("rna", "protein")) -> DataFrame:
    """Cross-sectional cells: an order is a unit seen once; counts by brand, intensities by type.

    Lines meet their order before they are summed, so one shuffle by observation serves the join, the aggregation
    and what callers do by observation, and only the asked assays are spread out. Its parts grow in number with the lines.
    """
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "part", "customer", "nation", "region")}
    rows = t["lineitem"].count()
    unit = lambda key: F.col(key).cast("string").alias("observation_id")
    assays = {"rna": ("p_brand", "l_quantity"), "protein": ("p_type", "l_extendedprice")}
    lines = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select(unit("l_orderkey"), *[c for m in modalities for c in assays[m]])
    meta = (
        t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            unit("o_orderkey"), F.year("o_orderdate").cast("double").alias("time"),
            F.col("c_mktsegment").alias("condition"), F.col("r_name").alias("batch"),
        )
    )
    spread = F.explode(
        F.array(*[F.struct(F.lit(m).alias("modality"), F.col(assays[m][0]).alias("feature"), F.col(assays[m][1]).alias("v")) for m in modalities])
    )
    about = ["observation_id", "time", "condition", "batch"]
    cells = (
        dealt(lines, rows, "observation_id").join(dealt(meta, rows, "observation_id"), "observation_id").select(*about, spread.alias("a"))
        .groupBy(*about, "a.modality", "a.feature").agg(F.sum("a.v").alias("raw"))
    )
    return cells.select(
        "observation_id", F.col("observation_id").alias("experimental_unit_id"), "time", "condition", "batch", "modality", "feature", "raw"
    )


CONFIGS = assay_configs(VALUE_TYPES)


def event_study(spark: SparkSession, sf_dir: str, seed: int = SEED) -> Study:
    raw = stage(event_cells(spark, sf_dir), "event-cells")
    obs = stage(event_observations(raw), "event-observations")
    units = assign_random(obs, ["experimental_unit_id"], seed)
    return layer_study(raw, obs, units, ["experimental_unit_id"], CONFIGS, "event-study")


def order_study(spark: SparkSession, sf_dir: str, seed: int = SEED) -> Study:
    """Cross-sectional study split by order (batch blocking is shown by ``split_assignment``)."""
    raw = stage(order_cells(spark, sf_dir), "order-cells")
    obs = raw.groupBy("observation_id", "experimental_unit_id", "time", "condition", "batch").agg(
        F.max(F.col("modality") == "rna").alias("has_rna"), F.max(F.col("modality") == "protein").alias("has_protein")
    ).withColumns({"subject_id": F.col("experimental_unit_id"), "biospecimen_id": F.col("observation_id")})
    obs = stage(obs, "order-observations")
    units = assign_random(obs, ["experimental_unit_id"], seed)
    return layer_study(raw, obs, units, ["experimental_unit_id"], CONFIGS, "order-study")


def event_forecast(spark: SparkSession, sf_dir: str) -> Forecast:
    return Forecast(event_study(spark, sf_dir))


GROUP_MIN_TIME = 1997.0


def order_forecast(spark: SparkSession, sf_dir: str) -> Forecast:
    """Cross-sectional forecasts: last values come from train condition x time means."""
    return Forecast(order_study(spark, sf_dir), Task(kind="group_time_forecast", target_time_min=GROUP_MIN_TIME))
