"""Feature id maps: source id to zero, one or many target ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_features(features: DataFrame, id_table: DataFrame) -> DataFrame:
    """Long map: one row per (source, target); duplicates dropped, unmapped sources kept.

    ``features``: ``modality, source_id``; ``id_table``: ``modality, source_id, target_id,
    target_id_type``. ``target_order`` numbers a source's targets by id. A modality without any
    row in the table maps to itself.
    """
    pairs = id_table.groupBy("modality", "source_id", "target_id").agg(F.min("target_id_type").alias("target_id_type"))
    per = pairs.groupBy("modality", "source_id").agg(F.count("*").alias("n_targets"))
    covered = id_table.select("modality").distinct().withColumn("_covered", F.lit(True))
    kinds = id_table.groupBy("modality").agg(
        F.min("target_id_type").alias("_lo"), F.max("target_id_type").alias("_hi")
    ).select("modality", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_kind"))
    joined = (
        features.join(covered, "modality", "left").join(kinds, "modality", "left")
        .join(per, ["modality", "source_id"], "left").join(pairs, ["modality", "source_id"], "left")
    )
    identity = F.col("_covered").isNull()
    return joined.select(
        "modality", "source_id",
        F.when(identity, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"),
        F.when(identity, F.lit("identity")).otherwise(F.coalesce("_kind", F.lit("undeclared"))).alias("target_id_type"),
        F.when(identity, F.lit(1)).otherwise(F.coalesce("n_targets", F.lit(0))).cast("bigint").alias("n_targets"),
    ).withColumns({"ambiguous": F.col("n_targets") > 1, "unmapped": F.col("n_targets") == 0})


def map_summary(feature_map: DataFrame) -> DataFrame:
    """Counts per modality: features, mapped, unmapped, ambiguous, pairs."""
    per = feature_map.groupBy("modality", "source_id").agg(F.max("n_targets").alias("n"))
    return per.groupBy("modality").agg(
        F.count("*").alias("n_features"), F.count_if(F.expr("n > 0")).alias("n_mapped"), F.count_if(F.expr("n = 0")).alias("n_unmapped"),
        F.count_if(F.expr("n > 1")).alias("n_ambiguous"), F.sum("n").alias("n_pairs"),
    )


def blocking_sources(feature_map: DataFrame) -> DataFrame:
    """One-to-many sources; training stays blocked while any is left."""
    return feature_map.where("n_targets > 1").select("modality", "source_id", "n_targets").distinct()


def values_at_path(df: DataFrame, column: str, path: list[str], key: list[str]) -> DataFrame:
    """String or number leaves of a JSON column at a dotted path, stepping through lists.

    Each step reads one level as a map of raw JSON and flattens arrays, so the result has one row
    per leaf. Leaves that are objects or booleans are dropped.
    """

    def flatten(frame: DataFrame) -> DataFrame:
        node = F.trim("_node")
        items = F.when(F.startswith(node, F.lit("[")), F.from_json(node, "array<string>")).otherwise(F.array(node))
        return frame.select(*key, F.explode(items).alias("_node"))

    nodes = flatten(df.select(*key, F.col(column).alias("_node")))
    for step in path:
        child = F.element_at(F.from_json("_node", "map<string,string>"), step)
        nodes = flatten(nodes.select(*key, child.alias("_node")).where("_node IS NOT NULL"))
    leaf = F.col("_node")
    ok = ~F.startswith(leaf, F.lit("{")) & ~leaf.isin("true", "false", "null")
    return nodes.where(ok).select(*key, leaf.alias("value"))
