"""Observation table, dense spine and split labels on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["experimental_unit_id", "subject_id", "biospecimen_id", "time"]
DESCRIPTIVE = ["time_unit", "condition", "batch", "replicate_type"]


def observations(sheet: DataFrame, modalities: list[str]) -> DataFrame:
    """One row per ``observation_id`` with a ``has_<modality>`` flag per declared modality.

    Identity fields are constant inside an observation (checked by ``observation_conflicts``);
    descriptive fields come from the row with the smallest ``sample_id``.
    """
    return sheet.groupBy("observation_id").agg(
        *[F.min(c).alias(c) for c in IDENTITY],
        *[F.min_by(c, "sample_id").alias(c) for c in DESCRIPTIVE],
        *[F.max(F.col("modality") == m).alias(f"has_{m}") for m in modalities],
    )


def aligned_cells(sheet: DataFrame, cells: DataFrame) -> DataFrame:
    """Sheet rows left-joined to their matrix cells; matrix rows not on the sheet vanish.

    A sheet row without a matrix row is kept with NULL feature and value.
    """
    keys = sheet.select("sample_id", "modality", "observation_id")
    return keys.join(cells, ["sample_id", "modality"], "left").select(
        "observation_id", "modality", "feature", F.col("value").alias("raw")
    )


def dense_spine(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """Every observation x every feature of each modality, missing cells as NULL.

    The feature list of a modality (its matrix header) rides along as an array and is exploded per
    observation, so the output is exactly the dense matrix and no join multiplies rows.
    """
    header = cells.where("feature IS NOT NULL").groupBy("modality").agg(
        F.array_sort(F.collect_set("feature")).alias("features")
    )
    headers = header.agg(F.collect_list(F.struct("modality", "features")).alias("headers"))
    spine = (
        obs.select("observation_id", F.explode(headers.scalar()).alias("h"))
        .select("observation_id", F.col("h.modality").alias("modality"), F.explode("h.features").alias("feature"))
    )
    return spine.join(cells, ["observation_id", "modality", "feature"], "left")


def split_problems(obs: DataFrame, splits: DataFrame, unit: str = "experimental_unit_id") -> DataFrame:
    conflicting = (
        splits.groupBy(unit)
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        .where("lo <> hi")
        .select(unit, F.lit("conflicting").alias("problem"))
    )
    unassigned = (
        obs.select(unit).distinct().join(splits.select(unit), unit, "left_anti")
        .select(unit, F.lit("unassigned").alias("problem"))
    )
    return conflicting.unionByName(unassigned)
