"""Per-assay normalisation and train-only statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.numeric import ZERO_VARIANCE, safe_log2

COUNTS, INTENSITY, LOG_LIKE = "bulk_rna_counts", "protein_intensity", "log_expression"

# Strategy of each declared value type.
STRATEGY_BY_VALUE_TYPE = {
    "raw_counts": COUNTS,
    "intensity": INTENSITY,
    "log1p": LOG_LIKE,
    "log2_intensity": LOG_LIKE,
    "zscore": LOG_LIKE,
    "synthetic_abundance": LOG_LIKE,
}


@dataclass(frozen=True)
class AssayConfig:
    strategy: str
    cpm_target: float = 1e6
    log1p_after_cpm: bool = True
    zeros_are_missing: bool = True
    log2_transform: bool = True
    scale: bool = True


def assay_configs(value_types: dict[str, str], overrides: dict[str, AssayConfig] | None = None) -> dict[str, AssayConfig]:
    """Strategy per declared modality; an undeclared value type is an error."""
    out = {}
    for modality, value_type in value_types.items():
        if overrides and modality in overrides:
            out[modality] = overrides[modality]
        elif value_type in STRATEGY_BY_VALUE_TYPE:
            out[modality] = AssayConfig(STRATEGY_BY_VALUE_TYPE[value_type])
        else:
            raise ValueError(f"Modality {modality!r} has value_type {value_type!r}: declare how it was measured.")
    return out


def _modalities(configs: dict[str, AssayConfig], strategy: str) -> list[str]:
    return sorted(m for m, c in configs.items() if c.strategy == strategy)


def _per_modality(configs: dict[str, AssayConfig], pick) -> Column:
    col = F.lit(None).cast("double")
    for modality, config in sorted(configs.items()):
        col = F.when(F.col("modality") == modality, pick(config)).otherwise(col)
    return col


def normalize_cells(cells: DataFrame, configs: dict[str, AssayConfig]) -> DataFrame:
    """Add ``normalized``: CPM (+log1p) for counts, zeros to missing then log2 for intensities,
    pass-through for log-like values. Learns nothing across observations.

    Only count assays need the library sum, so only they are shuffled by observation.
    """
    raw = F.col("raw")
    counts = _modalities(configs, COUNTS)
    parts = []
    if counts:
        library = F.sum("raw").over(Window.partitionBy("observation_id", "modality"))
        target = _per_modality(configs, lambda c: F.lit(c.cpm_target))
        part = cells.where(F.col("modality").isin(counts)).withColumn("_lib", library)
        cpm = F.when(F.col("_lib") > 0, raw / F.col("_lib") * target)
        logged = [m for m in counts if configs[m].log1p_after_cpm]
        value = F.when(F.col("modality").isin(logged), F.log1p(cpm)).otherwise(cpm) if logged else cpm
        parts.append(part.withColumn("normalized", value).drop("_lib"))
    direct = [m for m in configs if m not in counts]
    if direct:
        value = raw
        for modality in _modalities(configs, INTENSITY):
            config = configs[modality]
            work = F.when(raw != 0, raw) if config.zeros_are_missing else raw
            work = safe_log2(work) if config.log2_transform else work
            value = F.when(F.col("modality") == modality, work).otherwise(value)
        parts.append(cells.where(F.col("modality").isin(sorted(direct))).withColumn("normalized", value))
    return reduce(lambda a, b: a.unionByName(b), parts)


def normalization_record(obs: DataFrame, cells: DataFrame, configs: dict[str, AssayConfig]) -> DataFrame:
    """Per modality: observations with an empty library and zeros turned missing.

    An observation with no cell at all counts as an empty library, as an empty sum is zero.
    """
    counts, intensity = _modalities(configs, COUNTS), _modalities(configs, INTENSITY)
    n_obs = obs.agg(F.count("*")).scalar()
    live = (
        cells.where(F.col("modality").isin(counts))
        .groupBy("modality", "observation_id").agg((F.sum("raw") > 0).alias("ok"))
        .groupBy("modality").agg(F.count_if("ok").alias("_live"))
    )
    zeros = cells.where(F.col("modality").isin(intensity)).groupBy("modality").agg(F.count_if(F.col("raw") == 0).alias("n_zeros_as_missing"))
    names = cells.select("modality").distinct()
    strategy = F.lit(None).cast("string")
    for modality, config in sorted(configs.items()):
        strategy = F.when(F.col("modality") == modality, config.strategy).otherwise(strategy)
    return (
        names.join(live, "modality", "left").join(zeros, "modality", "left").withColumn("_n", n_obs)
        .select(
            "modality",
            strategy.alias("strategy"),
            F.when(F.col("modality").isin(counts), F.col("_n") - F.coalesce("_live", F.lit(0))).alias("n_zero_library_samples"),
            F.when(F.col("modality").isin(intensity), F.coalesce("n_zeros_as_missing", F.lit(0))).alias("n_zeros_as_missing"),
            F.lit(False).alias("learns_statistics"),
        )
    )


def scaler_fit(normalized: DataFrame) -> DataFrame:
    """Mean and population deviation of train cells per feature; near-zero deviation becomes 1."""
    std = F.stddev_pop("normalized")
    return (
        normalized.where("split = 'train'")
        .groupBy("modality", "feature")
        .agg(F.avg("normalized").alias("mean"), std.alias("std"), F.count("normalized").alias("n_fit"))
        .select(
            "modality", "feature", "mean",
            F.when(F.col("std") < ZERO_VARIANCE, 1.0).otherwise(F.col("std")).alias("scale"),
            (F.col("std") < ZERO_VARIANCE).alias("zero_variance"), "n_fit",
        )
    )


def scaler_record(scaler: DataFrame, obs: DataFrame) -> DataFrame:
    """Provenance of the fitted scalers, one row per modality, always fitted on train."""
    rows = obs.where("split = 'train'").agg(F.count("*")).scalar()
    return (
        scaler.groupBy("modality")
        .agg(F.count("*").alias("n_features"), F.count_if("zero_variance").alias("n_zero_variance"))
        .withColumn("n_fit_samples", rows)
        .withColumn("transformer_name", F.concat("modality", F.lit("_standard_scaler")))
        .withColumn("fit_split", F.lit("train"))
    )


def scale_cells(normalized: DataFrame, scaler: DataFrame, configs: dict[str, AssayConfig]) -> DataFrame:
    """Add ``scaled``; a missing cell stays missing, an unscaled modality passes through."""
    plain = sorted(m for m, c in configs.items() if not c.scale)
    z = (F.col("normalized") - F.col("mean")) / F.col("scale")
    value = F.when(F.col("modality").isin(plain), F.col("normalized")).otherwise(z) if plain else z
    joined = normalized.join(scaler.select("modality", "feature", "mean", "scale"), ["modality", "feature"], "left")
    return joined.withColumn("scaled", value).drop("mean", "scale")


def imputer_fit(cells: DataFrame, value: str = "scaled") -> DataFrame:
    """Train mean per feature, used to fill model inputs and never scored targets."""
    return cells.where("split = 'train'").groupBy("modality", "feature").agg(F.avg(value).alias("fill"))


def impute_cells(cells: DataFrame, imputer: DataFrame, value: str = "scaled") -> DataFrame:
    return cells.join(imputer, ["modality", "feature"], "left").withColumn("imputed", F.coalesce(value, "fill")).drop("fill")


def subset(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)
