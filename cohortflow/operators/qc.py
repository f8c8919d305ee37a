"""Per-sample and per-feature quality metrics.

Values come from ``raw``, missingness from ``normalized``. Possible cells are counted as
observations x features of the modality, so the dense matrix is never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.numeric import ZERO_VARIANCE


def feature_counts(layered: DataFrame) -> DataFrame:
    return layered.groupBy("modality", "feature").agg(F.lit(1).alias("_one")).groupBy("modality").agg(F.count("*").alias("n_features"))


def per_sample_qc(obs: DataFrame, layered: DataFrame) -> DataFrame:
    """Every observation x modality; an observation with no cell shows 0 observed.

    The modality list is small (declared assays) and rides along as an array.
    """
    sizes = feature_counts(layered).agg(F.collect_list(F.struct("modality", "n_features")).alias("sizes"))
    spine = (
        obs.select("observation_id", F.explode(sizes.scalar()).alias("s")).select("observation_id", "s.*")
    )
    seen = F.when(F.col("normalized").isNotNull(), F.col("raw"))
    stats = layered.groupBy("observation_id", "modality").agg(
        F.count("normalized").alias("n_observed"), F.sum(seen).alias("total_signal"), F.median(seen).alias("median_signal")
    )
    n = F.coalesce("n_observed", F.lit(0))
    return spine.join(stats, ["observation_id", "modality"], "left").select(
        "observation_id", "modality", n.alias("n_observed"),
        (1 - n / F.col("n_features")).alias("pct_missing"), "total_signal", "median_signal",
    )


def per_feature_qc(obs: DataFrame, layered: DataFrame) -> DataFrame:
    seen = F.when(F.col("normalized").isNotNull(), F.col("raw"))
    stats = layered.groupBy("modality", "feature").agg(
        F.count("normalized").alias("n_observed"), F.avg(seen).alias("mean"), F.stddev_pop(seen).alias("std")
    )
    total = obs.agg(F.count("*")).scalar()
    flat = (F.col("n_observed") > 0) & (F.col("std") < ZERO_VARIANCE)
    return stats.withColumn("_n", total).select(
        "modality", "feature", "n_observed", (1 - F.col("n_observed") / F.col("_n")).alias("pct_missing"),
        "mean", "std", F.coalesce(flat, F.lit(False)).alias("zero_variance"),
    )


def qc_summary(samples: DataFrame, features: DataFrame) -> DataFrame:
    a = samples.groupBy("modality").agg(
        F.count("*").alias("n_observations"), F.avg("pct_missing").alias("pct_missing_overall"),
        F.count_if(F.col("n_observed") == 0).alias("n_samples_fully_missing"),
    )
    b = features.groupBy("modality").agg(
        F.count("*").alias("n_features"),
        F.count_if(F.col("n_observed") == 0).alias("n_features_fully_missing"),
        F.count_if("zero_variance").alias("n_zero_variance_features"),
    )
    return a.join(b, "modality")
