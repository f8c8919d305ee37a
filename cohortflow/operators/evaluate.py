"""Missing-aware scores of predictions. A constant vector yields NULL, never 0.

Inputs are scored cells: key columns, ``instance_id``, ``feature``, ``y_true``, ``y_pred``. Moments
come from Spark's mergeable aggregates in one pass, so no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.numeric import CONSTANT_STD, finite
from cohortflow.operators.scan import average_ranks

# Names a primary metric may use and the scalar each one reads.
PRIMARY_ALIASES = {
    "mse": "mse", "mae": "mae", "rmse": "rmse", "r2_pooled": "r2_pooled",
    "pcc_macro": "pcc_macro", "spearman_macro": "spearman_macro", "r2_macro": "r2_macro",
    "pcc_pooled": "pcc_pooled", "spearman_pooled": "spearman_pooled",
    "protein_macro_pcc": "pcc_macro", "macro_pcc": "pcc_macro",
}


def _pairs(cells: DataFrame) -> DataFrame:
    ok = F.col("y_true").isNotNull() & finite(F.col("y_true")) & finite(F.col("y_pred"))
    return cells.withColumns({"_t": F.when(ok, F.col("y_true")), "_p": F.when(ok, F.col("y_pred"))})


def _moments() -> list[Column]:
    gap = F.col("_t") - F.col("_p")
    return [
        F.count("y_true").alias("n_observed"),
        F.count("_t").alias("n_valid"),
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.var_pop("_t").alias("_vt"),
        F.var_pop("_p").alias("_vp"),
        F.covar_pop("_t", "_p").alias("_c"),
    ]


def defined(n: Column, vt: Column, vp: Column) -> Column:
    return (n >= 2) & (F.sqrt(vt) > CONSTANT_STD) & (F.sqrt(vp) > CONSTANT_STD)


def pearson(n: Column, vt: Column, vp: Column, cov: Column) -> Column:
    r = cov / (F.sqrt(vt) * F.sqrt(vp))
    return F.when(defined(n, vt, vp), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def r_squared(n: Column, mse: Column, vt: Column) -> Column:
    """1 - SSres / SStot; NULL below two pairs or with (near) constant truth."""
    return F.when((n >= 2) & (vt * n > 1e-15), 1 - mse / vt)


def grouped_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """mse, mae, rmse, pcc, r2, n_valid, n_observed per key in a single aggregation."""
    n, vt, vp = F.col("n_valid"), F.col("_vt"), F.col("_vp")
    return (
        _pairs(cells).groupBy(*keys).agg(*_moments())
        .withColumns(
            {
                "rmse": F.sqrt("mse"),
                "pcc": pearson(n, vt, vp, F.col("_c")),
                "r2": r_squared(n, F.col("mse"), vt),
                "_defined": defined(n, vt, vp),
            }
        )
        .drop("_vt", "_vp", "_c")
    )


def spearman(cells: DataFrame, keys: list[str], weight: str | None = None, label: str = "ranks") -> DataFrame:
    """Spearman per key for groups of any size.

    Values are first summed to distinct ones, both sides are ranked by one bucketed scan, and the
    correlation is taken over distinct (truth, prediction) pairs, so a hot group or a hot value is
    spread over many tasks.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = (
        _pairs(cells).where("_t IS NOT NULL").groupBy(*keys, "_t", "_p").agg(F.sum(w).alias("_n"))
    )
    sides = pairs.select(
        *keys, "_n",
        F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("_t").alias("v")), F.struct(F.lit("p").alias("side"), F.col("_p").alias("v")))).alias("s"),
    ).select(*keys, "_n", "s.side", "s.v")
    ranks = average_ranks(sides, [*keys, "side"], "v", F.col("_n"), label)
    rank_t = ranks.where("side = 't'").select(*keys, F.col("v").alias("_t"), F.col("rank").alias("_rt"))
    rank_p = ranks.where("side = 'p'").select(*keys, F.col("v").alias("_p"), F.col("rank").alias("_rp"))
    joined = pairs.join(rank_t, [*keys, "_t"]).join(rank_p, [*keys, "_p"])
    n = F.col("_n")
    sums = joined.groupBy(*keys).agg(
        F.sum(n).alias("N"),
        F.sum(n * F.col("_rt") * F.col("_rp")).alias("tp"),
        F.sum(n * F.col("_rt") * F.col("_rt")).alias("tt"),
        F.sum(n * F.col("_rp") * F.col("_rp")).alias("pp"),
    )
    mean = (F.col("N") + 1) / 2  # average ranks always sum to N(N+1)/2
    cov = F.col("tp") / F.col("N") - mean * mean
    vt = F.col("tt") / F.col("N") - mean * mean
    vp = F.col("pp") / F.col("N") - mean * mean
    value = F.when((F.col("N") >= 2) & (vt > 0) & (vp > 0), cov / F.sqrt(vt * vp))
    return sums.select(*keys, value.alias("spearman"))


def spearman_bounded(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman for groups whose size is bounded by the feature count (one instance's features)."""
    side = [Window.partitionBy(*keys).orderBy(c) for c in ("_t", "_p")]
    same = [Window.partitionBy(*keys, c) for c in ("_t", "_p")]
    ranked = _pairs(cells).where("_t IS NOT NULL").withColumns(
        {
            "_rt": F.rank().over(side[0]) + (F.count("*").over(same[0]) - 1) / 2,
            "_rp": F.rank().over(side[1]) + (F.count("*").over(same[1]) - 1) / 2,
        }
    )
    stats = ranked.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.var_pop("_rt").alias("_vt"), F.var_pop("_rp").alias("_vp"), F.covar_pop("_rt", "_rp").alias("_c")
    )
    return stats.select(*keys, pearson(F.col("_n"), F.col("_vt"), F.col("_vp"), F.col("_c")).alias("spearman"))


def per_feature(cells: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, "feature"]
    scores = grouped_scores(cells, by)
    return scores.join(spearman(cells, by, label="feature-ranks"), by, "left").withColumn(
        "spearman", F.when(F.col("_defined"), F.col("spearman"))
    ).drop("_defined")


def per_sample(cells: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, "instance_id", "group_id"]
    scores = grouped_scores(cells, by)
    return scores.join(spearman_bounded(cells, by), by, "left").withColumn(
        "spearman", F.when(F.col("_defined"), F.col("spearman"))
    ).drop("_defined")


def coverage(cells: DataFrame, instances: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Observed over possible target cells; possible = instances x declared target features."""
    n_features = features.agg(F.count("*")).scalar()
    observed = cells.groupBy(*keys).agg(F.count("y_true").alias("n_observed"))
    return (
        instances.groupBy(*keys).agg(F.count("*").alias("n_instances")).withColumn("n_features", n_features)
        .join(observed, keys, "left")
        .withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))
        .withColumn("n_possible", F.col("n_instances") * F.col("n_features"))
        .withColumn("coverage", F.coalesce(F.try_divide("n_observed", "n_possible"), F.lit(0.0)))
    )


def macro(features: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means over features with a defined value, with how many were defined."""
    return features.groupBy(*keys).agg(
        F.avg("pcc").alias("pcc_macro"), F.count("pcc").alias("n_pcc"),
        F.avg("spearman").alias("spearman_macro"), F.count("spearman").alias("n_spearman"),
        F.avg("r2").alias("r2_macro"), F.count("r2").alias("n_r2"),
        F.count("*").alias("n_total"), F.count_if(F.col("pcc").isNull()).alias("n_undefined_pcc"),
    )


def scalars(cells: DataFrame, keys: list[str]) -> DataFrame:
    """All scalar metrics of a report, one row per key."""
    pooled = grouped_scores(cells, keys).withColumnsRenamed({"pcc": "pcc_pooled", "r2": "r2_pooled"})
    pooled = pooled.join(spearman(cells, keys, label="pooled-ranks").withColumnRenamed("spearman", "spearman_pooled"), keys, "left")
    pooled = pooled.withColumn("spearman_pooled", F.when(F.col("_defined"), F.col("spearman_pooled"))).drop("_defined")
    return pooled.join(macro(per_feature(cells, keys), keys), keys, "left")


def primary_value(table: DataFrame, metric: str) -> DataFrame:
    """The primary metric under its alias; an unknown name reads pcc_macro and carries a warning."""
    known = metric in PRIMARY_ALIASES
    return table.withColumns(
        {
            "primary_metric": F.lit(metric),
            "primary_value": F.col(PRIMARY_ALIASES.get(metric, "pcc_macro")),
            "warning": F.lit(None if known else f"primary_metric '{metric}' is not a computed name").cast("string"),
        }
    )


def prediction_mismatch(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Instance x feature keys present on only one side."""
    on = ["instance_id", "feature"]
    a = predictions.select(*on, F.lit(True).alias("predicted"))
    b = expected.select(*on, F.lit(True).alias("expected"))
    return a.join(b, on, "full").where("predicted IS NULL OR expected IS NULL")


def non_finite_predictions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Observed cells whose prediction is not finite: dropped from scores, still counted observed."""
    return cells.groupBy(*keys).agg(
        F.count_if(F.col("y_true").isNotNull() & ~finite(F.col("y_pred"))).alias("n_non_finite")
    )
