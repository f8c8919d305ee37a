"""Prior-knowledge arms on the ridge model, and their comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.operators.linear import Header, Moments, WideRows, ridge_fit, spread

# Arm order and switches.
ARMS = ["no_prior", "graph_only", "embedding_only", "combined", "random_graph"]
GRAPH_ARMS = ["graph_only", "combined", "random_graph"]
EMBEDDING_ARMS = ["embedding_only", "combined"]
CLOSE_MSE = 0.02


@dataclass(frozen=True)
class Arm:
    name: str

    @property
    def pathway(self) -> bool:
        return self.name == "combined"

    @property
    def graph(self) -> bool:
        return self.name in GRAPH_ARMS

    @property
    def embedding(self) -> bool:
        return self.name in EMBEDDING_ARMS

    @property
    def randomized(self) -> bool:
        return self.name == "random_graph"


def penalty_entries(laplacian: DataFrame, names: Header, weight: float) -> DataFrame:
    """The Laplacian's entries (i, j, value) over the input columns of a design, times a weight; it stays an edge table."""
    at = names.table.select("name", "at")
    rows = laplacian.join(at.select(F.col("name").alias("i"), F.col("at").alias("_i")), "i").join(at.select(F.col("name").alias("j"), F.col("at").alias("_j")), "j")
    return rows.select(F.col("_i").alias("i"), F.col("_j").alias("j"), (F.col("value") * weight).alias("value"))


def arm_coefficients(mom: Moments | WideRows, ranges: list[tuple[int, int]], width: int, alpha: float, penalty: DataFrame | None) -> DataFrame:
    """Ridge coefficients of one arm, which has the columns in ``ranges``, padded with zeros to the full design.

    The penalty is on the input columns, which every arm has first.
    """
    return spread(ridge_fit(mom.part(ranges), alpha, penalty), ranges, width)


def mean_ci(value: str, prefix: str) -> list:
    """Mean with a 95% normal interval; one value is its own interval, none is NULL."""
    half = F.when(F.count(value) > 1, 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).when(F.count(value) == 1, 0.0)
    return [
        F.avg(value).alias(f"{prefix}_mean"), (F.avg(value) - half).alias(f"{prefix}_low"),
        (F.avg(value) + half).alias(f"{prefix}_high"), F.count(value).alias(f"{prefix}_n"),
    ]


def paired_deltas(runs: DataFrame, baseline: str = "no_prior") -> DataFrame:
    """Each arm minus the baseline arm of the same seed; unpaired seeds are dropped."""
    base = runs.where(F.col("arm") == baseline).select("seed", F.col("mse").alias("_mse"), F.col("pcc_macro").alias("_pcc"))
    return runs.join(base, "seed").select(
        "arm", "seed", (F.col("mse") - F.col("_mse")).alias("delta_mse"), (F.col("pcc_macro") - F.col("_pcc")).alias("delta_pcc")
    )


MEASURES = ["mse", "mae", "pcc_macro", "primary_value", "n_parameters", "seconds"]


def arm_rank():
    col = F.lit(99)
    for i, name in enumerate(ARMS):
        col = F.when(F.col("arm") == name, i).otherwise(col)
    return col


def arm_summary(runs: DataFrame) -> DataFrame:
    """Per arm: intervals of the measures and of the paired deltas, in fixed arm order."""
    measures = [m for m in MEASURES if m in runs.columns]
    own = runs.groupBy("arm").agg(F.count("*").alias("n_seeds"), *reduce(lambda a, b: a + b, [mean_ci(m, m) for m in measures]))
    delta = paired_deltas(runs).groupBy("arm").agg(*mean_ci("delta_mse", "delta_mse"), *mean_ci("delta_pcc", "delta_pcc"))
    return own.join(delta, "arm", "left").withColumn("arm_rank", arm_rank()).orderBy("arm_rank", "arm")


def graph_note(summary: DataFrame) -> DataFrame:
    """One row saying whether the real and the random graph are too close to claim a gain."""
    pick = summary.agg(
        F.max(F.when(F.col("arm") == "graph_only", F.col("mse_mean"))).alias("graph_mse"),
        F.max(F.when(F.col("arm") == "random_graph", F.col("mse_mean"))).alias("random_mse"),
    )
    close = F.abs(F.col("graph_mse") - F.col("random_mse")) < CLOSE_MSE
    return pick.withColumn("no_gain_claim", F.coalesce(close, F.lit(False)))
