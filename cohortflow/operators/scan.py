"""Running totals and running extremes that never put a whole group in one task.

A plain window over a hot key sorts that key in a single task. Here the rows are first cut into
ordered buckets, each bucket is scanned on its own, and the bucket totals (a few rows per key)
carry the prefix across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.hashing import digest_int
from cohortflow.session import stage

BUCKET = "_bucket"


def digest_buckets(df: DataFrame, digest: str, digits: int = 3) -> DataFrame:
    """Buckets for rows ordered by a hex digest: its leading digits are uniform and ordered."""
    return df.withColumn(BUCKET, digest_int(F.col(digest), 1, digits).cast("int"))


def hash_buckets(df: DataFrame, value: str) -> DataFrame:
    """Buckets for rows ordered by a 64-bit hash: its leading twelve bits are uniform and ordered."""
    return df.withColumn(BUCKET, F.shiftright(F.col(value), 52).cast("int"))


def range_buckets(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Equal-sized ordered buckets from a range partitioning, written once so they stay fixed."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return stage(ranged.withColumn(BUCKET, F.spark_partition_id()), label)


def prefix_scan(
    bucketed: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    maxes_before: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima of each key's rows in ``order``, ``maxes_before`` without the row itself.

    ``bucketed`` must come from one of the bucket functions over ``keys + order``.
    """
    sums, maxes, earlier = sums or {}, maxes or {}, maxes_before or {}
    maxes = {**maxes, **earlier}
    totals = bucketed.groupBy(*keys, BUCKET).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxes.items()],
    )
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxes],
    )
    within = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    strictly = within.rowsBetween(Window.unboundedPreceding, -1)
    scanned = bucketed.select(
        "*",
        *[F.sum(c).over(within).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.max(c).over(strictly if n in earlier else within).alias(f"_l_{n}") for n, c in maxes.items()],
    ).join(offsets, [*keys, BUCKET])
    return scanned.select(
        *[c for c in bucketed.columns if c != BUCKET],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_o_{n}").alias(n) for n in maxes],
    )


def shuffled_position(df: DataFrame, keys: list[str], digest: str, tie: list[str]) -> DataFrame:
    """1-based position of each row of a key under a seeded digest order, as ``position``."""
    return prefix_scan(
        digest_buckets(df, digest), keys, [digest, *tie], sums={"position": F.lit(1).cast("bigint")}
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: Column, label: str) -> DataFrame:
    """Tie-averaged ranks of the distinct values of each key, weights counting as copies.

    Returns ``keys, value, rank, n`` with one row per distinct value; duplicates are summed before
    any shuffle by value order.
    """
    distinct = df.groupBy(*keys, value).agg(F.sum(weight).cast("double").alias("n"))
    bucketed = range_buckets(distinct, [*keys, value], label)
    ranked = prefix_scan(bucketed, keys, [value], sums={"_cum": F.col("n")})
    return ranked.select(
        *keys, value, (F.col("_cum") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), "n"
    )


def exact_quantiles(df: DataFrame, value: str, probs: list[float], label: str) -> list[float]:
    """Linear-interpolated quantiles of a column; only ``2 * len(probs)`` numbers reach the driver."""
    bucketed = range_buckets(
        df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), [value], label
    )
    total = bucketed.agg(F.sum("n")).first()[0]
    if not total:
        return []
    ranked = prefix_scan(bucketed, [], [value], sums={"_cum": F.col("n")})
    spots = [(total - 1) * p for p in probs]
    wanted = sorted({int(s) for s in spots} | {min(int(s) + 1, total - 1) for s in spots})
    hit = ranked.select(
        F.col(value).alias("v"),
        F.explode(
            F.filter(
                F.array(*[F.lit(w) for w in wanted]),
                lambda w: (w < F.col("_cum")) & (w >= F.col("_cum") - F.col("n")),
            )
        ).alias("at"),
    )
    found = {r["at"]: r["v"] for r in hit.collect()}
    return [
        found[int(s)] + (s - int(s)) * (found[min(int(s) + 1, total - 1)] - found[int(s)]) for s in spots
    ]
