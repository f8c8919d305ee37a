"""Forecast instances, their targets, last values and inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.scan import prefix_scan, range_buckets

INSTANCE_COLUMNS = [
    "instance_id", "group_id", "subject_id", "condition", "batch", "split", "target_time",
    "history_time", "delta_t", "target_observation", "history_observation",
]


def unit_steps(obs: DataFrame, target_cells: DataFrame, value: str = "scaled") -> DataFrame:
    """Distinct (unit, time) steps with the step number and the latest step so far that has any
    observed target. The last observation by id wins a duplicate (unit, time).

    A hot unit is cut into ordered buckets, so its history is never sorted in one task.
    """
    has_any = target_cells.where(F.col(value).isNotNull()).select("observation_id").distinct().withColumn("_has", F.lit(True))
    steps = (
        obs.join(has_any, "observation_id", "left")
        .groupBy("experimental_unit_id", "time")
        .agg(
            F.max_by(
                F.struct("observation_id", "subject_id", "condition", "batch", "split", F.coalesce("_has", F.lit(False)).alias("has_any")),
                "observation_id",
            ).alias("o")
        )
        .select("experimental_unit_id", "time", "o.*")
    )
    bucketed = range_buckets(steps, ["experimental_unit_id", "time"], "unit-steps")
    return prefix_scan(
        bucketed,
        ["experimental_unit_id"],
        ["time"],
        sums={"step": F.lit(1).cast("bigint")},
        maxes={"last_any": F.when(F.col("has_any"), F.struct("time", "observation_id"))},
        maxes_before={
            "before": F.struct("time", "observation_id"),
            "before_any": F.when(F.col("has_any"), F.struct("time", "observation_id")),
        },
    )


def subject_instances(steps: DataFrame, horizon: int = 1) -> DataFrame:
    """Target = step i, history = step i-h of the same unit, walked back to the latest earlier
    step with any observed target when the history step has none."""
    if horizon == 1:  # the scan already carries the previous step, so no join is needed
        joined = steps.where("step > 1").withColumn("h", F.coalesce("before_any", "before"))
    else:
        history = steps.select(
            "experimental_unit_id",
            (F.col("step") + horizon).alias("step"),
            F.coalesce("last_any", F.struct("time", "observation_id")).alias("h"),
        )
        joined = steps.join(history, ["experimental_unit_id", "step"])
    return joined.select(
        F.concat("experimental_unit_id", F.lit(":"), F.col("h.time").cast("string"), F.lit("->"), F.col("time").cast("string")).alias("instance_id"),
        F.col("experimental_unit_id").alias("group_id"),
        "subject_id", "condition", "batch", "split",
        F.col("time").alias("target_time"),
        F.col("h.time").alias("history_time"),
        (F.col("time") - F.col("h.time")).alias("delta_t"),
        F.col("observation_id").alias("target_observation"),
        F.col("h.observation_id").alias("history_observation"),
    )


def group_instances(obs: DataFrame, target_time_min: float) -> DataFrame:
    """Observations from ``target_time_min`` on; another unit's row is never used as history."""
    return obs.where(F.col("time") >= target_time_min).select(
        F.concat("experimental_unit_id", F.lit(":"), F.col("time").cast("string")).alias("instance_id"),
        F.col("experimental_unit_id").alias("group_id"),
        "subject_id", "condition", "batch", "split",
        F.col("time").alias("target_time"),
        F.lit(None).cast("double").alias("history_time"),
        F.lit(None).cast("double").alias("delta_t"),
        F.col("observation_id").alias("target_observation"),
        F.lit(None).cast("string").alias("history_observation"),
    )


def instance_targets(instances: DataFrame, target_cells: DataFrame, value: str = "scaled") -> DataFrame:
    """Observed target cells of each instance as ``y_true``."""
    cells = target_cells.where(F.col(value).isNotNull()).select(
        F.col("observation_id").alias("target_observation"), "feature", F.col(value).alias("y_true")
    )
    return instances.join(cells, "target_observation")


def own_last_value(targets: DataFrame, target_cells: DataFrame, value: str = "scaled") -> DataFrame:
    """``y_pred`` = the unit's value at the history observation; a gap takes the mean of that
    observation's observed targets, then 0."""
    known = target_cells.where(F.col(value).isNotNull())
    last = known.select(F.col("observation_id").alias("history_observation"), "feature", F.col(value).alias("_last"))
    mean = known.groupBy(F.col("observation_id").alias("history_observation")).agg(F.avg(value).alias("_mean"))
    return (
        targets.join(last, ["history_observation", "feature"], "left")
        .join(mean, "history_observation", "left")
        .withColumn("y_pred", F.coalesce("_last", "_mean", F.lit(0.0)))
        .drop("_last", "_mean")
    )


def condition_time_means(train_cells: DataFrame, value: str = "scaled") -> DataFrame:
    """Train mean per condition, time, modality and feature; missing cells are ignored."""
    return train_cells.groupBy("condition", "time", "modality", "feature").agg(F.avg(value).alias("mean"))


def asof_keys(train_obs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each distinct (condition, target_time): the train condition and time to read.

    Latest earlier train time of the condition; else its nearest train time; else the nearest train
    time of any condition (smaller time, then condition, on ties). Works on distinct keys only, by
    running maxima, so no pair of keys is ever enumerated.
    """
    keys = train_obs.select("condition", "time").distinct()
    asked = wanted.select("condition", "target_time").distinct()
    merged = keys.select(
        "condition", F.col("time").alias("at"), F.lit(1).alias("is_key")
    ).unionByName(asked.select("condition", F.col("target_time").alias("at"), F.lit(0).alias("is_key")))
    # A key at the target time is not earlier: queries sort before keys of the same time.
    bucketed = range_buckets(merged, ["condition", "at", "is_key"], "asof")
    scanned = prefix_scan(
        bucketed, ["condition"], ["at", "is_key"], maxes={"earlier": F.when(F.col("is_key") == 1, F.col("at"))}
    ).where("is_key = 0").select("condition", F.col("at").alias("target_time"), "earlier")
    first = keys.groupBy("condition").agg(F.min("time").alias("first_time"))
    out = scanned.join(first, "condition", "left").select(
        "condition", "target_time",
        F.when(F.col("first_time").isNotNull(), F.col("condition")).alias("key_condition"),
        F.coalesce("earlier", "first_time").alias("key_time"),
        F.col("earlier").isNull().alias("used_fallback"),
    )
    unseen = asked.join(keys, "condition", "left_anti")
    if unseen.isEmpty():
        return out
    return out.where("key_condition IS NOT NULL").unionByName(_nearest_any(keys, unseen))


def _nearest_any(keys: DataFrame, asked: DataFrame) -> DataFrame:
    by_time = keys.groupBy("time").agg(F.min("condition").alias("key_condition"))
    times = asked.select("target_time").distinct()

    def side(sign: int, label: str, out: str) -> DataFrame:
        merged = by_time.select(
            (F.col("time") * sign).alias("at"), F.struct((F.col("time") * sign).alias("o"), "time", "key_condition").alias("k"), F.lit(0).alias("is_query")
        ).unionByName(
            times.select((F.col("target_time") * sign).alias("at"), F.lit(None).cast("struct<o:double,time:double,key_condition:string>").alias("k"), F.lit(1).alias("is_query"))
        )
        scanned = prefix_scan(range_buckets(merged, ["at", "is_query"], label), [], ["at", "is_query"], maxes={out: F.col("k")})
        return scanned.where("is_query = 1").select((F.col("at") * sign).alias("target_time"), out)

    both = side(1, "asof-below", "below").join(side(-1, "asof-above", "above"), "target_time")
    below_gap, above_gap = F.col("target_time") - F.col("below.time"), F.col("above.time") - F.col("target_time")
    use_below = F.col("above").isNull() | (F.col("below").isNotNull() & (below_gap <= above_gap))
    pick = F.when(use_below, F.col("below")).otherwise(F.col("above"))
    near = both.select("target_time", pick.alias("k"))
    return asked.join(near, "target_time", "left").select(
        "condition", "target_time", "k.key_condition", F.col("k.time").alias("key_time"), F.lit(True).alias("used_fallback")
    )


def group_last_value(targets: DataFrame, keys: DataFrame, means: DataFrame) -> DataFrame:
    """``y_pred`` and Δt from the as-of train mean; a missing mean becomes 0."""
    table = means.select(F.col("condition").alias("key_condition"), F.col("time").alias("key_time"), "feature", "mean")
    return (
        targets.drop("delta_t").join(keys, ["condition", "target_time"], "left")
        .join(table, ["key_condition", "key_time", "feature"], "left")
        .withColumn("delta_t", F.col("target_time") - F.col("key_time"))
        .withColumn("y_pred", F.coalesce("mean", F.lit(0.0)))
        .drop("mean")
    )


def sequence_steps(steps: DataFrame) -> DataFrame:
    """Ordered steps of each unit with the gap to the previous step, 0 on the first.

    Every instance of a unit reads a prefix of this list (see ``sequence_index``), so one copy of
    the steps serves all instances instead of one copy per instance.
    """
    return steps.select(
        "experimental_unit_id", "step", "time", "observation_id",
        F.coalesce(F.col("time") - F.col("before.time"), F.lit(0.0)).alias("step_dt"),
    )


def sequence_index(instances: DataFrame, steps: DataFrame) -> DataFrame:
    """Per instance: how many leading steps of its unit form the history, and the gap to the target."""
    length = steps.select(F.col("experimental_unit_id").alias("group_id"), F.col("time").alias("history_time"), F.col("step").alias("length"))
    return instances.join(length, ["group_id", "history_time"]).select(
        "instance_id", "group_id", "condition", "length", F.col("delta_t").alias("target_dt")
    )


def sequence_values(sequence: DataFrame, cells: DataFrame, value: str = "scaled") -> DataFrame:
    """Values and mask of every step: a missing cell reads 0 with mask false."""
    known = cells.select("observation_id", "modality", "feature", value)
    return sequence.join(known, "observation_id").select(
        "experimental_unit_id", "step", "modality", "feature",
        F.coalesce(value, F.lit(0.0)).alias("value"), F.col(value).isNotNull().alias("observed"),
    )


def unseen_conditions(instances: DataFrame, train_obs: DataFrame) -> DataFrame:
    """Conditions asked for at predict time that no train observation has."""
    return instances.select("condition").distinct().join(train_obs.select("condition").distinct(), "condition", "left_anti")
