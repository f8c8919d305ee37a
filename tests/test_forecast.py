from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import forecast

OBS = "observation_id string, experimental_unit_id string, subject_id string, time double, condition string, batch string, split string"


def observations(spark, rows):
    return spark.createDataFrame([(o, u, u, t, c, "b", s) for o, u, t, c, s in rows], OBS)


def target(spark, rows):
    return spark.createDataFrame(rows, "observation_id string, feature string, scaled double")


@pytest.fixture(scope="module")
def walk(spark):
    obs = observations(spark, [(f"o{int(t)}", "u", t, "c", "train") for t in (0.0, 1.0, 2.0, 4.0)] + [("x", "lone", 0.0, "c", "val")])
    cells = target(spark, [("o0", "a", 1.0), ("o0", "b", 3.0), ("o1", "a", None), ("o2", "a", 5.0), ("o4", "a", 6.0), ("o4", "b", 7.0)])
    return obs, cells, forecast.unit_steps(obs, cells)


def test_walk_back_and_ids(walk):
    _, _, steps = walk
    rows = {r.target_time: r for r in forecast.subject_instances(steps).collect()}
    assert sorted(rows) == [1.0, 2.0, 4.0]  # the unit with one time has no instance
    assert rows[2.0].instance_id == "u:0.0->2.0" and rows[2.0].delta_t == 2.0  # o1 has no target value
    assert rows[4.0].instance_id == "u:2.0->4.0"


def test_horizon_two_stays_inside_the_history(walk):
    _, _, steps = walk
    rows = {r.target_time: r.history_time for r in forecast.subject_instances(steps, 2).collect()}
    assert rows == {2.0: 0.0, 4.0: 0.0}


def test_last_value_fills_with_the_row_mean(walk):
    _, cells, steps = walk
    inst = forecast.subject_instances(steps)
    out = {(r.target_time, r.feature): r.y_pred for r in forecast.own_last_value(forecast.instance_targets(inst, cells), cells).collect()}
    assert out == {(2.0, "a"): 1.0, (4.0, "a"): 5.0, (4.0, "b"): 5.0}


def test_sequence_gaps(walk):
    _, _, steps = walk
    seq = forecast.sequence_steps(steps).where("experimental_unit_id = 'u'").orderBy("time").collect()
    assert [r.step_dt for r in seq] == [0.0, 1.0, 1.0, 2.0]
    index = forecast.sequence_index(forecast.subject_instances(steps), steps)
    last = index.where("instance_id = 'u:2.0->4.0'").first()
    assert (last.length, last.target_dt) == (3, 2.0)


def test_duplicate_time_takes_the_last_observation(spark):
    obs = observations(spark, [("a1", "u", 0.0, "c", "train"), ("a2", "u", 0.0, "c", "train"), ("b", "u", 1.0, "c", "train")])
    steps = forecast.unit_steps(obs, target(spark, [("a1", "f", 1.0)]))
    assert {r.observation_id for r in steps.collect()} == {"a2", "b"}


def test_asof_tiers(spark):
    train = spark.createDataFrame([("c1", 1.0), ("c1", 3.0), ("c2", 5.0), ("c3", 3.0)], "condition string, time double")
    asked = spark.createDataFrame([("c1", 3.0), ("c1", 9.0), ("c1", 0.5), ("c1", 1.0), ("c2", 2.0), ("new", 4.0), ("new", 9.0), ("new", 0.0)], "condition string, target_time double")
    got = {(r.condition, r.target_time): (r.key_condition, r.key_time, r.used_fallback) for r in forecast.asof_keys(train, asked).collect()}
    assert got == {
        ("c1", 3.0): ("c1", 1.0, False), ("c1", 9.0): ("c1", 3.0, False), ("c1", 0.5): ("c1", 1.0, True), ("c1", 1.0): ("c1", 1.0, True),
        ("c2", 2.0): ("c2", 5.0, True), ("new", 4.0): ("c1", 3.0, True), ("new", 9.0): ("c2", 5.0, True), ("new", 0.0): ("c1", 1.0, True),
    }


def test_unseen_conditions(spark):
    a = spark.createDataFrame([("c1",), ("c9",)], "condition string")
    assert [r.condition for r in forecast.unseen_conditions(a, a.where("condition = 'c1'")).collect()] == ["c9"]


def test_hot_unit_is_scanned_in_buckets(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("o"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("observation_id"), F.lit("hot").alias("experimental_unit_id"), F.lit("hot").alias("subject_id"),
        F.col("id").cast("double").alias("time"), F.lit("c").alias("condition"), F.lit("b").alias("batch"), F.lit("train").alias("split"),
    )
    cells = rows.select("observation_id", F.lit("f").alias("feature"), F.when(F.col("time") % 2 == 0, F.col("time")).alias("scaled"))
    inst = forecast.subject_instances(forecast.unit_steps(rows, cells))
    bad = inst.where(F.col("history_time") != F.floor((F.col("target_time") - 1) / 2) * 2)
    assert inst.count() == 3999 and bad.count() == 0
