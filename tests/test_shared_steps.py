"""Steps that several models share are done once."""

from __future__ import annotations

from cohortflow.plans import proxies, runs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_models_share_instances_and_their_targets(spark):
    data = proxies.event_forecast(spark, SF)
    assert "Window" not in plan(data.instances) and "Join" not in plan(data.observed)
    spline = runs.TimeSpline(data, 4)
    for rows in (data.design(), spline.rows("val")):
        assert "Window" not in plan(rows) and "collect_list(struct(t" not in plan(rows)
    targets = {(r.instance_id, r.feature): r.y_true for r in data.targets.collect()}
    index = {r["at"]: r["name"] for r in data.target_names.table.collect()}
    packed = {(r.instance_id, index[t]): y for r in data.observed.collect() for t, y in zip(r.t, r.y)}
    assert packed == targets
    known = data.observed.select("instance_id").distinct().count()
    assert data.rows.count() == known == len({i for i, _ in targets})
