"""What is done by observation stays in the parts that the cells of orders were dealt into."""

from __future__ import annotations

from cohortflow import session
from cohortflow.operators import graph
from cohortflow.plans import graph_queries, proxies, study_queries

SF = "/root/testdata/sf0.001"


def shuffles(df):
    """Shuffles of a plan from the top down to the first dealing."""
    lines = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    dealing = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert dealing
    return lines[: dealing[0]]


def test_library_sums_need_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 300)
    assert shuffles(study_queries.cpm_log1p(spark, SF)) == []


def test_pathway_means_need_no_shuffle(spark, monkeypatch):
    written, stage = {}, graph.stage
    monkeypatch.setattr(session, "PART_ROWS", 300)
    monkeypatch.setattr(graph, "stage", lambda df, label: written.setdefault(label, df) and stage(df, label))
    graph_queries.pathway_activity(spark, SF)
    assert shuffles(written["pathway-means"]) == []


def test_samples_without_a_pathway_or_a_value_stay(spark):
    rows = [("s", "rna", "a", 2.0), ("s", "rna", "z", 9.0), ("none", "rna", "z", 1.0), ("gap", "rna", "a", None)]
    cells = spark.createDataFrame(rows, "sample string, modality string, feature string, value double")
    members = spark.createDataFrame([("A", "rna", "a"), ("B", "rna", "b")], "pathway_id string, modality string, feature string")
    got = {(r.sample, r.pathway_id): (r.activity, r.mask) for r in graph.pathway_activity(cells, members, ["sample"], "value").collect()}
    assert got == {(s, p): (2.0, True) if (s, p) == ("s", "A") else (0.0, False) for s in ("s", "none", "gap") for p in "AB"}


def test_instances_do_not_gather_by_condition_and_time(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 60)
    data = proxies.order_forecast(spark, SF)
    rows = data.design()
    assert shuffles(rows) == []
    assert rows.count() == data.observed.count() == data.targets.select("instance_id").distinct().count()
