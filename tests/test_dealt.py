from __future__ import annotations

import pytest
from oracle import compare, connect

from cohortflow import session
from cohortflow.plans import graph_queries, proxies
from cohortflow.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def parts_of(df):
    """Parts of the stages below the last aggregation: what one task joins and groups at a time."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(line.split("), REPARTITION_BY_NUM")[0].rsplit(", ", 1)[1]) for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]


@pytest.mark.parametrize("build", [graph_queries.supply_edges, proxies.order_cells])
def test_parts_grow_with_the_rows(spark, monkeypatch, build):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for share in (20, 40):
        monkeypatch.setattr(session, "PART_ROWS", rows // share)
        found = parts_of(build(spark, SF))
        assert len(found) >= 2 and min(found) >= share


@pytest.mark.parametrize("name", ["degree", "graph_weights", "laplacian", "cpm_log1p", "pathway_activity", "intensity_log2", "scaler_fit"])
def test_dealt_queries_match_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(session, "PART_ROWS", 300)
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(SQL[name]).df()) == ""
