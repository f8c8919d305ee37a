"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from cohortflow.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, shared_studies, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    assert compare(got, duck.execute(SQL[name]).df()) == ""


def test_registry_names_have_no_orphan_sql():
    assert set(SQL) <= set(QUERIES)
