from __future__ import annotations

from cohortflow.plans.catalog import QUERIES, SQL


def test_the_order_study_is_searched_too(spark, monkeypatch):
    from cohortflow.plans import study_queries

    built = []
    whole = study_queries.order_study
    monkeypatch.setattr(study_queries, "order_study", lambda *a: built.append(a) or whole(*a))
    got = QUERIES["val_unfillable_features"](spark, "/root/testdata/sf0.001").toPandas()
    assert built and "p2_norm" in SQL["val_unfillable_features"]
    assert {"rna", "protein", "orders"} >= set(got["modality"]) >= {"orders"}
