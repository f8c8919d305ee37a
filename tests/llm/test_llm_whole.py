from __future__ import annotations

import corpus_pipeline
from llm_cases import documents

from cohortflow.llm import copies, pii, simhash


def test_trees_learn_from_every_document(spark, monkeypatch):
    docs = documents(spark, [(i, "mail ab@c.de") for i in range(25_000)])
    seen = []
    whole = pii.stage
    monkeypatch.setattr(pii, "stage", lambda df, label: seen.append(whole(df, label)) or seen[-1])
    pii.fit(docs, trees=1, depth=1)
    assert seen[0].where("label = 1").count() == 2 * 25_000  # each address as it is and spelt out


def test_near_fingerprints_are_candidates(spark):
    rows = [(1, 0, 10, 0), (2, 0, 10, 0b11), (3, 0, 10, 0), (4, 0, 10, 0xFFFF)]
    found = copies._near_prints(spark.createDataFrame(rows, "id bigint, digest bigint, n bigint, fp bigint"))
    assert sorted((r.a.id, r.b.id) for r in found.collect()) == [(1, 2), (1, 3)]


def test_the_pipeline_links_fingerprints(spark, monkeypatch):
    linked = []
    whole = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a, **b: linked.append(a) or whole(*a, **b))
    words = [f"w{i}" for i in range(40)]
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "a b c d e f g h")])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert linked
