from __future__ import annotations

import importlib

import corpus_pipeline
import pytest
from llm_cases import awkward, documents

from cohortflow.llm import pii, queries
from cohortflow.session import stage

SF = "/root/testdata/sf0.001"


def greedy(texts):
    """Ids that stay, by brute force: a document goes for a smaller one that stays and is 0.8 alike in five-word shingles."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    stays = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in stays):
            stays.append(i)
    return stays


def test_stages_are_the_dealt_ones_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    entry = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in entry and set(queries.QUERIES) < set(entry)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    expected = {"op5_neighbours": 25 * 20, "op9_exact_top_k": 5 * 10, "op8_packing": len(rows), "op12_prefix_trie": len(rows), "op13_hard_negatives": 10 * 5 * 3}
    assert len(rows) == expected.get(name, n)


def test_each_stage_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = stage(corpus_pipeline.drop_toxic(spark, docs, SF), "kept")
    left = {r["doc_id"] for r in kept.collect()}
    gone = {r["doc_id"] for r in docs.collect()} - left
    assert kept.columns == columns and all(labels.get(i, 1) for i in gone)
    single = stage(corpus_pipeline.drop_near_duplicates(spark, kept, SF), "single")
    stays = greedy({r["doc_id"]: r["text"] for r in kept.collect()})
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(stays)
    clean = stage(corpus_pipeline.redact_personal_data(spark, single, SF), "clean")
    assert clean.columns == columns and clean.count() == single.count()
    again = pii.find(clean, pii.Model((), (), {}))
    assert not [r for r in again.collect() if r["base"]]
    pieces = corpus_pipeline.pack(spark, clean, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in clean.collect()}


def test_stages_on_awkward_rows(spark):
    docs = documents(spark, awkward() + [(20, "mail a@b.cd now")])
    kept = stage(corpus_pipeline.drop_toxic(spark, docs, SF), "kept")
    assert kept.columns == docs.columns and kept.count() == docs.count()
    single = stage(corpus_pipeline.drop_near_duplicates(spark, kept, SF), "single").collect()
    # Null, empty and blank texts are one class, the seven words another; the long text repeats the seven words
    # but has many shingles of its own. Rows without an id stay.
    assert sorted((r["doc_id"] for r in single), key=repr) == sorted([1, 2, 7, 9, 9, 20, None, None], key=repr)
    clean = corpus_pipeline.redact_personal_data(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and texts[20] == "mail [EMAIL] now" and texts[2] is None


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, [])
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert out.collect() == []
        docs = out
        if "text" not in docs.columns:
            break
