"""Inputs past the bounds that earlier versions had."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import graph
from cohortflow.operators.fingerprint import fingerprint
from cohortflow.session import clean, stage
from cohortflow.sources import files, landed


def test_responses_are_walked_to_any_depth_in_document_order(spark):
    doc = {"files": [{"path": "bottom.tsv"}], "attributes": [{"name": "depth", "value": "bottom"}]}
    for level in range(20):
        doc = {"attributes": [{"name": "level", "value": str(level)}], "subsections": [doc]}
    # The deep early value comes before the shallow late one, so the late one counts.
    doc = {"first": {"a": {"b": {"attributes": [{"name": "kind", "value": "early"}]}}}, "deep": doc, "attributes": [{"name": "kind", "value": "root"}], "last": {"attributes": [{"name": "kind", "value": "late"}]}}
    rows = spark.createDataFrame([("S-1", json.dumps(doc)), ("S-2", "{}"), ("S-3", None), ("S-4", "no json")], "acc string, j string")
    nodes = stage(landed.json_nodes(rows, "j", ["acc"]), "nodes")
    assert [r.filename for r in landed.study_files(nodes, "acc", ["acc"]).collect()] == ["bottom.tsv"]
    found = {r.name: r.value for r in landed.study_attributes(nodes, ["acc"]).collect()}
    assert found == {"depth": "bottom", "level": "0", "kind": "late"}


def test_fingerprints_see_every_change(spark):
    values = [0.0, 1e-9, 3e-7, 1e40, -1e40, float("nan"), float("inf"), float("-inf"), None, 1.000000001, 123456789.1]
    digests = {repr(v): fingerprint(spark.createDataFrame([(v,)], "x double"), "t").first().digest for v in values}
    assert len(set(digests.values())) == len(values)
    same = lambda a, b: fingerprint(spark.createDataFrame([(a,)], "x double"), "t").first().digest == fingerprint(spark.createDataFrame([(b,)], "x double"), "t").first().digest
    assert same(0.0, -0.0) and same(1 / 3, 0.33333333333)
    lists = [fingerprint(spark.createDataFrame([(v,)], "x array<float>"), "t").first().digest for v in ([1.0, 2.0], [2.0, 1.0], [], None, [None])]
    assert len(set(lists)) == 5


def test_receipts_belong_to_a_data_set(spark):
    inventory = spark.createDataFrame([("a", "m.tsv", None, None, None), ("b", "m.tsv", "old", None, 3)], "dataset_id string, filename string, path string, sha256 string, size_bytes bigint")
    receipts = spark.createDataFrame([("a", "m.tsv", "x/1", "h1", 1), ("a", "m.tsv", "x/2", "h2", 2)], "dataset_id string, filename string, dest string, sha256 string, bytes_written bigint")
    got = {r.dataset_id: (r.path, r.sha256, r.size_bytes) for r in files.apply_receipts(inventory, receipts).collect()}
    assert got == {"a": ("x/2", "h2", 2), "b": ("old", None, 3)}


def test_long_files_are_hashed_in_pieces(spark, tmp_path):
    body = bytes(range(256)) * 40_000
    (tmp_path / "long one.bin").write_bytes(body)
    (tmp_path / "short.bin").write_bytes(b"x")
    got = {r.filename: (r.size_bytes, r.sha256, r.md5) for r in files.landed_digests(spark, str(tmp_path), whole=1000).collect()}
    want = {"long one.bin": body, "short.bin": b"x"}
    assert {k.replace("%20", " "): v for k, v in got.items()} == {k: (len(b), hashlib.sha256(b).hexdigest(), hashlib.md5(b).hexdigest()) for k, b in want.items()}


@pytest.mark.parametrize("directed", [True, False])
def test_rewiring_parallel_edges_keeps_rows_and_degrees(spark, directed):
    rows = [("m", f"n{i % 4}", "m", f"q{i % 3}", "physical_ppi", directed, 0.5) for i in range(48)] + [("m", "hub", "m", f"x{i % 20}", "physical_ppi", directed, 0.5) for i in range(40)]
    schema = "source_modality string, source_id string, target_modality string, target_id string, edge_type string, directed boolean, score double"
    edges = spark.createDataFrame(rows, schema)
    for seed in (1, 2):
        new = stage(graph.rewire(edges, seed), "rewired-test")
        assert new.count() == len(rows)
        key = ["edge_type", "directed", "node"]
        both = graph.incidence_degree(edges).join(graph.incidence_degree(new).withColumnRenamed("degree", "other"), key, "full").collect()
        assert all(r.degree == r.other for r in both)
        assert new.where(F.col("source_id") == F.col("target_id")).count() == 0


def test_staged_tables_are_removed(spark):
    import os

    kept = stage(spark.range(3), "kept")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    clean(spark)
    assert not os.path.exists(path)
