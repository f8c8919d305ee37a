from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import arms, graph, validate

EDGE = "source_modality string, source_id string, target_modality string, target_id string, edge_type string, directed boolean, score double"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def test_weights_degree_and_quadratic_form(spark):
    e = edges(spark, [("m", "a", "m", "b", "physical_ppi", False, 0.5), ("m", "b", "m", "b", "physical_ppi", False, 0.9)])
    w = graph.symmetric_weights(e)
    assert {(r.i, r.j): r.weight for r in w.collect()} == {("m:a", "m:b"): 0.5, ("m:b", "m:a"): 0.5}
    states = spark.createDataFrame([("m:a", [1.0, 0.0]), ("m:b", [0.0, 1.0]), ("m:c", [1.0, 1.0])], "node string, state array<double>")
    assert graph.quadratic_form(w, states).first()[0] == pytest.approx(2.0)
    lap = {(r.i, r.j): r.value for r in graph.laplacian(w).collect()}
    assert lap == {("m:a", "m:a"): 0.5, ("m:b", "m:b"): 0.5, ("m:a", "m:b"): -0.5, ("m:b", "m:a"): -0.5}


def test_parallel_and_directed_edges_add_up(spark):
    e = edges(spark, [("m", "a", "m", "b", "gene_regulation", True, 0.2), ("m", "b", "m", "a", "physical_ppi", False, 0.3)])
    assert {r.weight for r in graph.symmetric_weights(e).collect()} == {0.5}


@pytest.fixture(scope="module")
def dense(spark):
    # A small dense graph makes self-loops certain, and one hub holds a third of the ends.
    rows = [("m", f"n{i % 8}", "m", f"n{(i * 3 + 1) % 8}", "physical_ppi", False, 0.01 * i) for i in range(60)]
    rows += [("m", "hub" if i % 3 == 0 else f"n{i % 8}", "p", f"q{i % 5}", "gene_regulation", True, 0.01 * i) for i in range(60)]
    return edges(spark, [r for r in rows if r[1] != r[3]])


def test_rewiring_keeps_degrees(spark, dense):
    new = graph.rewire(dense, seed=5).cache()
    key = ["edge_type", "directed", "node"]
    same = graph.incidence_degree(dense).join(graph.incidence_degree(new), key, "full").toPandas()
    assert (same.iloc[:, 3] == same.iloc[:, 4]).all()
    assert new.where("NOT randomized OR source_name <> 'degree_matched_random' OR is_causal").count() == 0
    assert new.count() == dense.count()
    changed = new.select(*dense.columns).exceptAll(dense).count()
    assert changed > dense.count() / 2
    scores = lambda d: sorted((r.edge_type, round(r.score, 6)) for r in d.collect())
    assert scores(new) == scores(dense)


def test_loops_are_repaired(dense):
    raw = graph.rewire(dense, seed=5, rounds=0).where("source_modality = target_modality AND source_id = target_id").count()
    fixed = graph.rewire(dense, seed=5, rounds=4).where("source_modality = target_modality AND source_id = target_id").count()
    assert raw > 0 and fixed < raw


def test_edge_labels(spark):
    rows = [
        ("ok", "IntAct", "physical_ppi", False, 0.5, False), ("phys", "STRING v12", "physical_ppi", False, 0.5, False), ("reg", "string-db", "gene_regulation", True, 0.5, False),
        ("dir", "x", "gene_regulation", False, 0.5, False), ("undir", "x", "functional_association", True, 0.5, False), ("score", "x", "physical_ppi", False, 1.5, False),
        ("cause", "x", "physical_ppi", False, 0.5, True), ("func", "STRING", "functional_association", False, 0.5, False),
    ]
    df = spark.createDataFrame(rows, "id string, source_name string, edge_type string, directed boolean, score double, is_causal boolean")
    got = {r.id: r.reason for r in validate.edge_violations(df).collect()}
    assert got == {
        "phys": "functional_source_as_physical", "reg": "functional_source_as_regulation", "dir": "directed_type_undirected",
        "undir": "undirected_type_directed", "score": "score_out_of_range", "cause": "causal",
    }


def test_pathway_activity_masks(spark):
    cells = spark.createDataFrame([("s", "rna", f"G0{i}", v) for i, v in ((1, 1.0), (2, 2.0), (3, 3.0), (4, None), (5, None))], "sample string, modality string, feature string, value double")
    members = spark.createDataFrame([("A", "rna", f"G0{i}") for i in (1, 2, 3, 4)] + [("B", "rna", "G05")], "pathway_id string, modality string, feature string")
    got = {r.pathway_id: (r.activity, r.mask) for r in graph.pathway_activity(cells, members, ["sample"], "value").collect()}
    assert got == {"A": (2.0, True), "B": (0.0, False)}


def test_mapping_and_embeddings(spark):
    e = edges(spark, [("m", "a", "m", "b", "physical_ppi", False, 0.5), ("m", "a", "m", "z", "physical_ppi", False, 0.5)])
    features = spark.createDataFrame([("m", "a"), ("m", "b")], "modality string, feature string")
    assert graph.mapping_counts(e, features).first().asDict() == {"n_edges": 2, "n_mapped": 1, "n_unmapped": 1}
    vectors = spark.createDataFrame([("m", "a", [1.0, 2.0])], "modality string, feature string, embedding array<double>")
    assert {r.feature: (r.embedding, r.mapped) for r in graph.feature_embeddings(features, vectors, 2).collect()} == {"a": ([1.0, 2.0], True), "b": ([0.0, 0.0], False)}
    bad = {(r.feature, r.reason) for r in validate.embedding_violations(vectors, features, 3).collect()}
    assert bad == {("a", "wrong_length"), ("b", "no_vector")}


def test_arm_switches_and_summary(spark):
    flags = {a: (arms.Arm(a).pathway, arms.Arm(a).graph, arms.Arm(a).embedding, arms.Arm(a).randomized) for a in arms.ARMS}
    assert flags == {
        "no_prior": (False, False, False, False), "graph_only": (False, True, False, False), "embedding_only": (False, False, True, False),
        "combined": (True, True, True, False), "random_graph": (False, True, False, True),
    }
    runs = spark.createDataFrame(
        [("no_prior", 1, 1.0, 0.5), ("no_prior", 2, 2.0, None), ("graph_only", 1, 0.9, 0.6), ("graph_only", 2, 1.8, 0.7), ("random_graph", 3, 1.34, 0.1)],
        "arm string, seed int, mse double, pcc_macro double",
    )
    table = {r.arm: r for r in arms.arm_summary(runs).collect()}
    assert list(table) == ["no_prior", "graph_only", "random_graph"]
    g = table["graph_only"]
    assert g.delta_mse_mean == pytest.approx(-0.15) and g.delta_pcc_n == 1 and g.delta_pcc_low == g.delta_pcc_mean == pytest.approx(0.1)
    half = 1.96 * (0.45 * 2**0.5) / 2**0.5
    assert g.mse_low == pytest.approx(1.35 - half) and table["random_graph"].delta_mse_mean is None
    assert arms.graph_note(arms.arm_summary(runs)).first().no_gain_claim


def test_structure_of_rewired_group_positions(dense):
    assert graph.rewire(dense, seed=1).where(F.col("directed")).select("target_modality").distinct().count() == 1
