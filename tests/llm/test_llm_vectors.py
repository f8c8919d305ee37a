from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import ann, knn


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", F.lit(1).alias("code"), F.lit("x").alias("cell"), F.lit(2.0).alias("score"), F.lit(0).alias("query_id"))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[400:700] = x[400]  # a hot vector: ties everywhere
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [float("nan")] * 24), (5040, [None] * 24), (5060, [1.0] * 7), (None, x[0].tolist()), (5100, []), (5120, [float("inf")] * 24)]
    return x, rows, bad


def brute(ids, x, query, k, score):
    s = score(x, x[ids == query][0])
    keep = ids != query
    order = np.lexsort((ids[keep], -s[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))


def test_approximate_search_reaches_its_recall(spark, vectors, monkeypatch):
    x, rows, bad = vectors
    monkeypatch.setattr(ann, "ROWS", 400)  # several blocks on either side
    monkeypatch.setattr(ann, "QUERIES", 30)
    got = ann.neighbours(table(spark, rows + bad + [(6000, [0.0] * 24)]), F.col("vec_id") % 20 == 0, k=20).collect()
    ids, wide = np.arange(len(x)), x.astype(np.float64)
    answers = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        answers.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(answers) == list(range(0, 1500, 20))
    hits = 0
    for query, found in answers.items():
        want = brute(ids, wide, query, 20, lambda m, q: sum(m[:, j] * q[j] for j in range(24)))
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        scores = dict(zip(ids.tolist(), sum(wide[:, j] * wide[query, j] for j in range(24)).tolist()))
        assert all(scores[i] == s for i, s in found)
        hits += len(set(found) & set(want))
    assert hits >= 0.97 * 20 * len(answers)


def test_exact_search_matches_brute_force(spark, vectors, monkeypatch):
    x, rows, bad = vectors
    monkeypatch.setattr(knn, "ROWS", 100)
    monkeypatch.setattr(knn, "QUERIES", 4)
    got = knn.search(table(spark, rows + bad), F.col("vec_id") % 50 == 0, k=10).collect()
    ids, whole = np.arange(len(x)), np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for query in range(0, 1500, 50):
        found = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert found == brute(ids, whole, query, 10, lambda m, q: m @ q)
    assert len(got) == 30 * 10


def test_large_components_are_still_exact(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(60, 4)) * 2**17).astype(np.float32)
    got = knn.search(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    whole = [[int(c) for c in np.floor(1024 * v.astype(np.float64))] for v in x]
    scores = sorted(((-sum(a * b for a, b in zip(whole[0], w)), i) for i, w in enumerate(whole) if i), key=lambda s: s)[:5]
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in scores]


@pytest.mark.parametrize("search", [lambda t: ann.neighbours(t, F.col("vec_id") % 2 == 0, k=3), lambda t: knn.search(t, F.col("vec_id") % 2 == 0, k=3)])
def test_few_rows_no_rows_and_repeated_rows(spark, search):
    assert search(table(spark, [])).collect() == []
    assert search(table(spark, [(2, None), (None, [1.0, 2.0])])).collect() == []
    assert search(table(spark, [(2, [1.0, 2.0])])).collect() == []
    got = search(table(spark, [(2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1, 3), (2, 2, 3), (2, 3, 5)]


def test_many_rows_of_the_query_in_one_tight_cell(spark):
    query = spark.range(1200).orderBy(F.xxhash64("id")).first()["id"]  # its rows are pivots
    others = np.random.default_rng(7).normal(size=(1200, 6)).astype(np.float32)
    rows = [(query, [50.0] * 6)] * 12 + [(i, v.tolist()) for i, v in enumerate(others) if i != query]
    got = knn.search(table(spark, rows), F.col("vec_id") == query, k=10).collect()
    score = np.floor(1024 * others.astype(np.float64)).astype(np.int64) @ np.full(6, 50 * 1024)
    best = sorted((i for i in range(1200) if i != query), key=lambda i: (-score[i], i))[:10]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, score[i]) for i in best]


def test_recall_on_the_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found: dict[int, set] = {}
    for r in ann.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        hits += len(found[int(ids[at])] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.99 * 20 * len(found) and len(found) == (ids % 20 == 0).sum()


def test_rows_of_one_id_are_parted(spark, vectors, monkeypatch):
    """A third of all rows has one id: searches deal them to several blocks and chunks and find the same."""
    monkeypatch.setattr(ann, "ROWS", 50)
    monkeypatch.setattr(knn, "ROWS", 50)
    x, _, _ = vectors
    rows = [(7 if i % 3 == 0 else i, x[i].tolist()) for i in range(300)]
    got = ann.neighbours(table(spark, rows), F.col("vec_id") == 20, k=20).collect()
    wide = np.array([r[1] for r in rows])
    score = wide @ wide[20]
    order = [i for i in np.lexsort((np.array([r[0] for r in rows]), -score)) if rows[i][0] != 20][:20]
    assert sorted(r["vec_id"] for r in got) == sorted(rows[i][0] for i in order)
    exact = knn.search(table(spark, rows), F.col("vec_id") == 20, k=10).collect()
    whole = np.floor(1024 * wide).astype(int)
    want = sorted((-int(s), rows[i][0]) for i, s in enumerate(whole @ whole[20]) if rows[i][0] != 20)[:10]
    assert [(-r["score"], r["vec_id"]) for r in sorted(exact, key=lambda r: r["rank"])] == want
