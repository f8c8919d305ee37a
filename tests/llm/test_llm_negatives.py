from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import negatives

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def usable(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, dim):
    live = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, float)).astype(int)) for i, v, label in rows if i is not None and label is not None and usable(v, dim)]
    out = []
    for anchor, label, x in [r for r in live if r[0] % 50 == 0]:
        scored = sorted(((-int(v @ x), i, other) for i, other, v in live if i != anchor))
        same = [(-s, i) for s, i, other in scored if other == label][:5]
        for p, positive in same:
            window = [(-s, i) for s, i, other in scored if other != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i) in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("vec", "group", "chunk", "key", "block", "anchor_id")])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r[f] for f in FIELDS) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, label).collect())


def vectors(rng, n, dim, labels, spread):
    return [(i, [round(rng.uniform(-1, 1) / spread) * spread if spread else rng.uniform(-1, 1) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("spread", [0, 0.5])  # the second has many ties
def test_pairs_match_brute_force(spark, spread):
    rows = vectors(random.Random(8), 700, 6, 3, spread)
    assert found(spark, rows) == brute(rows, 6)


def test_cells_and_blocks_change_nothing(spark, monkeypatch):
    for name, value in (("ROWS", 40), ("ANCHORS", 4), ("STRIP", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(random.Random(9), 600, 5, 4, 0.5)
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in rows]  # one label has most rows
    assert found(spark, rows) == brute(rows, 5)


def test_a_large_group_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    rows = [(i, [0.5, 0.5] if i % 2 else [0.7, 0.7], i % 4) for i in range(400)]
    assert found(spark, rows) == brute(rows, 2)


def test_awkward_rows(spark):
    """Nulls anywhere, other lengths, zero and negative scores, labels below zero, one id with two vectors, repeated rows."""
    rows = vectors(random.Random(10), 120, 4, 3, 0.5)
    rows += [(None, [1.0] * 4, 1), (500, None, 1), (501, [1.0, None, 1.0, 1.0], 1), (502, [math.nan] * 4, 1), (503, [math.inf] * 4, 1), (504, [1.0] * 4, None), (550, [0.0] * 4, 2), (505, [1.0] * 3, 1), (600, [-1.0] * 4, -9)]
    assert found(spark, rows) == brute(rows, 4)
    twice = rows + [(50, [0.25] * 4, 2)]  # a second anchor of one id
    assert found(spark, twice) == brute(twice, 4)
    copies = rows + [r for r in rows if r[0] in (3, 4)]  # copies count as often as they occur
    assert found(spark, copies) == brute(copies, 4)


def test_without_anchors_positives_or_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(50, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(50, None, 1)]) == []


def test_keys_sort_as_score_kind_and_id():
    rng = np.random.default_rng(1)
    score, kind, ids = rng.integers(-3, 4, 500) * 10**15, rng.integers(0, 2, 500), rng.integers(-5, 6, 500) * 10**14
    keys = [k.tobytes() for k in negatives.pack(score, kind, ids)]
    order = sorted(range(500), key=keys.__getitem__)
    assert [(-score[i], kind[i], ids[i]) for i in order] == sorted(zip(-score, kind, ids))
    assert negatives.unpack(keys) == (score.tolist(), kind.tolist(), ids.tolist())
