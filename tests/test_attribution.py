from __future__ import annotations

import numpy as np
import pytest

from cohortflow.operators import attribution, linear

UNITS = "group_id string, source string, target string, s double, n bigint"


def units(spark):
    rows = []
    for u in range(4):
        rows += [(f"U{u}", "rna:G01", "P1", 9.0, 9), (f"U{u}", "rna:G02", "P1", 0.9 if u % 2 else -0.9, 9)]
    return spark.createDataFrame(rows, UNITS)


@pytest.fixture(scope="module")
def table(spark):
    empty = spark.createDataFrame([], "source string, target string, ablation_delta double")
    perm = empty.withColumnRenamed("ablation_delta", "permutation_delta")
    config = attribution.StabilityConfig(n_bootstrap=20, top_k_per_target=1)
    return attribution.stability_table(units(spark), empty, perm, config, 3, "protein").cache()


def test_constant_attribution_is_stable(table):
    hit = table.where("source_id = 'G01'").first()
    assert hit.sign_consistency == 1.0 and hit.mean_attribution == 1.0 and hit.selection_frequency == 1.0 and hit.stability == 1.0
    assert (hit.bootstrap_low, hit.bootstrap_high) == (1.0, 1.0)
    assert hit.passed_stability and hit.predicted_direction == "up" and hit.candidate_id == "rna:G01->protein:P1"
    weak = table.where("source_id = 'G02'").first()
    assert not weak.passed_stability and weak.rank_median == 2 and weak.selection_frequency == 0.0


def test_every_row_is_a_hypothesis(table):
    assert {(r.claim_kind, r.caveat) for r in table.collect()} == {("hypothesis", attribution.CAVEAT)}


def test_top_n_holds_passed_rows_only(table):
    assert [r.source_id for r in attribution.select_stable(table, 5).collect()] == ["G01"]
    assert [r.source_id for r in attribution.ordered_candidates(table).collect()] == ["G01", "G02"]


def test_folds_are_contiguous_with_the_remainder_first(spark):
    rows = [(f"U{i:02d}", "a", "b", float(i), 1) for i in range(7)]
    out = {r.fold: r.value for r in attribution.fold_means(spark.createDataFrame(rows, UNITS), 3).collect()}
    assert out == {0: 1.0, 1: 3.5, 2: 5.5}
    assert attribution.fold_means(spark.createDataFrame(rows[:3], UNITS), 10).count() == 3


def test_permutation_keeps_each_stratum(spark):
    rows = spark.createDataFrame([(f"i{k}", "big" if k else "single") for k in range(50)], "instance_id string, condition string")
    pairs = attribution.permuted_partners(rows, 3, 1).toPandas()
    for _, part in pairs.groupby("seed"):
        assert sorted(part.instance_id) == sorted(part.partner_id) == sorted(f"i{k}" for k in range(50))
        assert part.set_index("instance_id").partner_id["i0"] == "i0"
    assert (pairs.instance_id != pairs.partner_id).mean() > 0.8


def test_permutation_delta_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    n, names = 30, ["rna:a", "rna:b"]
    x, y, coef = rng.normal(size=(n, 2)), rng.normal(size=n), np.array([0.5, -1.0])
    pred = x @ coef
    rows = spark.createDataFrame([(f"i{k}", "c", x[k].tolist(), [0], [float(y[k])]) for k in range(n)], "instance_id string, condition string, x array<double>, t array<int>, y array<double>")
    coefs = spark.createDataFrame([(0, coef.tolist(), 0.0)], "t int, coef array<double>, intercept double")
    heads = [linear.Header(spark.createDataFrame([(v, i) for i, v in enumerate(h)], "name string, at int"), len(h)) for h in (names, ["P"])]
    got = {r.source: r.permutation_delta for r in attribution.permutation_delta(rows, coefs, *heads, 2, 2, 4).collect()}
    pairs = attribution.permuted_partners(rows, 2, 4).toPandas()
    for s, name in enumerate(names):
        drops = []
        for _, part in pairs.groupby("seed"):
            other = part.set_index("instance_id").partner_id
            moved = x.copy()
            moved[:, s] = [x[int(other[f"i{k}"][1:]), s] for k in range(n)]
            drops.append(((moved @ coef - y) ** 2).mean() - ((pred - y) ** 2).mean())
        assert got[name] == pytest.approx(np.mean(drops))


def test_factored_stability_equals_the_long_form(spark):
    """Replicates, folds, ranks and bounds from unit sums and coefficients, against rows for every instance, pair and baseline."""
    rng = np.random.default_rng(6)
    n, names, targets = 60, ["rna:a", "rna:b", "rna:c", "rna:d"], ["P", "Q"]
    x, coef = rng.normal(size=(n, 6)), rng.normal(size=(2, 6))
    x[:, 3] = x[:, 2]
    coef[:, 3] = coef[:, 2]  # a tie of ranks
    rows = spark.createDataFrame([(f"i{k}", f"U{k % 7}", x[k].tolist()) for k in range(n)], "instance_id string, group_id string, x array<double>").repartition(3)
    heads = [linear.Header(spark.createDataFrame([(v, i) for i, v in enumerate(h)], "name string, at int"), len(h)) for h in (names, targets)]
    coefs = spark.createDataFrame([(t, coef[t].tolist(), 0.0) for t in range(2)], "t int, coef array<double>, intercept double")
    base = spark.createDataFrame([("rna:a", 0.3), ("rna:c", -0.2)], "source string, baseline_value double")
    config = attribution.StabilityConfig(n_bootstrap=9, n_folds=3, top_k_per_target=2)
    long = attribution.linear_attributions(rows, linear.named_targets(coefs, heads[1]), heads[0], base)
    want = attribution.pair_stability(attribution.unit_attributions(long), config, 5).toPandas().sort_values(["source", "target"])
    got = attribution.linear_stability(attribution.unit_gaps(rows, heads[0], 6, base), coefs, *heads, config, 5).toPandas().sort_values(["source", "target"])
    assert len(got) == len(want) == 8
    for c in want.columns:
        assert list(got[c]) == list(want[c]) if c in ("source", "target") else np.allclose(got[c], want[c]), c


def test_prior_flags(spark):
    c = spark.createDataFrame([("rna:a", "protein:p"), ("rna:b", "protein:p"), ("rna:c", "protein:q")], "source string, target string")
    edges = spark.createDataFrame([("protein", "p", "rna", "a")], "source_modality string, source_id string, target_modality string, target_id string")
    paths = spark.createDataFrame([("PW1", "rna", "b"), ("PW1-PROT", "protein", "p"), ("PW2", "rna", "c")], "pathway_id string, modality string, feature string")
    vectors = spark.createDataFrame([("rna", "a", [0.0, 1.0]), ("rna", "b", [0.0, 0.0]), ("protein", "p", [2.0, 0.0])], "modality string, feature string, embedding array<double>")
    got = {r.source: (r.prior_edge_used, r.embedding_supported, r.de_novo_model_edge) for r in attribution.prior_flags(c, edges, paths, vectors).collect()}
    assert got == {"rna:a": (True, True, False), "rna:b": (True, False, False), "rna:c": (False, False, True)}
