"""End-to-end runs over a small seeded study written as user tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import arms, graph
from cohortflow.plans import runs
from cohortflow.sources import sinks, tables

RNA, PROTEIN, TIMES = [f"G{i}" for i in range(4)], [f"P{i}" for i in range(3)], [0.0, 1.0, 2.0, 4.0, 8.0]


def synthetic(seed=0, units=20):
    rng = np.random.default_rng(seed)
    sheet, rna, protein = [], [], []
    for u in range(units):
        state = rng.normal(size=4)
        for t in TIMES:
            obs = f"S{u:02d}_t{t:g}"
            level = np.exp(3 + 0.3 * state + 0.05 * t)
            for modality, names, store, values in (("rna", RNA, rna, np.round(level * 10)), ("protein", PROTEIN, protein, level[:3] * (1 + 0.1 * rng.random(3)))):
                sheet.append((f"{obs}_{modality}", obs, f"S{u:02d}", f"S{u:02d}", obs, t, "hour", f"c{u % 2}", f"b{u % 2}", modality, "f", "biological"))
                row = {"sample_id": f"{obs}_{modality}", **dict(zip(names, map(float, values)))}
                if rng.random() < 0.2:
                    row[names[0]] = None
                store.append(row)
            state = 0.8 * state + 0.3 * rng.normal(size=4)
    return pd.DataFrame(sheet, columns=tables_columns()), pd.DataFrame(rna), pd.DataFrame(protein)


def tables_columns():
    from cohortflow.operators.validate import REQUIRED_COLUMNS

    return REQUIRED_COLUMNS


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    sheet, rna, protein = synthetic()
    sheet.to_csv(root / "samples.tsv", sep="\t", index=False)
    rna.to_csv(root / "rna.tsv", sep="\t", index=False)
    protein.to_csv(root / "protein.csv", index=False)
    cells = tables.read_matrices(spark, [{"path": f"{root}/rna.tsv", "role": "matrix", "modality": "rna"}, {"path": f"{root}/protein.csv", "role": "matrix", "modality": "protein"}])
    return tables.read_sheet(spark, f"{root}/samples.tsv"), cells


TYPES = {"rna": "raw_counts", "protein": "intensity"}


@pytest.fixture(scope="module")
def data(inputs):
    return runs.Forecast(runs.preprocess(*inputs, TYPES, "longitudinal", seed=4))


def test_study_is_split_and_scaled(data):
    study = data.study
    assert study.observations.count() == 100
    train = study.cells.where("split = 'train'").groupBy("modality", "feature").agg(F.avg("scaled").alias("m"), F.stddev_pop("scaled").alias("s")).toPandas()
    assert len(train) == 7 and np.allclose(train.m, 0, atol=1e-9) and np.allclose(train.s, 1)
    prov = study.provenance()
    assert prov.where("learns_statistics AND fit_split = 'train'").count() == 2


def test_benchmark_report(data, tmp_path):
    out = runs.benchmark(data, {"last_value": {}, "ridge": {"alpha": 1.0}, "time_spline": {"spline_df": 3}}, replicates=5, seed=1)
    scalars = {r.model: r for r in out["scalars"].collect()}
    assert set(scalars) == {"last_value", "ridge", "time_spline"} and all(r.split == "val" for r in scalars.values())
    assert scalars["ridge"].mse < scalars["last_value"].mse
    assert out["bootstrap"].count() == 15 and out["per_feature"].count() == 9
    coverage = {r.model: r for r in out["coverage"].collect()}
    assert set(coverage) == {"last_value", "ridge", "time_spline"} and all(r.split == "val" and r.n_instances == 16 and r.coverage > 0.7 for r in coverage.values())
    sinks.write_report(out, str(tmp_path / "report"))
    sinks.write_split(data.study.observations, str(tmp_path / "split"))
    spark = data.study.cells.sparkSession
    assert spark.read.parquet(str(tmp_path / "report/scalars")).count() == 3
    assert spark.read.parquet(str(tmp_path / "split")).count() == 100


def test_tune_freeze_and_final_test(data):
    trials, best = runs.tune(data, "ridge", 5, seed=2)
    assert trials.count() == 5 and best["alpha"] == trials.orderBy("mse", "trial").first().alpha
    frozen = runs.freeze(data, "ridge", best, seed=4)
    out = runs.final_test(data, frozen, "ridge", best, seed=4, replicates=3)
    assert [r.split for r in out["scalars"].collect()] == ["test"]
    with pytest.raises(runs.CheckFailed, match="changed"):
        runs.final_test(data, frozen, "ridge", {"alpha": 9.0}, seed=4)
    tampered = runs.Forecast(runs.Study(data.study.observations, data.study.cells.withColumn("raw", F.col("raw") + 1), data.study.scaler, data.study.configs))
    with pytest.raises(runs.CheckFailed, match="data_hash"):
        runs.final_test(tampered, frozen, "ridge", best, seed=4)


def closed_form_arms(data, prior, seeds, alpha=1.0, weight=0.1):
    """Validation error of every arm and seed by dense algebra in numpy."""
    design, n_base, n_path = runs.arm_rows(data, prior)
    frame, n_targets = design.toPandas(), data.target_names.n
    x, y = np.stack(frame.x), np.full((len(frame), n_targets), np.nan)
    for i, (t, v) in enumerate(zip(frame.t, frame.y)):
        y[i, list(t)] = v
    names = {r.name: r["at"] for r in data.names.table.collect()}
    train, val = (frame.split == s for s in ("train", "val"))

    def laplacian(edges):
        out = np.zeros((x.shape[1],) * 2)
        for e in edges.collect():
            ends = [f"{e.source_modality}:{e.source_id}", f"{e.target_modality}:{e.target_id}"]
            if ends[0] == ends[1]:
                continue
            i, j = (names.get(n) for n in ends)
            for a, b in ((i, j), (j, i)):
                if a is not None:
                    out[a, a] += e.score
                    if b is not None:
                        out[a, b] -= e.score
        return weight * out

    found = {}
    for arm in map(arms.Arm, arms.ARMS):
        for seed in seeds:
            keep = np.r_[0:n_base, n_base : n_base + n_path * arm.pathway, n_base + n_path : n_base + n_path + prior.dim * arm.embedding]
            edges = graph.rewire(prior.edges, seed + 17) if arm.randomized else prior.edges
            pen = laplacian(edges)[np.ix_(keep, keep)] if arm.graph else 0
            a, b = x[train][:, keep], np.where(np.isnan(y[train]), np.nanmean(y[train], axis=0), y[train])
            xc, yc = a - a.mean(0), b - b.mean(0)
            coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(keep)) + pen, xc.T @ yc)
            gap = y[val] - (x[val][:, keep] - a.mean(0)) @ coef - b.mean(0)
            found[arm.name, seed] = np.nanmean(gap**2)
    return found


def test_prior_arms_and_candidates(spark, data):
    edge = "source_modality string, source_id string, target_modality string, target_id string, edge_type string, directed boolean, score double"
    edges = spark.createDataFrame([("rna", f"G{i}", "protein", f"P{i}", "gene_regulation", True, 0.9) for i in range(3)] + [("rna", "G0", "rna", "G1", "physical_ppi", False, 0.5), ("rna", "G2", "rna", "G3", "physical_ppi", False, 0.4)], edge)
    paths = spark.createDataFrame([("W", "rna", g) for g in RNA[:2]], "pathway_id string, modality string, feature string")
    vectors = spark.createDataFrame([("rna", g, [float(i), 1.0]) for i, g in enumerate(RNA)], "modality string, feature string, embedding array<double>")
    prior = runs.Prior(edges, paths, vectors, 2)
    table = runs.prior_arms(data, prior, [1, 2]).toPandas()
    assert len(table) == 10 and set(table.arm) == set(arms.ARMS)
    plain = table[table.arm == "no_prior"]
    assert plain.mse.nunique() == 1
    ridge = runs.Ridge(data, 1.0)
    val = ridge.predict("val").select(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)).first()[0]
    assert plain.mse.iloc[0] == pytest.approx(val)
    closed = closed_form_arms(data, prior, [1, 2])
    for row in table.itertuples():
        assert row.mse == pytest.approx(closed[row.arm, row.seed]), row.arm
    n = dict(zip(table.arm, table.n_parameters))
    assert n["combined"] - n["embedding_only"] == len(PROTEIN) and n["graph_only"] == n["no_prior"]
    candidates = runs.Explained(ridge, seed=3).candidates(prior)
    assert candidates.count() == 7 * 3
    assert candidates.where("source = 'rna:G0' AND target = 'protein:P0'").first().prior_edge_used
    assert graph.mapping_counts(edges, data.study.cells.select("modality", "feature").distinct()).first().n_unmapped == 0


def test_group_forecast_never_reads_another_unit(inputs):
    sheet, cells = inputs
    # Every unit keeps the time point its number names, which makes a cross-section.
    number = F.substring("experimental_unit_id", 2, 2).cast("int")
    once = sheet.where(F.element_at(F.array(*[F.lit(t) for t in TIMES]), number % 5 + 1) == F.col("time"))
    data = runs.Forecast(
        runs.preprocess(once, cells, TYPES, "repeated_cross_sectional", seed=1, block_batch=False),
        runs.Task(kind="group_time_forecast", target_time_min=1.0),
    )
    scored = runs.LastValue(data).predict()
    assert scored.count() > 0 and data.instances.where("history_observation IS NOT NULL").count() == 0
    assert runs.Ridge(data).predict("val").count() == scored.where("split = 'val'").count()


def test_written_study_id_map_and_guards(spark, inputs, data, tmp_path):
    kinds = "modality string, source_id string, target_id string, target_id_type string"
    good = [("rna", g, f"E{g}", "ensembl") for g in RNA]
    study = runs.preprocess(*inputs, TYPES, "longitudinal", seed=4, id_table=spark.createDataFrame(good, kinds))
    runs.write_study(study, str(tmp_path / "study"))
    ids = [r.observation_id for r in spark.read.parquet(str(tmp_path / "study/observations")).collect()]
    assert sorted(ids) == sorted(set(ids)) and len(ids) == 100
    assert spark.read.parquet(str(tmp_path / "study/cells")).count() == study.cells.count()
    assert {r.modality: r.n_mapped for r in spark.read.parquet(str(tmp_path / "study/feature_map_summary")).collect()} == {"rna": 4, "protein": 3}
    with pytest.raises(runs.CheckFailed, match="one_to_many_ids"):
        runs.preprocess(*inputs, TYPES, "longitudinal", seed=4, id_table=spark.createDataFrame([*good, ("rna", "G0", "other", "ensembl")], kinds))
    review = "status string, n_unresolved int, taxon_id int, sampling_design string, pairing_level string, longitudinal boolean, unit_of_independence string, paired_modalities boolean"
    with pytest.raises(runs.CheckFailed, match="manifest_review"):
        runs.preprocess(*inputs, TYPES, "longitudinal", seed=4, manifest=spark.createDataFrame([("required", 2, 9606, "longitudinal", "specimen", True, "donor", True)], review))
    with pytest.raises(runs.CheckFailed, match="unknown_modality"):
        runs.Forecast(data.study, runs.Task(target_modality="lipid"))
    late = runs.TimeSpline(data, 3)
    late.knots = (0.0, late.knots[1], 1.0)
    with pytest.raises(runs.CheckFailed, match="outside_time_range"):
        late.predict("val")


def test_bad_sheets_are_refused(inputs):
    sheet, cells = inputs
    with pytest.raises(ValueError, match="lacks"):
        runs.preprocess(sheet.drop("batch"), cells, TYPES, "longitudinal", 1)
    with pytest.raises(runs.CheckFailed, match="sample_id_unique"):
        runs.preprocess(sheet.union(sheet.limit(1)), cells, TYPES, "longitudinal", 1)
    with pytest.raises(runs.CheckFailed, match="one_time_one_subject"):
        runs.preprocess(sheet, cells, TYPES, "repeated_cross_sectional", 1)
    with pytest.raises(runs.CheckFailed, match="modality_declared"):
        runs.preprocess(sheet, cells, {"rna": "raw_counts"}, "longitudinal", 1)
    with pytest.raises(runs.CheckFailed, match="split_leakage"):
        shared = sheet.withColumn("biospecimen_id", F.lit("shared"))
        runs.preprocess(shared, cells, TYPES, "longitudinal", 1, also_block=("biospecimen_id",))
