from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import normalize, qc, validate

SPLIT = ["train"] * 4 + ["val", "test"]
RNA = [[90, 10, 0], [30, 10, 10], [20, 20, 10], [50, 25, 25], [40, 40, 20], [10, 60, 30]]
PROTEIN = [[0, 4], [2, None], [8, 16], [4, 8], [16, 2], [32, 64]]


@pytest.fixture(scope="module")
def layers(spark):
    cells, obs = [], []
    for i in range(6):
        obs.append((f"O{i}", f"U{i}", float(i % 3), SPLIT[i]))
        cells += [(f"O{i}", "rna", f"G{j}", float(v), SPLIT[i]) for j, v in enumerate(RNA[i])]
        cells += [(f"O{i}", "protein", f"P{j}", None if v is None else float(v), SPLIT[i]) for j, v in enumerate(PROTEIN[i])]
    obs = spark.createDataFrame(obs, "observation_id string, experimental_unit_id string, time double, split string")
    cells = spark.createDataFrame(cells, "observation_id string, modality string, feature string, raw double, split string")
    configs = normalize.assay_configs({"rna": "raw_counts", "protein": "intensity"})
    normalized = normalize.normalize_cells(cells, configs)
    scaler = normalize.scaler_fit(normalized)
    return obs, normalize.scale_cells(normalized, scaler, configs), scaler, configs


def row(df, obs, modality, column):
    pdf = df.where((F.col("observation_id") == obs) & (F.col("modality") == modality)).orderBy("feature").toPandas()
    return pdf[column].to_numpy(dtype=float)


def test_normalized_and_scaled(layers):
    _, cells, scaler, _ = layers
    assert np.allclose(row(cells, "O0", "rna", "normalized"), [13.710151, 11.512935, 0.0], atol=1e-6)
    assert np.allclose(row(cells, "O4", "rna", "scaled"), [-1.210192, 1.275840, 0.563280], atol=1e-6)
    assert np.allclose(row(cells, "O5", "rna", "scaled"), [-5.871899, 2.087483, 0.639518], atol=1e-6)
    assert np.allclose(row(cells, "O0", "protein", "normalized"), [np.nan, 2], equal_nan=True)
    assert np.allclose(row(cells, "O1", "protein", "scaled"), [-1.224745, np.nan], equal_nan=True, atol=1e-6)
    assert np.allclose(row(cells, "O5", "protein", "scaled"), [3.674235, 3.674235], atol=1e-6)
    stats = scaler.where("modality = 'rna'").orderBy("feature").toPandas()
    assert np.allclose(stats["mean"], [13.259106, 12.261864, 9.210344], atol=1e-6)
    assert np.allclose(stats["scale"], [0.297378, 0.499560, 5.318375], atol=1e-6)


def test_qc_counts_a_zero_intensity_as_missing(layers):
    obs, cells, _, _ = layers
    samples = qc.per_sample_qc(obs, cells)
    hit = samples.where("observation_id = 'O0' AND modality = 'protein'").first()
    assert (hit.n_observed, hit.pct_missing, hit.total_signal, hit.median_signal) == (1, 0.5, 4.0, 4.0)
    features = qc.per_feature_qc(obs, cells)
    assert features.where("feature = 'P0'").first().n_observed == 5


def test_records(layers):
    obs, cells, scaler, configs = layers
    record = {r.modality: r for r in normalize.normalization_record(obs, cells, configs).collect()}
    assert record["protein"].n_zeros_as_missing == 1 and record["rna"].n_zero_library_samples == 0
    fitted = normalize.scaler_record(scaler, obs).collect()
    assert {(r.n_fit_samples, r.fit_split) for r in fitted} == {(4, "train")}


def test_zero_library_is_missing(spark):
    cells = spark.createDataFrame([("a", "rna", "x", 0.0), ("a", "rna", "y", 0.0), ("b", "rna", "x", 5.0), ("b", "rna", "y", 5.0)], "observation_id string, modality string, feature string, raw double")
    obs = spark.createDataFrame([("a",), ("b",), ("c",)], "observation_id string")
    configs = normalize.assay_configs({"rna": "raw_counts"})
    out = normalize.normalize_cells(cells, configs)
    assert out.where("observation_id = 'a' AND normalized IS NOT NULL").count() == 0
    assert normalize.normalization_record(obs, cells, configs).first().n_zero_library_samples == 2  # a is empty, c has no cell


def test_value_rules(spark):
    cells = spark.createDataFrame(
        [("n", "rna", -1.0), ("i", "log", float("inf")), ("z", "protein", 0.0), ("ok", "rna", 2.0)], "id string, modality string, raw double"
    )
    bad = validate.assay_value_violations(cells, ["rna"], ["protein"], ["log"], zeros_are_missing=False).toPandas()
    assert dict(zip(bad.id, bad.reason)) == {"n": "negative", "i": "infinite", "z": "zero_before_log2"}
    assert validate.assay_value_violations(cells, ["rna"], ["protein"], ["log"]).count() == 2


def test_undeclared_value_type():
    with pytest.raises(ValueError, match="declare"):
        normalize.assay_configs({"rna": "undeclared"})


def test_flat_feature_keeps_unit_scale(spark):
    cells = spark.createDataFrame([(f"o{i}", "p", "f", 3.0, "train") for i in range(3)], "observation_id string, modality string, feature string, normalized double, split string")
    hit = normalize.scaler_fit(cells).first()
    assert hit.scale == 1.0 and hit.zero_variance


def test_unfillable(spark):
    cells = spark.createDataFrame([("p", "f", 1.0, "val"), ("p", "g", 1.0, "train")], "modality string, feature string, scaled double, split string")
    assert [r.feature for r in validate.unfillable_features(cells).collect()] == ["f"]


def test_fitted_off_train(spark):
    rows = spark.createDataFrame([("a", True, "train"), ("b", True, "val"), ("c", False, None)], "name string, learns_statistics boolean, fit_split string")
    assert [r.name for r in validate.fitted_off_train(rows).collect()] == ["b"]


def test_sheet_rules(spark):
    pdf = pd.DataFrame({"sample_id": ["s1", "s1", "s3"], "batch": ["b", " NA ", "b"], "modality": ["rna", "rna", "lipid"]})
    sheet = spark.createDataFrame(pdf)
    assert [r.value for r in validate.na_tokens(sheet, "sample_id", ["batch"]).collect()] == [" NA "]
    assert validate.duplicate_keys(sheet, ["sample_id"]).count() == 1
    assert validate.missing_columns(sheet)[0] == "observation_id"
