"""Whole runs over a user's tables: build a study, forecast, benchmark, tune, test, compare, explain.

A run is a chain of the table operators; nothing here touches row values itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.operators import align, arms, attribution, evaluate, forecast, graph, idmap, linear, normalize, qc, resample, split, validate
from cohortflow.operators.fingerprint import config_hash, fingerprint, fingerprint_diff, run_hashes
from cohortflow.session import dealt, stage
from cohortflow.sources import sinks


class CheckFailed(ValueError):
    """A check found violations; ``violations`` holds them."""

    def __init__(self, name: str, violations: DataFrame):
        self.violations = violations
        sample = [r.asDict() for r in split.sample_offenders(violations, violations.columns, 8).collect()]
        super().__init__(f"{name}: {sample}")


def require_empty(name: str, violations: DataFrame) -> None:
    if not violations.isEmpty():
        raise CheckFailed(name, violations)


def sheet_checks(sheet: DataFrame, modalities: list[str], design: str) -> dict[str, DataFrame]:
    """Every sample-sheet check with its violations."""
    declared = sheet.sparkSession.createDataFrame([(m,) for m in modalities], "modality string")
    checks = {
        "na_tokens": validate.na_tokens(sheet, "sample_id", validate.IDENTITY_FIELDS[1:]),
        "sample_id_unique": validate.duplicate_keys(sheet, ["sample_id"]),
        "identity_unique": validate.duplicate_keys(sheet, ["subject_id", "biospecimen_id", "time", "modality"]),
        "modality_declared": validate.undeclared(sheet, "modality", declared),
        "observation_consistent": validate.observation_conflicts(sheet, flagged=()),
    }
    if design == "longitudinal":
        checks["two_times"] = validate.longitudinal_violations(sheet)
    elif design == "repeated_cross_sectional":
        checks["one_time_one_subject"] = validate.cross_section_violations(sheet)
    return checks


@dataclass
class Study:
    """Labelled observations, layered cells and the fitted scaler; the design and the feature id map, where known."""

    observations: DataFrame
    cells: DataFrame
    scaler: DataFrame
    configs: dict[str, normalize.AssayConfig]
    design: str | None = None
    pairing_level: str | None = None
    feature_map: DataFrame | None = None

    def target(self, modality: str = "protein") -> DataFrame:
        return self.cells.where(F.col("modality") == modality)

    def provenance(self) -> DataFrame:
        """Stateless and fitted transform records side by side."""
        stateless = normalize.normalization_record(self.observations, self.cells, self.configs).select(
            "modality", F.col("strategy").alias("transformer_name"), "learns_statistics", F.lit(None).cast("string").alias("fit_split")
        )
        fitted = normalize.scaler_record(self.scaler, self.observations).select("modality", "transformer_name", F.lit(True).alias("learns_statistics"), "fit_split")
        return stateless.unionByName(fitted)


def layer_study(raw: DataFrame, obs: DataFrame, units: DataFrame, columns: list[str], configs: dict[str, normalize.AssayConfig], label: str = "study") -> Study:
    """Attach the split to cells and observations, normalise, fit on train, scale.

    The normalised cells are written once; each file holds one normalisation branch, so row-group
    statistics prune by modality without a sort. The scaler is a small table of features.
    """
    units = stage(units, f"{label}-units")
    cells = raw.join(units.select(*columns, "split"), columns, "left")
    normalized = stage(normalize.normalize_cells(cells, configs), f"{label}-normalized")
    scaler = stage(normalize.scaler_fit(normalized), f"{label}-scaler")
    return Study(split.label_observations(obs, units, columns), normalize.scale_cells(normalized, scaler, configs), scaler, configs)


def preprocess(
    sheet: DataFrame,
    cells: DataFrame,
    value_types: dict[str, str],
    design: str,
    seed: int,
    group_by: tuple[str, ...] = ("experimental_unit_id",),
    fractions: tuple[float, float] = (0.6, 0.2),
    assignment: DataFrame | None = None,
    block_batch: bool | None = None,
    also_block: tuple[str, ...] = (),
    overrides: dict[str, normalize.AssayConfig] | None = None,
    id_table: DataFrame | None = None,
    manifest: DataFrame | None = None,
    pairing_level: str | None = None,
    matrix_files: DataFrame | None = None,
) -> Study:
    """Check the sheet, align, split by independent group, guard, normalise and scale.

    ``cells``: ``sample_id, modality, feature, value``. With an ``id_table`` (see ``idmap.map_features``)
    every feature is mapped, and a feature with several targets blocks the run. With a ``manifest``
    its review state and design have to be in order; with the files' table ``matrix_files`` (``modality, role``) every
    declared assay has to have a matrix and every matrix a declared assay. Raises ``CheckFailed`` on any violation.
    """
    if matrix_files is not None:
        study = F.lit("study").alias("dataset_id")
        declared = sheet.sparkSession.createDataFrame([(m,) for m in value_types], "modality string").select(study, "modality")
        require_empty("manifest_modalities", validate.manifest_modality_gaps(declared, matrix_files.select(study, "modality", "role")))
    if manifest is not None:
        require_empty("manifest_review", validate.review_violations(manifest))
        require_empty("manifest_design", validate.design_violations(manifest))
    feature_map = None
    if id_table is not None:
        feature_map = stage(idmap.map_features(cells.select("modality", F.col("feature").alias("source_id")).distinct(), id_table), "feature-map")
        require_empty("one_to_many_ids", idmap.blocking_sources(feature_map))
    missing = validate.missing_columns(sheet)
    if missing:
        raise ValueError(f"The sample sheet lacks {missing}.")
    configs = normalize.assay_configs(value_types, overrides)
    for name, violations in sheet_checks(sheet, list(value_types), design).items():
        require_empty(name, violations)
    obs = stage(align.observations(sheet, sorted(value_types)), "observations")
    require_empty("time_batch_confound", split.time_batch_confound(obs).where("confounded"))
    columns = split.group_columns(list(group_by), design == "repeated_cross_sectional", block_batch)
    if assignment is None:
        units = split.assign_random(obs, columns, seed, *fractions)
    else:
        units = split.assign_explicit(obs, columns, assignment)
        require_empty("split_assignment", split.unassigned_keys(units, columns[0]))
    labelled = split.label_observations(obs, units, columns)
    require_empty("split_labels", split.label_problems(labelled))
    require_empty("split_problems", align.split_problems(obs, labelled.select("experimental_unit_id", "split").distinct()))
    require_empty("split_leakage", split.leakage(labelled, list(dict.fromkeys([*columns, *also_block]))))
    keys = obs.select("observation_id", "experimental_unit_id", "time", "condition", "batch", *[c for c in columns if c not in ("experimental_unit_id", "time", "condition", "batch")])
    raw = align.aligned_cells(sheet, cells).where("feature IS NOT NULL").join(keys, "observation_id")
    raw = stage(raw, "aligned-cells")
    of_kind = {k: [m for m, c in configs.items() if c.strategy == k] for k in (normalize.COUNTS, normalize.INTENSITY, normalize.LOG_LIKE)}
    require_empty("assay_values", validate.assay_value_violations(raw, of_kind[normalize.COUNTS], of_kind[normalize.INTENSITY], of_kind[normalize.LOG_LIKE]))
    study = layer_study(raw, obs, units, columns, configs)
    study.design, study.pairing_level, study.feature_map = design, pairing_level, feature_map
    return study


def write_study(study: Study, path: str) -> None:
    """The layered cells, QC, provenance, feature map and locked split, and the observations in order of their id, all in one step."""
    samples, features = qc.per_sample_qc(study.observations, study.cells), qc.per_feature_qc(study.observations, study.cells)
    found = sinks.layered(study.cells, samples, features, study.provenance())
    found |= {"observations": sinks.ordered_observations(study.observations), "split": sinks.locked_table(study.observations)}
    if study.feature_map is not None:
        found |= {"feature_map": (study.feature_map, []), "feature_map_summary": (idmap.map_summary(study.feature_map), [])}
    sinks.publish(found, path)


@dataclass(frozen=True)
class Task:
    kind: str = "subject_forecast"
    target_modality: str = "protein"
    input_modalities: tuple[str, ...] = ("protein", "rna")
    horizon: int = 1
    target_time_min: float | None = None
    primary_metric: str = "pcc_macro"


@dataclass
class Forecast:
    """Instances, targets and design rows of a study under a task, each built at most once."""

    study: Study
    task: Task = field(default_factory=Task)

    def __post_init__(self) -> None:
        """Refuse a task that the study's design, where it is known, cannot support."""
        if self.study.design is None:
            return
        row = (
            self.task.kind, self.task.target_modality, list(self.task.input_modalities), sorted(self.study.configs), self.study.design,
            self.study.pairing_level or "specimen", self.task.target_time_min,
        )
        schema = "kind string, target_modality string, input_modalities array<string>, modalities array<string>, sampling_design string, pairing_level string, target_time_min double"
        require_empty("task", validate.task_violations(self.study.cells.sparkSession.createDataFrame([row], schema)))

    @cached_property
    def observations(self) -> DataFrame:
        return stage(self.study.observations, "observations", ["split"])

    @cached_property
    def target_cells(self) -> DataFrame:
        return self.study.target(self.task.target_modality)

    @property
    def by_group(self) -> bool:
        return self.task.kind == "group_time_forecast"

    @cached_property
    def steps(self) -> DataFrame:
        return forecast.unit_steps(self.observations, self.target_cells)

    @cached_property
    def instances(self) -> DataFrame:
        if self.by_group:
            if self.task.target_time_min is None:
                raise ValueError("group_time_forecast needs target_time_min")
            return forecast.group_instances(self.observations, self.task.target_time_min)
        return stage(forecast.subject_instances(self.steps, self.task.horizon), "instances")

    @cached_property
    def keys(self) -> DataFrame:
        return stage(forecast.asof_keys(normalize.subset(self.observations, "train"), self.instances), "asof-keys")

    @cached_property
    def means(self) -> DataFrame:
        return stage(forecast.condition_time_means(normalize.subset(self.study.cells, "train")), "condition-time-means")

    @cached_property
    def targets(self) -> DataFrame:
        return forecast.instance_targets(self.instances, self.target_cells)

    @cached_property
    def names(self) -> linear.Header:
        return linear.feature_header(self.study.cells, list(self.task.input_modalities))

    @cached_property
    def conditions(self) -> linear.Header:
        return linear.condition_header(normalize.subset(self.observations, "train"))

    @cached_property
    def target_names(self) -> linear.Header:
        return linear.target_header(self.target_cells)

    @cached_property
    def columns(self) -> linear.Header:
        return linear.design_header(self.names, self.conditions)

    @cached_property
    def observed(self) -> DataFrame:
        """Instances with at least one observed target, and their targets as parallel arrays ``t, y``, written once."""
        packed = linear.targets_per_row(self.targets, "instance_id", self.target_names)
        return stage(self.instances.join(packed, "instance_id"), "observed")

    def design(self) -> DataFrame:
        """The instances ``observed`` with their design vector ``x``; one without an observed target would neither be fitted nor scored."""
        unknown = forecast.unseen_conditions(self.instances, normalize.subset(self.observations, "train"))
        require_empty("unseen_condition", unknown)
        if self.by_group:
            return linear.group_design(dealt(self.observed, self.observed.count(), "instance_id"), self.keys, self.means, self.names, self.conditions)
        inputs = self.study.cells.where(F.col("modality").isin(list(self.task.input_modalities)))
        fill = normalize.imputer_fit(inputs).where("fill IS NOT NULL").select(F.concat_ws(":", "modality", "feature").alias("name"), "fill")
        return linear.subject_design(self.observed, self.study.cells, self.names, self.conditions, fill)

    @cached_property
    def rows(self) -> DataFrame:
        """Design rows with at least one observed target, written once by split."""
        return stage(self.design(), "design", ["split"])

    def moments(self, rows: DataFrame | None = None, width: int | None = None) -> linear.Moments | linear.WideRows:
        return linear.moments(normalize.subset(self.rows if rows is None else rows, "train"), width or self.columns.n)

    def predicted(self, rows: DataFrame, coefs: DataFrame, width: int | None = None) -> DataFrame:
        """Observed target cells of design rows with their predictions (and ``model``, if the coefficients have it)."""
        out = linear.predict(rows, coefs, width or self.columns.n, ["split", "instance_id", "group_id", "condition"])
        return linear.named_targets(out, self.target_names)


SCORED = ["split", "instance_id", "group_id", "feature", "y_true", "y_pred"]


class LastValue:
    """Own last value, or the as-of train condition x time mean. Nothing to fit."""

    def __init__(self, data: Forecast):
        self.data = data

    def predict(self, split_name: str | None = None) -> DataFrame:
        data = self.data
        targets = normalize.subset(data.targets, split_name) if split_name else data.targets
        if data.by_group:
            means = data.means.where(F.col("modality") == data.task.target_modality)
            return forecast.group_last_value(targets, data.keys, means).select(*SCORED)
        return forecast.own_last_value(targets, data.target_cells).select(*SCORED)

    def explain(self) -> DataFrame:
        return self.data.study.cells.sparkSession.createDataFrame([], "target string, feature string, coefficient double")


class Ridge:
    def __init__(self, data: Forecast, alpha: float = 1.0):
        self.data, self.alpha = data, alpha
        self.coefs = stage(linear.ridge_fit(data.moments(), alpha), "coefficients")

    def predict(self, split_name: str | None = None) -> DataFrame:
        rows = normalize.subset(self.data.rows, split_name) if split_name else self.data.rows
        return self.data.predicted(rows, self.coefs).select(*SCORED)

    def explain(self) -> DataFrame:
        return linear.coefficient_table(self.coefs, self.data.target_names, self.data.columns)


class TimeSpline:
    """Spline of time by condition, fitted on every train observation with an observed target."""

    def __init__(self, data: Forecast, spline_df: int = 4, alpha: float = 1.0):
        self.data = data
        train = normalize.subset(data.target_cells, "train")
        packed = linear.targets_per_row(train, "observation_id", data.target_names, "scaled")
        obs = normalize.subset(data.observations, "train")
        rows = self.train = stage(obs.join(packed, "observation_id").select("observation_id", "split", "condition", "time", "t", "y"), "spline-rows")
        require_empty("spline_size", validate.spline_violations(rows, spline_df))
        self.knots = linear.spline_knots(rows, spline_df)
        self.conditions = linear.condition_header(rows)
        self.columns = linear.spline_header(self.conditions, spline_df)
        self.mom = linear.moments(linear.spline_design(rows, "time", self.conditions, self.knots), self.columns.n)
        self.coefs = stage(linear.ridge_fit(self.mom, alpha, intercept=False), "coefficients")

    def rows(self, split_name: str | None = None) -> DataFrame:
        """Instances with their design row and observed targets. A target time outside the train range, or a condition not in train, is refused."""
        data = self.data
        rows = normalize.subset(data.observed, split_name) if split_name else data.observed
        require_empty("outside_time_range", linear.outside_range(rows, "target_time", self.knots))
        require_empty("unseen_condition", rows.join(self.conditions.table.select(F.col("name").alias("condition")), "condition", "left_anti"))
        return linear.spline_design(rows, "target_time", self.conditions, self.knots)

    def predict(self, split_name: str | None = None) -> DataFrame:
        return self.data.predicted(self.rows(split_name), self.coefs, self.columns.n).select(*SCORED)

    def explain(self) -> DataFrame:
        return linear.coefficient_table(self.coefs, self.data.target_names, self.columns, with_intercept=False)


MODELS: dict[str, Any] = {"last_value": LastValue, "ridge": Ridge, "time_spline": TimeSpline}


def benchmark_predictions(data: Forecast, models: dict[str, dict], unlock_test: bool = False) -> DataFrame:
    """Scored validation cells (and test cells only when unlocked) of every model, stacked."""
    splits = ["val", "test"] if unlock_test else ["val"]
    fitted = {name: MODELS[name](data, **params) for name, params in models.items()}
    parts = [m.predict(s).withColumn("model", F.lit(n)) for n, m in fitted.items() for s in splits]
    return reduce(lambda a, b: a.unionByName(b), parts)


def report(cells: DataFrame, data: Forecast, keys: list[str], replicates: int, seed: int) -> dict[str, DataFrame]:
    """Scalars, per-feature, per-sample, interval and coverage tables of scored cells."""
    cells = stage(cells, "scored")
    features = data.target_cells.select("feature").distinct()
    return {
        "scalars": evaluate.primary_value(evaluate.scalars(cells, keys), data.task.primary_metric),
        "per_feature": evaluate.per_feature(cells, keys),
        "per_sample": evaluate.per_sample(cells, keys),
        "bootstrap": resample.bootstrap_ci(cells, keys, "group_id", replicates, seed),
        "coverage": evaluate.coverage(cells, data.instances.join(cells.select(*keys).distinct(), "split"), features, keys),
    }


def benchmark(data: Forecast, models: dict[str, dict], replicates: int = 200, seed: int = 0, unlock_test: bool = False) -> dict[str, DataFrame]:
    """Fit on train, predict validation, score every model in one grouped pass."""
    require_empty("fitted_off_train", validate.fitted_off_train(data.study.provenance()))
    cells = stage(benchmark_predictions(data, models, unlock_test), "predictions")
    expected = data.targets.where(F.col("y_true").isNotNull()).join(cells.select("split").distinct(), "split")
    for name in models:
        require_empty("prediction_keys", evaluate.prediction_mismatch(cells.where((F.col("model") == name) & F.col("y_true").isNotNull()), expected))
    return report(cells, data, ["model", "split"], replicates, seed)


# Search space of each tunable model.
RIDGE_ALPHA = (1e-3, 1e3)
SPLINE_ALPHA = (1e-3, 1e2)
SPLINE_WIDTHS = (3, 4)


def tune(data: Forecast, model: str, trials: int, seed: int, metric: str = "mse") -> tuple[DataFrame, dict]:
    """Score a seeded candidate table on validation from shared Gram matrices; test rows are never
    read. Returns every trial and the parameters of the best one."""
    if model == "ridge":
        alphas = linear.log_uniform(*RIDGE_ALPHA, trials, seed)
        rows = normalize.subset(data.rows, "val")
        require_empty("objective_leaks", validate.objective_leaks(normalize.subset(data.rows, "train").select("split").union(rows.select("split"))))
        paths = stage(linear.ridge_path(data.moments(), alphas), "paths")
        table = stage(linear.sweep_scores(rows, paths, data.columns.n, alphas), "trials")
        best = linear.best_trial(table, metric).first()
        return table, {"alpha": best["alpha"]}
    if model == "time_spline":
        alphas = linear.log_uniform(*SPLINE_ALPHA, trials, seed)
        parts = []
        for df in SPLINE_WIDTHS:
            fitted = TimeSpline(data, df)
            rows = stage(fitted.rows("val"), "spline-val")
            require_empty("objective_leaks", validate.objective_leaks(fitted.train.select("split").union(rows.select("split"))))
            paths = stage(linear.ridge_path(fitted.mom, alphas, intercept=False), "paths")
            parts.append(linear.sweep_scores(rows, paths, fitted.columns.n, alphas).withColumn("spline_df", F.lit(df).cast("bigint")))
        table = stage(reduce(lambda a, b: a.unionByName(b), parts), "trials")
        best = table.agg(F.min_by(F.struct("alpha", "spline_df"), F.struct(metric, "spline_df", "trial")).alias("b")).first()["b"]
        return table, {"alpha": best["alpha"], "spline_df": best["spline_df"]}
    raise ValueError(f"{model!r} has no search space")


def freeze(data: Forecast, model: str, params: dict, seed: int) -> DataFrame:
    """Fingerprints of everything a later test run must find unchanged."""
    cells = data.study.cells.select("observation_id", "modality", "feature", "split", "raw", "normalized", "scaled")
    units = data.study.observations.select("observation_id", "split")
    tables = fingerprint(cells, "cells").unionByName(fingerprint(data.study.scaler, "scaler"))
    config = {"model": model, "params": params, "task": vars(data.task) | {"input_modalities": list(data.task.input_modalities)}}
    return stage(run_hashes(tables, fingerprint(units, "split"), config, seed), "frozen")


def final_test(data: Forecast, frozen: DataFrame, model: str, params: dict, seed: int, replicates: int = 200) -> dict[str, DataFrame]:
    """Refuse unless the current fingerprints equal the frozen ones, then score test."""
    require_empty("frozen_fingerprints", fingerprint_diff(frozen, freeze(data, model, params, seed)))
    require_empty("split_leakage", split.leakage(data.study.observations, ["experimental_unit_id", "subject_id", "biospecimen_id"]))
    fitted = MODELS[model](data, **params)
    return report(fitted.predict("test").withColumn("model", F.lit(model)), data, ["model", "split"], replicates, seed)


@dataclass
class Prior:
    """Edges, pathway members (``pathway_id, modality, feature``) and vectors per feature."""

    edges: DataFrame
    pathways: DataFrame
    embeddings: DataFrame
    dim: int


def arm_rows(data: Forecast, prior: Prior) -> tuple[DataFrame, int, int]:
    """Design rows with pathway and then embedding columns of the history snapshot after the others; how many come before, and how many pathways."""
    snapshot = ["condition", "time"] if data.by_group else ["observation_id"]
    value = "mean" if data.by_group else "scaled"
    inputs = (data.means if data.by_group else data.study.cells).where(F.col("modality").isin(list(data.task.input_modalities)))
    inputs = inputs.select(*snapshot, "modality", "feature", value)
    vectors = graph.feature_embeddings(inputs.select("modality", "feature").distinct(), prior.embeddings, prior.dim)
    parts = vectors.select("modality", "feature", F.posexplode("embedding").alias("d", "w"))
    projected = inputs.where(F.col(value).isNotNull()).join(parts, ["modality", "feature"]).groupBy(*snapshot, "d").agg(F.sum(F.col(value) * F.col("w")).alias("v"))
    emb = projected.groupBy(*snapshot).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("e")).select(*snapshot, F.col("e.v").alias("emb"))
    pathways = linear.header(prior.pathways, F.col("pathway_id"))
    activity = graph.observed_activity(inputs, prior.pathways, snapshot, value).join(pathways.table.select(F.col("name").alias("pathway_id"), "at"), "pathway_id")
    packed = activity.groupBy(*snapshot).agg(F.collect_list(F.struct("at", F.col("activity").alias("v"))).alias("e")).select(*snapshot, F.col("e.at").alias("at"), F.col("e.v").alias("v"))
    paths = linear.densify(packed, pathways.n, "path", np.zeros(pathways.n))
    extra = emb.join(paths, snapshot, "full")
    if data.by_group:
        extra = extra.withColumnsRenamed({"condition": "key_condition", "time": "key_time"})
        extra, on = stage(extra, "key-extras"), ["key_condition", "key_time"]  # as in ``group_design``
    else:
        extra, on = extra.withColumnRenamed("observation_id", "history_observation"), ["history_observation"]
    n_path = pathways.n
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    wide = data.design().join(extra, on, "left").withColumn("x", F.concat("x", F.coalesce("path", zeros(n_path)), F.coalesce("emb", zeros(prior.dim)))).drop("path", "emb")
    return stage(wide, "design", ["split"]), data.columns.n, n_path


def prior_arms(data: Forecast, prior: Prior, seeds: list[int], alpha: float = 1.0, graph_weight: float = 0.1) -> DataFrame:
    """Runs of the five arms: same split, evaluator and parameters, one pass over the full design.

    Every arm has some of the columns, and an optional sparse graph penalty over the inputs; narrow arms share one
    Gram matrix, and all arms predict in a single pass.
    """
    rows, n_base, n_path = arm_rows(data, prior)
    width = n_base + n_path + prior.dim
    mom = data.moments(rows, width)
    edges = stage(prior.edges, "prior-edges")

    def penalty(of: DataFrame) -> DataFrame:
        return arms.penalty_entries(graph.laplacian(graph.symmetric_weights(of)), data.names, graph_weight)

    # One fit for an arm, or for an arm and a seed where the arm depends on it; (arm, seeds, columns) by model number.
    fits, about = [], []
    for arm in map(arms.Arm, arms.ARMS):
        ranges = [(0, n_base)] + [(n_base, n_base + n_path)] * arm.pathway + [(n_base + n_path, width)] * arm.embedding
        for at in [[s] for s in seeds] if arm.randomized else [seeds]:
            pen = penalty(graph.rewire(edges, at[0] + 17)) if arm.randomized else penalty(edges) if arm.graph else None
            fits.append(arms.arm_coefficients(mom, ranges, width, alpha, pen).withColumn("model", F.lit(len(about))))
            about.append((len(about), arm.name, at, (sum(b - a for a, b in ranges) + 1) * data.target_names.n))
    coefs = stage(reduce(lambda a, b: a.unionByName(b), fits), "arm-coefficients")
    scored = stage(data.predicted(normalize.subset(rows, "val"), coefs, width), "arm-scored")
    pooled = evaluate.grouped_scores(scored, ["model"]).select("model", "mse", "mae")
    macro = evaluate.grouped_scores(scored, ["model", "feature"]).groupBy("model").agg(F.avg("pcc").alias("pcc_macro"))
    known = rows.sparkSession.createDataFrame(about, "model int, arm string, seeds array<bigint>, n_parameters bigint").withColumn("seed", F.explode("seeds"))  # a row an arm and seed
    return known.drop("seeds").join(pooled, "model").join(macro, "model").drop("model").withColumn("primary_value", F.col("pcc_macro"))


@dataclass
class Explained:
    """Attribution, perturbation and stability of a fitted ridge model on validation rows."""

    model: Ridge
    config: attribution.StabilityConfig = field(default_factory=attribution.StabilityConfig)
    n_seeds: int = 5
    seed: int = 0

    def __post_init__(self):
        data = self.model.data
        self.coefs = self.model.coefs
        self.rows = normalize.subset(data.rows, "val")
        self.baseline = attribution.train_mean_baseline(normalize.subset(data.rows, "train"), data.study.cells)

    def attributions(self) -> DataFrame:
        """Every instance, pair and baseline, for a sink that wants them all."""
        data = self.model.data
        return attribution.linear_attributions(self.rows, linear.named_targets(self.coefs, data.target_names), data.names, self.baseline)

    def ablation(self) -> DataFrame:
        return attribution.ablation_delta(self.rows, self.coefs, self.model.data.names, self.model.data.target_names)

    def permutation(self, seed: int | None = None) -> DataFrame:
        data = self.model.data
        return attribution.permutation_delta(self.rows, self.coefs, data.names, data.target_names, data.columns.n, self.n_seeds, self.seed if seed is None else seed)

    def stability(self, seed: int | None = None, permutation_seed: int | None = None) -> DataFrame:
        data = self.model.data
        units = attribution.unit_gaps(self.rows, data.names, data.columns.n, self.baseline)
        pairs = attribution.linear_stability(units, self.coefs, data.names, data.target_names, self.config, self.seed if seed is None else seed)
        return attribution.candidate_table(pairs, self.ablation(), self.permutation(permutation_seed), self.config, data.task.target_modality)

    def candidates(self, prior: Prior | None = None, **seeds) -> DataFrame:
        """The full candidate table with prior flags."""
        table = self.stability(**seeds)
        if prior is None:
            return table.withColumns({c: F.lit(v) for c, v in (("prior_edge_used", False), ("embedding_supported", False), ("de_novo_model_edge", True))})
        return attribution.prior_flags(table, prior.edges, prior.pathways, prior.embeddings)


__all__ = ["CheckFailed", "Explained", "Forecast", "MODELS", "Prior", "Study", "Task", "benchmark", "config_hash", "final_test", "freeze", "preprocess", "prior_arms", "tune"]
