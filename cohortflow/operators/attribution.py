"""Attributions of a linear model, their perturbation checks and the stability table.

Instances carry ``x``, the input vector in the order of ``names``. Only validation instances may
be passed in. Attributions are prediction contributions and every candidate is a hypothesis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions.hashing import seeded_digest
from cohortflow.functions.numeric import ZERO_VARIANCE, dead_sign
from cohortflow.operators.linear import Header, column_values, cross_products, residuals, target_rows
from cohortflow.operators.resample import drawn_units
from cohortflow.operators.scan import prefix_scan, range_buckets, shuffled_position
from cohortflow.session import stage

CLAIM_KIND = "hypothesis"
# Fixed value: text every candidate row carries.
CAVEAT = (
    "These rows are hypotheses about model prediction contributions. "
    "Attribution is not causation. Absence of a paper is not novelty."
)
BASELINES = ("zeros", "train_mean", "last_observation")


@dataclass(frozen=True)
class StabilityConfig:
    n_bootstrap: int = 5
    n_folds: int = 2
    top_k_per_target: int = 5
    min_sign_consistency: float = 0.6
    min_selection_frequency: float = 0.4
    min_stability: float = 0.4


def input_rows(rows: DataFrame, names: Header, keep: list[str]) -> DataFrame:
    """One row per instance and input; only for a sink that wants them all."""
    long = rows.select(*keep, F.posexplode(F.slice("x", 1, names.n)).alias("at", "x_s"))
    return long.join(names.table.select("at", F.col("name").alias("source")), "at").select(*keep, "source", "x_s")


def pair_rows(values: DataFrame, names: Header, targets: Header, columns: list[str]) -> DataFrame:
    """``source, target`` and some columns from one row per target with an array per column, in the order of the inputs."""
    long = values.select("t", F.posexplode(F.arrays_zip(*columns)).alias("at", "_v")).select("t", "at", *[F.col("_v")[c].alias(c) for c in columns])
    named = long.join(names.table.select("at", F.col("name").alias("source")), "at").join(targets.table.select(F.col("at").alias("t"), F.col("name").alias("target")), "t")
    return named.select("source", "target", *columns)


def coefficient_rows(coefs: DataFrame, names: Header) -> DataFrame:
    """``source, target, coef`` for the input features only, from coefficients with their target's ``feature``."""
    long = coefs.select(F.col("feature").alias("target"), F.posexplode(F.slice("coef", 1, names.n)).alias("at", "coef"))
    return long.join(names.table.select("at", F.col("name").alias("source")), "at").select("source", "target", "coef")


def train_mean_baseline(train_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean of the observed inputs at the history observations of the train instances."""
    known = cells.where("scaled IS NOT NULL").select(F.col("observation_id").alias("history_observation"), F.concat_ws(":", "modality", "feature").alias("source"), "scaled")
    return train_rows.select("history_observation").join(known, "history_observation").groupBy("source").agg(F.avg("scaled").alias("baseline_value"))


def linear_attributions(rows: DataFrame, coefs: DataFrame, names: Header, baseline: DataFrame) -> DataFrame:
    """Path-integrated gradients, exact for a linear model: coef x (x - baseline).

    The last-observation baseline of a single snapshot is the input itself, so its value is 0.
    """
    inputs = input_rows(rows, names, ["instance_id", "group_id"]).join(baseline, "source", "left")
    gaps = F.array(
        F.struct(F.lit("zeros").alias("baseline"), F.col("x_s").alias("gap")),
        F.struct(F.lit("train_mean").alias("baseline"), (F.col("x_s") - F.coalesce("baseline_value", F.lit(0.0))).alias("gap")),
        F.struct(F.lit("last_observation").alias("baseline"), F.lit(0.0).alias("gap")),
    )
    long = inputs.select("instance_id", "group_id", "source", F.explode(gaps).alias("g"))
    return long.join(coefficient_rows(coefs, names), "source").select(
        "instance_id", "group_id", "source", "target", "g.baseline", (F.col("coef") * F.col("g.gap")).alias("value")
    )


def unit_attributions(attributions: DataFrame) -> DataFrame:
    """Per unit and pair: summed attribution and how many values are behind it."""
    return attributions.groupBy("group_id", "source", "target").agg(F.sum("value").alias("s"), F.count("*").alias("n"))


#: Partial sums of one unit, so that no task gathers a unit with very many instances.
SALTS = 32


def unit_gaps(rows: DataFrame, names: Header, width: int, baseline: DataFrame) -> DataFrame:
    """``group_id, gap array<double>, n``: per unit the summed input gaps to all three baselines, and how many values a pair has.

    An attribution of a linear model is a coefficient times a gap, so these and the coefficients hold all of
    ``linear_attributions`` without a row for an instance and pair.
    """
    p = names.n
    base = column_values(names, p, baseline.withColumnsRenamed({"source": "name", "baseline_value": "value"}))
    schema = T.StructType([T.StructField("group_id", rows.schema["group_id"].dataType), T.StructField("salt", T.IntegerType()), T.StructField("gap", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, width)[:, :p]
            units = batch.column(0).dictionary_encode(null_encoding="encode")
            places = units.indices.to_numpy(zero_copy_only=False)
            sums, n = np.zeros((len(units.dictionary), p)), np.bincount(places, minlength=len(units.dictionary))
            np.add.at(sums, places, 2 * x - base)  # zeros and train mean; the last observation is the input itself
            yield pa.RecordBatch.from_arrays([units.dictionary, pa.array([salt] * len(n), pa.int32()), pa.array([v.tobytes() for v in sums], pa.binary()), pa.array(n * len(BASELINES), pa.int64())], names=["group_id", "salt", "gap", "n"])

    def put(keys: pa.RecordBatch, gaps: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys.columns, pa.array([v.tobytes() for v in gaps], pa.binary()), pa.array(n, pa.int64())], names=["group_id", "salt", "gap", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) * SALTS + batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            gaps = np.add.reduceat(np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(batch.num_rows, p), starts, axis=0)
            n = np.add.reduceat(batch.column(3).to_numpy(), starts)
            keys = batch.select([0, 1]).take(pa.array(starts))
            if last and last[0].equals(keys.slice(0, 1)):
                gaps[0] += last[1][0]
                n[0] += last[2][0]
            elif last:
                yield put(*last)
            yield put(keys.slice(0, len(starts) - 1), gaps[:-1], n[:-1])
            last = keys.slice(len(starts) - 1), gaps[-1:], n[-1:]
        if last:
            yield put(*last)

    # Rows sorted by unit are summed as they stream past: no call for each unit, and no unit is gathered.
    salted = rows.select("group_id", "x").mapInArrow(run, schema).repartition("group_id", "salt").sortWithinPartitions("group_id", "salt").mapInArrow(add, schema)
    whole = salted.withColumn("salt", F.lit(0)).repartition("group_id").sortWithinPartitions("group_id").mapInArrow(add, schema)
    return stage(whole.drop("salt"), "unit-gaps")


def weighted_gaps(units: DataFrame, weights: DataFrame, series: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Per series the weighted sums of the units' gaps and of their counts. ``weights``: group_id, series array<int>, times array<bigint>.

    The result has ``series`` design rows; tasks send one partial sum each, in blocks of columns.
    """
    wide = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((series, p + 1))
        for batch in batches:
            if batch.num_rows:
                gaps = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, p)
                values = np.hstack([gaps, batch.column(1).to_numpy()[:, None].astype(float)])
                spread = np.zeros((batch.num_rows, series))
                at = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
                np.add.at(spread, (at, batch.column(2).flatten().to_numpy(zero_copy_only=False)), batch.column(3).flatten().to_numpy(zero_copy_only=False))
                total += spread.T @ values
        cuts = range(0, p + 1, wide)
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([np.ascontiguousarray(total[:, c : c + wide]).tobytes() for c in cuts], pa.binary())], names=["at", "block"])

    def add(part: pa.Table) -> pa.Table:
        return pa.table([part["at"][:1], pa.array([sum(np.frombuffer(b.as_py()) for b in part["block"]).tobytes()], pa.binary())], names=["at", "block"])

    met = units.join(weights, "group_id").select("gap", "n", "series", "times")
    out = np.zeros((series, p + 1))
    for row in met.mapInArrow(run, "at int, block binary").groupBy("at").applyInArrow(add, "at int, block binary").collect():  # ``series`` design rows
        block = np.frombuffer(row["block"]).reshape(series, -1)
        out[:, row["at"] : row["at"] + block.shape[1]] = block
    return out[:, :p], out[:, p]


def linear_stability(units: DataFrame, coefs: DataFrame, names: Header, targets: Header, config: StabilityConfig, seed: int) -> DataFrame:
    """Mean, bootstrap and fold agreement of every pair of a linear model, as ``pair_stability`` has them from long rows.

    A pair's mean in a replicate or fold is its coefficient times the input's mean gap there. The mean gaps, one
    design row for each replicate and fold, go to every task; a task takes a target's coefficients and gives its pairs.
    """
    p, boots = names.n, config.n_bootstrap
    ids = units.select("group_id")
    drawn = drawn_units(ids, [], "group_id", boots, seed)
    draws = drawn.select("group_id", F.transform("drawn", lambda d: d["replicate"].cast("int")).alias("series"), F.transform("drawn", lambda d: d["times"]).alias("times"))
    folds = unit_folds(ids, config.n_folds).select("group_id", F.array(F.col("fold").cast("int") + boots, F.lit(boots + config.n_folds)).alias("series"), F.array(F.lit(1).cast("bigint"), F.lit(1).cast("bigint")).alias("times"))
    sums, n = weighted_gaps(units, draws.unionByName(folds), boots + config.n_folds + 1, p)
    alive = n > 0
    gaps = np.divide(sums, n[:, None], where=alive[:, None], out=np.zeros_like(sums))
    shared = units.sparkSession.sparkContext.broadcast((gaps, alive))  # a design row for each replicate and fold
    columns = ["mean_attribution", "_sb", "rank_median", "selection_frequency", "bootstrap_low", "bootstrap_high", "_sf"]
    top = config.top_k_per_target

    def sign(v: np.ndarray) -> np.ndarray:
        return np.where(v >= ZERO_VARIANCE, 1, np.where(v <= -ZERO_VARIANCE, -1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, alive = shared.value
        boot, fold = gaps[:boots][alive[:boots]], gaps[boots:-1][alive[boots:-1]]
        for batch in batches:
            for at in range(batch.num_rows):
                coef = np.asarray(batch.column(1)[at].values, dtype=float)[:p]
                mean, values, parts = coef * gaps[-1], coef * boot, coef * fold
                own = sign(mean)
                agrees = lambda v: np.where((sign(v) == own) | (own == 0), 1.0, 0.0).mean(axis=0)
                ranks = np.empty(values.shape)
                order = np.argsort(-np.abs(values), axis=1, kind="stable")  # inputs are in alphabetical order, so ties go by name
                np.put_along_axis(ranks, order, np.broadcast_to(np.arange(1.0, p + 1), values.shape), axis=1)
                out = [mean, agrees(values), np.median(ranks, axis=0), (ranks <= top).mean(axis=0), *np.percentile(values, [2.5, 97.5], axis=0), agrees(parts)]
                lists = [pa.array([v], pa.list_(pa.float64())) for v in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), *lists], names=["t", *columns])

    values = coefs.select("t", "coef").mapInArrow(run, "t int, " + ", ".join(f"{c} array<double>" for c in columns))
    return pair_rows(values, names, targets, columns)


def ablation_delta(rows: DataFrame, coefs: DataFrame, names: Header, targets: Header) -> DataFrame:
    """Mean absolute change of the prediction when one source is set to 0."""
    p = names.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + 1)
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), dtype=float).reshape(batch.num_rows, -1)[:, :p]
                total += np.r_[np.abs(x).sum(axis=0), batch.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(part: pa.Table) -> pa.Table:
        return pa.table([part["salt"][:1], pa.array([sum(np.frombuffer(b.as_py()) for b in part["v"]).tobytes()], pa.binary())], names=["salt", "v"])

    salted = rows.select("x").mapInArrow(run, "v binary").withColumn("salt", (F.spark_partition_id() % SALTS).cast("int"))
    parts = salted.groupBy("salt").applyInArrow(add, "salt int, v binary").collect()  # SALTS design rows at most
    total = sum((np.frombuffer(r["v"]) for r in parts), np.zeros(p + 1))
    size = coefs.sparkSession.sparkContext.broadcast(total[:p] / max(1.0, total[p]))  # one design row

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.abs(np.asarray(c.values, dtype=float)[:p]) * size.value for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["t", "ablation_delta"])

    values = coefs.select("t", "coef").mapInArrow(scale, "t int, ablation_delta array<double>")
    return pair_rows(values, names, targets, ["ablation_delta"])


def permuted_partners(rows: DataFrame, n_seeds: int, seed: int) -> DataFrame:
    """Per seed, each instance's partner under a shuffle inside its condition.

    Two numberings per condition (by id digest, by seeded digest) are matched on position; both are
    bucketed by digest, so a condition with most of the rows is still spread out. A condition with
    one instance keeps it.
    """
    ids = rows.select("instance_id", "condition")
    fixed = shuffled_position(ids.withColumn("_digest", F.md5("instance_id")), ["condition"], "_digest", ["instance_id"])
    seeded = ids.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1)))).withColumn(
        "_digest", seeded_digest(seed, F.col("seed").cast("string"), F.col("instance_id"))
    )
    mixed = shuffled_position(seeded, ["condition", "seed"], "_digest", ["instance_id"]).select(
        "condition", "seed", "position", F.col("instance_id").alias("partner_id")
    )
    return fixed.select("instance_id", "condition", "position").join(mixed, ["condition", "position"]).select("seed", "instance_id", "partner_id")


def permutation_delta(rows: DataFrame, coefs: DataFrame, names: Header, targets: Header, width: int, n_seeds: int, seed: int) -> DataFrame:
    """Mean over seeds of (permuted MSE - base MSE) per source and target.

    ``rows`` are design rows with their observed targets (x, t, y). With another row's inputs the prediction is
    ``y_pred + coef * (x_partner - x)``, so the change of the squared error is a sum of two moments per pair: of
    the residual times the input change D, and of its square. Both are matrix products, E'D and M'(D*D), summed
    over tiles of targets and all seeds; there is no row for a seed and cell. A row of a wide model may come in pieces,
    each with some of its targets, as the products add up.
    """
    p = names.n
    told = residuals(rows, coefs, width, ["instance_id"]).withColumn("x", F.slice("x", 1, p))
    partners = rows.select(F.col("instance_id").alias("partner_id"), F.slice("x", 1, p).alias("_px"))
    moved = (
        permuted_partners(rows, n_seeds, seed).join(told, "instance_id").join(partners, "partner_id")
        .select(F.concat("_px", "x").alias("x"), "t", F.col("e").alias("y"))
    )
    gap = lambda both: both[:, :p] - both[:, p:]
    ones = lambda d: np.hstack([d, np.ones((len(d), 1))])
    summed = target_rows(cross_products(moved, 2 * p, lambda d: ones(gap(d)), lambda d: ones(gap(d) ** 2), False), p + 1, ("ed", "dd"))
    met = summed.join(coefs.select("t", F.slice("coef", 1, p).alias("coef")), "t").withColumn("n", F.element_at("dd", -1))
    both = F.zip_with(F.slice("ed", 1, p), F.slice("dd", 1, p), lambda a, b: F.struct(a.alias("ed"), b.alias("dd")))
    delta = F.zip_with("coef", both, lambda c, m: (2 * c * m["ed"] + c * c * m["dd"]) / F.col("n"))
    return pair_rows(met.select("t", delta.alias("permutation_delta")), names, targets, ["permutation_delta"])


def bootstrap_means(units: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """``replicate, source, target, value``: unit bootstrap of the mean attribution."""
    drawn = drawn_units(units, [], "group_id", n_bootstrap, seed)
    exploded = units.join(drawn, "group_id").select("source", "target", "s", "n", F.explode("drawn").alias("d"))
    return exploded.groupBy("d.replicate", "source", "target").agg(
        (F.sum(F.col("s") * F.col("d.times")) / F.sum(F.col("n") * F.col("d.times"))).alias("value")
    )


def unit_folds(units: DataFrame, n_folds: int) -> DataFrame:
    """Contiguous folds of the sorted units; early folds take the remainder."""
    ids = range_buckets(units.select("group_id").distinct(), ["group_id"], "fold-units")
    placed = prefix_scan(ids, [], ["group_id"], sums={"position": F.lit(1).cast("bigint")})
    total = ids.agg(F.count("*")).scalar()
    k = F.least(F.lit(n_folds), F.greatest(F.lit(2), F.col("_n"))).cast("bigint")
    q, r, p = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("position") - 1
    fold = F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor((p - r * (q + 1)) / q))
    return placed.withColumn("_n", total).select("group_id", fold.cast("bigint").alias("fold"))


def fold_means(units: DataFrame, n_folds: int) -> DataFrame:
    """Mean attribution over the folds of the units."""
    return units.join(unit_folds(units, n_folds), "group_id").groupBy("fold", "source", "target").agg((F.sum("s") / F.sum("n")).alias("value"))


def attribution_ranks(boot: DataFrame) -> DataFrame:
    """1-based rank per replicate and target by absolute value; a group has one row per source."""
    w = Window.partitionBy("replicate", "target").orderBy(F.abs("value").desc(), "source")
    return boot.withColumn("rank", F.row_number().over(w))


def pair_stability(units: DataFrame, config: StabilityConfig, seed: int) -> DataFrame:
    """Mean, bootstrap and fold agreement of every pair from long rows ``unit_attributions`` of any model."""
    pair = ["source", "target"]
    mean = units.groupBy(*pair).agg((F.sum("s") / F.sum("n")).alias("mean_attribution")).withColumn("_sign", dead_sign(F.col("mean_attribution")))
    boot = attribution_ranks(bootstrap_means(units, config.n_bootstrap, seed)).join(mean, pair)
    agree = F.when((dead_sign(F.col("value")) == F.col("_sign")) | (F.col("_sign") == 0), 1.0).otherwise(0.0)
    per_boot = boot.groupBy(*pair).agg(
        F.avg(agree).alias("_sb"), F.median("rank").alias("rank_median"),
        F.avg(F.when(F.col("rank") <= config.top_k_per_target, 1.0).otherwise(0.0)).alias("selection_frequency"),
        F.percentile("value", F.lit(0.025)).alias("bootstrap_low"), F.percentile("value", F.lit(0.975)).alias("bootstrap_high"),
    )
    per_fold = fold_means(units, config.n_folds).join(mean, pair).groupBy(*pair).agg(F.avg(agree).alias("_sf"))
    return mean.join(per_boot, pair).join(per_fold, pair).drop("_sign")


def stability_table(units: DataFrame, ablation: DataFrame, permutation: DataFrame, config: StabilityConfig, seed: int, target_modality: str) -> DataFrame:
    """Candidate rows from ``unit_attributions``. Sources and targets are ``modality:feature``."""
    return candidate_table(pair_stability(units, config, seed), ablation, permutation, config, target_modality)


def candidate_table(pairs: DataFrame, ablation: DataFrame, permutation: DataFrame, config: StabilityConfig, target_modality: str) -> DataFrame:
    """Candidate rows with sign consistency, rank, selection frequency, bounds and the pass flag."""
    pair = ["source", "target"]
    table = pairs.join(ablation, pair, "left").join(permutation, pair, "left")
    table = table.withColumn("sign_consistency", 0.5 * F.col("_sb") + 0.5 * F.col("_sf"))
    table = table.withColumn("stability", 0.5 * F.col("sign_consistency") + 0.5 * F.col("selection_frequency"))
    passed = (
        (F.col("sign_consistency") >= config.min_sign_consistency)
        & (F.col("selection_frequency") >= config.min_selection_frequency)
        & (F.col("stability") >= config.min_stability)
    )
    direction = F.when(F.col("mean_attribution") > ZERO_VARIANCE, "up").when(F.col("mean_attribution") < -ZERO_VARIANCE, "down").otherwise("unknown")
    table = table.withColumns({"passed_stability": passed, "predicted_direction": direction}).withColumn("target", F.concat_ws(":", F.lit(target_modality), "target"))
    return table.withColumns(
        {
            "candidate_id": F.concat_ws("->", *pair),
            "source_modality": F.substring_index("source", ":", 1), "source_id": F.expr("substr(source, instr(source, ':') + 1)"),
            "target_modality": F.lit(target_modality), "target_id": F.expr("substr(target, instr(target, ':') + 1)"),
            "claim_kind": F.lit(CLAIM_KIND), "caveat": F.lit(CAVEAT),
        }
    ).drop("_sb", "_sf")


def ordered_candidates(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("stability").desc(), F.abs("mean_attribution").desc(), "candidate_id")


def select_stable(table: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` candidates that passed."""
    return ordered_candidates(table.where("passed_stability")).limit(top_n)


def prior_flags(candidates: DataFrame, edges: DataFrame, pathways: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """Whether a candidate has a prior edge (either direction or a shared pathway family), whether
    both ends have a non-zero vector, and whether it is new to the prior."""
    low, high = F.least("source", "target"), F.greatest("source", "target")
    ends = edges.select(F.concat_ws(":", "source_modality", "source_id").alias("source"), F.concat_ws(":", "target_modality", "target_id").alias("target"))
    known = ends.select(low.alias("source"), high.alias("target")).distinct().select(F.struct("source", "target").alias("_pair"), F.lit(True).alias("_edge"))
    # Families are matched by equi-joins from the candidate side, never by listing member pairs.
    family = pathways.select(
        F.replace("pathway_id", F.lit("-PROT"), F.lit("")).alias("family"), F.concat_ws(":", "modality", "feature").alias("node")
    ).distinct()
    shared = (
        candidates.select("source", "target")
        .join(family.withColumnRenamed("node", "source"), "source").join(family.withColumnRenamed("node", "target"), ["target", "family"])
        .select("source", "target").distinct().withColumn("_family", F.lit(True))
    )
    out = candidates.withColumn("_pair", F.struct(low.alias("source"), high.alias("target"))).join(known, "_pair", "left").drop("_pair").join(shared, ["source", "target"], "left")
    edge = F.coalesce("_edge", F.lit(False)) | F.coalesce("_family", F.lit(False))
    out = out.withColumn("prior_edge_used", edge).withColumn("de_novo_model_edge", ~edge).drop("_edge", "_family")
    if embeddings is None:
        return out.withColumn("embedding_supported", F.lit(False))
    alive = embeddings.where(F.exists("embedding", lambda v: v != 0)).select(F.concat_ws(":", "modality", "feature").alias("node")).distinct()
    for end in ("source", "target"):
        out = out.join(alive.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    both = F.coalesce("_source", F.lit(False)) & F.coalesce("_target", F.lit(False))
    return out.withColumn("embedding_supported", both).drop("_source", "_target")
