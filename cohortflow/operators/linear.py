"""Ridge and spline regression of any width from cross products.

Tasks reduce their rows to small cross-product blocks with numpy and Spark sums the blocks. A system of at most
DIRECT columns, or of at most DIRECT rows in its dual form, is solved at once; a larger one
stays in tiles and is eliminated tile by tile (``tiles``). Names, targets and coefficients stay distributed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.operators import tiles
from cohortflow.operators.scan import exact_quantiles
from cohortflow.session import stage

DIRECT = 2048  # side of a system that is solved at once: 32 MB
TILE = 64  # targets whose cross products travel and are solved together
GRAM_ROWS = 16  # Gram rows that travel together
HELD_BYTES = 1 << 28  # target blocks a task holds before it passes them on
SALTS = 32  # partial sums of one block, so that no task gathers it from all others
SHARED_BYTES = 1 << 25  # coefficients that go to every task; more meet the rows block by block


@dataclass
class Header:
    """Names with their places 0..n-1 in alphabetical order: ``table`` has name and at. Only n is on the driver."""

    table: DataFrame
    n: int


def header(df: DataFrame, column: Column) -> Header:
    """The distinct values of a column, numbered without bringing them together."""
    placed, n = tiles.numbered(df.select(column.alias("name")).where("name IS NOT NULL").distinct().orderBy("name"), "at", "header")
    return Header(placed, n)


def feature_header(cells: DataFrame, modalities: list[str]) -> Header:
    """``modality:feature`` names of the inputs."""
    return header(cells.where(F.col("modality").isin(modalities)).select("modality", "feature").distinct(), F.concat_ws(":", "modality", "feature"))


def condition_header(train_obs: DataFrame) -> Header:
    return header(train_obs, F.col("condition"))


def target_header(targets: DataFrame) -> Header:
    return header(targets, F.col("feature"))


def design_header(names: Header, conditions: Header) -> Header:
    """Design columns: inputs, target time, Δt, one column per condition."""
    spark, p = names.table.sparkSession, names.n
    times = spark.createDataFrame([("target_time", p), ("delta_t", p + 1)], "name string, at int")
    hot = conditions.table.select(F.concat(F.lit("condition_"), "name").alias("name"), (F.col("at") + p + 2).cast("int").alias("at"))
    return Header(names.table.unionByName(times).unionByName(hot), p + 2 + conditions.n)


def input_entries(cells: DataFrame, names: Header, key: list[str], value: str) -> DataFrame:
    """Per key the observed inputs as parallel arrays ``at`` and ``v``."""
    known = cells.where(F.col(value).isNotNull()).withColumn("name", F.concat_ws(":", "modality", "feature"))
    packed = known.join(names.table, "name").groupBy(*key).agg(F.collect_list(F.struct("at", F.col(value).cast("double").alias("v"))).alias("e"))
    return packed.select(*key, F.col("e.at").alias("at"), F.col("e.v").alias("v"))


def input_vectors(cells: DataFrame, names: Header, key: list[str], value: str, out: str = "inputs") -> DataFrame:
    """One array per key with its observed inputs in the order of ``names``, gaps as NULL.

    Inputs are packed as positions and values and laid out in Arrow batches. Of a repeated cell the
    largest value counts.
    """
    return densify(input_entries(cells, names, key, value), names.n, out)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every list element, and the elements."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.nan_to_num(np.asarray(col.value_lengths().fill_null(0))).astype(int)
    return np.repeat(np.arange(len(col)), lengths), np.asarray(col.flatten())


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SHARED_BYTES when a row has ``width`` numbers."""
    most = max(1, SHARED_BYTES // (8 * max(1, width)))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), p)


def _lists(values: np.ndarray, gaps: bool = False) -> pa.Array:
    """The rows of a matrix as lists."""
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    flat = values.ravel()
    return pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat) if gaps else None))


def densify(df: DataFrame, width: int, out: str, fill: np.ndarray | None = None) -> DataFrame:
    """Replace ``at, v`` by an array of ``width`` doubles, with ``fill`` (one value a column) or NULL in the gaps."""
    keep = [c for c in df.columns if c not in ("at", "v")]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, width):
            dense = np.full((batch.num_rows, width), np.nan)
            rows, at = _flat(batch.column("at"))
            _, v = _flat(batch.column("v"))
            np.fmax.at(dense, (rows, at), v)
            if fill is not None:
                dense = np.where(np.isnan(dense), fill, dense)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _lists(dense, fill is None)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def column_values(names: Header, width: int, values: DataFrame | None, value: str = "value") -> np.ndarray:
    """One value for each design column (as long as a design row), from rows of name and value; 0 where there is none."""
    out = np.zeros(width)
    if values is not None:
        found = values.join(names.table, "name").select("at", F.col(value).cast("double").alias("v")).toArrow()  # one row a column
        out[found["at"].to_numpy()] = found["v"].to_numpy(zero_copy_only=False)
    return out


def _with_covariates(rows: DataFrame, names: Header, conditions: Header, fill: DataFrame | None, width: int) -> DataFrame:
    """``x`` from the input entries, target time, Δt and the full one-hot condition."""
    p = names.n
    met = rows.join(conditions.table.select(F.col("name").alias("condition"), F.col("at").alias("_c")), "condition", "left")
    hot = F.filter(F.array((F.col("_c") + p + 2).cast("int")), lambda c: c.isNotNull())
    at = F.concat(F.coalesce("at", F.array().cast("array<int>")), F.array(F.lit(p), F.lit(p + 1)), hot)
    v = F.concat(F.coalesce("v", F.array().cast("array<double>")), F.array(F.col("target_time").cast("double"), F.coalesce(F.col("delta_t").cast("double"), F.lit(0.0))), F.transform(hot, lambda _: F.lit(1.0)))
    return densify(met.withColumns({"at": at, "v": v}).drop("_c"), width, "x", column_values(names, width, fill, "fill"))


def subject_design(instances: DataFrame, cells: DataFrame, names: Header, conditions: Header, fill: DataFrame | None, value: str = "scaled") -> DataFrame:
    """Instance rows with ``x`` = last inputs, target time, Δt and the full one-hot condition.

    ``fill`` has name and fill, what stands for an input that is not observed (0 without an entry).
    """
    entries = input_entries(cells, names, ["observation_id"], value).withColumnRenamed("observation_id", "history_observation")
    return _with_covariates(instances.join(entries, "history_observation", "left"), names, conditions, fill, names.n + 2 + conditions.n)


def group_design(instances: DataFrame, keys: DataFrame, means: DataFrame, names: Header, conditions: Header) -> DataFrame:
    """As ``subject_design`` with the as-of train means as inputs; a missing mean is 0.

    The few (condition, target time) pairs are written once: with a known size they go to the instances, which would
    otherwise gather in one task a pair.
    """
    entries = input_entries(means, names, ["condition", "time"], "mean").withColumnsRenamed({"condition": "key_condition", "time": "key_time"})
    per_key = stage(keys.join(entries, ["key_condition", "key_time"], "left"), "key-inputs")
    rows = instances.drop("delta_t").join(per_key, ["condition", "target_time"]).withColumn("delta_t", F.col("target_time") - F.col("key_time"))
    return _with_covariates(rows, names, conditions, None, names.n + 2 + conditions.n)


def targets_per_row(targets: DataFrame, key: str, names: Header, value: str = "y_true") -> DataFrame:
    """Observed targets per row as parallel arrays; rows without any are absent."""
    index = names.table.select(F.col("name").alias("feature"), F.col("at").alias("t"))
    packed = targets.where(F.col(value).isNotNull()).join(index, "feature").groupBy(key).agg(F.collect_list(F.struct("t", F.col(value).alias("y"))).alias("e"))
    return packed.select(key, F.col("e.t").alias("t"), F.col("e.y").alias("y"))


def named_targets(rows: DataFrame, names: Header) -> DataFrame:
    return rows.join(names.table.select(F.col("at").alias("t"), F.col("name").alias("feature")), "t").drop("t")


@dataclass
class Moments:
    """Cross products of a design of at most DIRECT columns: the Gram matrix on the driver, target blocks as a DataFrame."""

    gram: np.ndarray
    sums: np.ndarray
    n: float
    targets: DataFrame  # t, xy array<double>, xm array<double>, of p + 1 values each
    p: int

    def part(self, ranges: list[tuple[int, int]]) -> Moments:
        """Of the columns in some ranges [from, to)."""
        keep = np.r_[tuple(np.arange(a, b) for a, b in ranges)]
        pick = lambda c: F.concat(*[F.slice(c, a + 1, b - a) for a, b in [*ranges, (self.p, self.p + 1)]]).alias(c)
        return Moments(self.gram[np.ix_(keep, keep)], self.sums[keep], self.n, self.targets.select("t", pick("xy"), pick("xm")), len(keep))


@dataclass
class WideRows:
    """A design with more than DIRECT columns: its train rows ``x, t, y``, to be cut into tiles."""

    rows: DataFrame
    p: int

    def part(self, ranges: list[tuple[int, int]]) -> WideRows:
        return WideRows(self.rows.withColumn("x", F.concat(*[F.slice("x", a + 1, b - a) for a, b in ranges])), sum(b - a for a, b in ranges))


def spread(coefs: DataFrame, ranges: list[tuple[int, int]], width: int) -> DataFrame:
    """Coefficients of some column ranges as those of the full design, 0 elsewhere."""
    parts, at, done = [], 0, 0
    for a, b in [*ranges, (width, width)]:
        parts += [F.array_repeat(F.lit(0.0), a - at), F.slice("coef", done + 1, b - a)]
        at, done = b, done + b - a
    return coefs.withColumn("coef", F.concat(*parts))


def moments(rows: DataFrame, p: int) -> Moments | WideRows:
    """One pass over ``x, t, y`` rows.

    A task multiplies its design rows with tiles of targets (and with their masks), so a tile takes two
    matrix products however many cells it has. Blocks of the Gram matrix and of target tiles are
    summed over salted tasks first. Wider designs than DIRECT are kept as rows.
    """
    if p + 1 > DIRECT:
        return WideRows(stage(rows.select("x", "t", "y"), "wide-rows"), p)
    summed = cross_products(rows, p, lambda x: np.hstack([x, np.ones((len(x), 1))]), None, True)
    full = np.zeros((p + 1, p + 1))
    for row in summed.where("kind = 'g'").select("id", "block").collect():  # (p + 1) x (p + 1) numbers
        part = np.frombuffer(row["block"]).reshape(-1, p + 1)
        full[row["id"] : row["id"] + len(part)] = part
    return Moments(full[:p, :p], full[p, :p].copy(), float(full[p, p]), target_rows(summed, p + 1, ("xy", "xm")), p)


def cross_products(rows: DataFrame, p: int, left: Callable[[np.ndarray], np.ndarray], masked: Callable[[np.ndarray], np.ndarray] | None, gram: bool) -> DataFrame:
    """Summed blocks of ``left(x)' y`` and ``masked(x)' m`` per tile of targets, m marking the observed ones, and of ``left(x)' left(x)``.

    The last row of the second product counts the observed targets: its left side has a column of ones at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, held = None, {}
        for batch in _pieces(batches, p):
            x = _matrix(batch.column("x"), p)
            z = left(x)
            z2 = z if masked is None else masked(x)
            if gram:
                square = z.T @ z + (0 if square is None else square)
            at, t = _flat(batch.column("t"))
            _, y = _flat(batch.column("y"))
            order = np.argsort(t // TILE, kind="stable")
            at, t, y = at[order], t[order], y[order]
            names, starts = np.unique(t // TILE, return_index=True)
            for k, lo, hi in zip(names, starts, [*starts[1:], len(t)]):
                dense = np.zeros((2, batch.num_rows, TILE))
                np.add.at(dense[0], (at[lo:hi], t[lo:hi] % TILE), y[lo:hi])
                np.add.at(dense[1], (at[lo:hi], t[lo:hi] % TILE), 1.0)
                block = held.setdefault(int(k), np.zeros((2, z.shape[1], TILE)))
                block[0] += z.T @ dense[0]
                block[1] += z2.T @ dense[1]
                if len(held) * block.nbytes > HELD_BYTES:
                    yield _blocks("t", held)
                    held = {}
        if square is not None:
            yield _blocks("g", {i: square[i : i + GRAM_ROWS] for i in range(0, len(square), GRAM_ROWS)})
        yield _blocks("t", held)

    partial = rows.select("x", "t", "y").mapInArrow(run, "kind string, id int, salt int, block binary")
    salted = partial.groupBy("kind", "id", "salt").applyInArrow(_sum_blocks, "kind string, id int, salt int, block binary")
    return stage(salted.groupBy("kind", "id").applyInArrow(_sum_blocks, "kind string, id int, salt int, block binary"), "moments", ["kind"])


def target_rows(summed: DataFrame, p: int, names: tuple[str, str]) -> DataFrame:
    """One row per observed target from the blocks of ``cross_products``: t and its two columns of p numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, second = np.frombuffer(raw).reshape(2, p, TILE)
                some = np.flatnonzero(second[-1] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(tile * TILE + some, pa.int32()), _lists(first[:, some].T), _lists(second[:, some].T)], names=["t", *names])

    return summed.where("kind = 't'").select("id", "block").mapInArrow(run, f"t int, {names[0]} array<double>, {names[1]} array<double>")


def _blocks(kind: str, blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    salt = TaskContext.get().partitionId() % SALTS
    columns = [pa.array([kind] * len(blocks), pa.string()), pa.array(list(blocks), pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([np.ascontiguousarray(b).tobytes() for b in blocks.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "salt", "block"])


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py()) for b in table["block"])
    return pa.table({"kind": table["kind"][:1], "id": table["id"][:1], "salt": table["salt"][:1], "block": pa.array([total.tobytes()], pa.binary())})


def _solve(mom: Moments, betas, spec: str) -> DataFrame:
    """Apply ``betas(xy, xm, sy, n) -> columns`` to the target rows of a batch at once, inside tasks."""
    p = mom.p
    names = [c.split()[0] for c in spec.split(", ")]

    def run(frames):
        for pdf in frames:
            if len(pdf):
                xy, xm = np.stack(pdf["xy"]), np.stack(pdf["xm"])
                yield pd.DataFrame(dict(zip(names, [pdf["t"], *betas(xy[:, :p], xm[:, :p], xy[:, p], xm[:, p])])))

    return mom.targets.mapInPandas(run, spec)


def penalty_matrix(penalty: DataFrame | None, p: int) -> np.ndarray:
    """A sparse penalty (i, j, value) as the dense p x p addition to a system that is solved at once, p <= DIRECT."""
    out = np.zeros((p, p))
    if penalty is not None:
        for row in tiles.from_entries(penalty).collect():  # (p / BLOCK)^2 tiles
            block = tiles.unpack(row["block"], tiles.BLOCK)
            a, b = row["i"] * tiles.BLOCK, row["j"] * tiles.BLOCK
            out[a : a + tiles.BLOCK, b : b + tiles.BLOCK] = block[: p - a, : p - b]
    return out


def ridge_fit(mom: Moments | WideRows, alpha: float, penalty: DataFrame | None = None, intercept: bool = True) -> DataFrame:
    """Coefficients per target: ``t, coef array<double>, intercept``.

    With an intercept the data are centred and the intercept is not penalised. A missing target
    takes the mean of the observed ones, which adds nothing to the centred cross product.
    ``penalty`` has the entries (i, j, value) of a matrix, such as a graph Laplacian over the columns, that is added to ``alpha * I``.
    """
    if isinstance(mom, WideRows):
        return tiles.ridge(mom.rows, mom.p, [alpha], penalty, intercept, DIRECT).select("t", F.get("coefs", F.lit(0)).alias("coef"), F.get("intercepts", F.lit(0)).alias("intercept"))
    mean = mom.sums / mom.n
    gram = mom.gram - mom.n * np.outer(mean, mean) if intercept else mom.gram
    left = gram + alpha * np.eye(mom.p) + penalty_matrix(penalty, mom.p)
    shared = mom.targets.sparkSession.sparkContext.broadcast((left, mom.sums))  # p is at most DIRECT

    def betas(xy, xm, sy, n):
        left, sums = shared.value
        y_mean = (sy / n)[:, None]
        right = xy - y_mean * xm if intercept else xy + y_mean * (sums - xm)
        coef = np.linalg.solve(left, right.T).T  # one factorisation for all targets of the batch
        return coef.tolist(), (y_mean[:, 0] - coef @ mean if intercept else np.zeros(len(coef))).tolist()

    return _solve(mom, betas, "t int, coef array<double>, intercept double")


def ridge_path(mom: Moments | WideRows, alphas: list[float], intercept: bool = True) -> DataFrame:
    """Coefficients for many penalties: ``t, coefs, intercepts``; a narrow design needs one eigendecomposition of its Gram matrix."""
    if isinstance(mom, WideRows):
        return tiles.ridge(mom.rows, mom.p, alphas, None, intercept, DIRECT)
    mean = mom.sums / mom.n
    gram = mom.gram - mom.n * np.outer(mean, mean) if intercept else mom.gram
    lam, vec = np.linalg.eigh(gram)
    grid = np.asarray(alphas)
    shared = mom.targets.sparkSession.sparkContext.broadcast((lam, vec, mom.sums))  # p is at most DIRECT

    def betas(xy, xm, sy, n):
        lam, vec, sums = shared.value
        y_mean = (sy / n)[:, None]
        right = xy - y_mean * xm if intercept else xy + y_mean * (sums - xm)
        coefs = ((right @ vec)[:, None, :] / (lam + grid[:, None])) @ vec.T  # target x alpha x column
        shift = y_mean - coefs @ mean if intercept else np.zeros(coefs.shape[:2])
        return coefs.tolist(), shift.tolist()

    return _solve(mom, betas, "t int, coefs array<array<double>>, intercepts array<double>")


def coefficient_table(coefs: DataFrame, targets: Header, columns: Header, with_intercept: bool = True) -> DataFrame:
    """Long table ``target, feature, coefficient``."""
    named = named_targets(coefs, targets)
    long = named.select(F.col("feature").alias("target"), F.posexplode("coef").alias("at", "coefficient"))
    long = long.join(columns.table, "at").select("target", F.col("name").alias("feature"), "coefficient")
    if not with_intercept:
        return long
    return long.unionByName(named.select(F.col("feature").alias("target"), F.lit("intercept").alias("feature"), F.col("intercept").alias("coefficient")))


def over_blocks(rows: DataFrame, coefs: DataFrame, width: int, use: Callable[[pa.Table, pa.Table], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """``use(rows, coefs)`` for every block of design rows (with x) and every block of coefficient rows (with t), in tasks.

    Coefficients of up to SHARED_BYTES, ``width`` numbers a row, go to every task. Larger ones meet the rows in a grid of
    blocks of that size, so a task holds one block of either side.
    """
    number = 8 * max(1, width)
    n = coefs.count()
    if n * number <= SHARED_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast(coefs.toArrow())  # SHARED_BYTES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, width):
                if batch.num_rows:
                    yield use(pa.Table.from_batches([batch]), shared.value)

        return rows.mapInArrow(run, schema)
    side = max(1, SHARED_BYTES // number)
    across, down = -(-n // side), max(1, -(-rows.count() // side))
    block = lambda name, count: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int").alias(name)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = stage(rows.select("*", block("_down", down)), "row-blocks").withColumn("_across", every(across))
    right = coefs.withColumn("_across", F.pmod(F.xxhash64("t"), F.lit(across)).cast("int")).withColumn("_down", every(down))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.drop_columns(["_down", "_across"]), b.drop_columns(["_down", "_across"])
        return pa.Table.from_batches([use(a.combine_chunks(), b.combine_chunks())])

    return left.groupBy("_down", "_across").cogroup(right.groupBy("_down", "_across")).applyInArrow(meet, schema)


def predict(rows: DataFrame, coefs: DataFrame, p: int, keep: list[str]) -> DataFrame:
    """``keep``, ``t, y_true, y_pred`` for every observed target of design rows ``x, t, y`` that has coefficients.

    A block of rows and a block of targets take one matrix product, and the observed cells are picked from it, so
    no cell carries a design row. Coefficients may have a column ``model``, which then follows.
    """
    by_model = "model" in coefs.columns
    fields = [rows.schema[c] for c in keep] + [T.StructField("t", T.IntegerType()), T.StructField("y_true", T.DoubleType()), T.StructField("y_pred", T.DoubleType())]
    schema = T.StructType(fields + ([T.StructField("model", T.IntegerType())] if by_model else []))

    def use(block: pa.Table, held: pa.Table) -> pa.RecordBatch:
        parts = []
        if block.num_rows and held.num_rows:
            x = _matrix(block["x"], p)
            at, t = _flat(block["t"])
            _, y = _flat(block["y"])
            models = held["model"].to_numpy() if by_model else np.zeros(held.num_rows, int)
            for model in np.unique(models):
                some = held.filter(pa.array(models == model))
                values = x @ _matrix(some["coef"], p).T + some["intercept"].to_numpy()
                place = np.full(max(int(t.max(initial=0)), int(some["t"].to_numpy().max())) + 1, -1)
                place[some["t"].to_numpy()] = np.arange(some.num_rows)
                known = np.flatnonzero(place[t] >= 0)
                parts.append((at[known], t[known], y[known], values[at[known], place[t[known]]], np.full(len(known), model)))
        at, t, y, values, model = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, int)] * 5
        columns = [block[c].combine_chunks().take(pa.array(at, pa.int64())) for c in keep]
        columns += [pa.array(t, pa.int32()), pa.array(y, pa.float64()), pa.array(values, pa.float64())] + ([pa.array(model, pa.int32())] if by_model else [])
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    held = coefs.select("t", "coef", "intercept", *(["model"] if by_model else []))
    return over_blocks(rows.select(*keep, "x", F.col("t"), F.col("y")), held, p + 1, use, schema)


def residuals(rows: DataFrame, coefs: DataFrame, p: int, keep: list[str]) -> DataFrame:
    """``keep, x`` and the parallel arrays ``t, e`` of design rows ``x, t, y``: prediction less observed value of each target that has coefficients.

    A row stays whole, or has a piece for each block of targets if coefficients meet the rows in blocks; rows without such a target are absent.
    """
    lists = [T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("e", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([rows.schema[c] for c in keep] + lists)

    def use(block: pa.Table, held: pa.Table) -> pa.RecordBatch:
        x, targets = _matrix(block["x"], p), held["t"].to_numpy()
        at, t = _flat(block["t"])
        _, y = _flat(block["y"])
        values = x @ _matrix(held["coef"], p).T + held["intercept"].to_numpy()
        place = np.full(max(int(t.max(initial=0)), int(targets.max(initial=0))) + 1, -1)
        place[targets] = np.arange(len(targets))
        known = np.flatnonzero(place[t] >= 0)
        at, t, e = at[known], t[known], values[at[known], place[t[known]]] - y[known]
        counts = np.bincount(at, minlength=block.num_rows)
        some = np.flatnonzero(counts)
        offsets = pa.array(np.r_[0, np.cumsum(counts[some])].astype(np.int32))
        columns = [block[c].combine_chunks().take(pa.array(some, pa.int64())) for c in keep]
        columns += [_lists(x[some]), pa.ListArray.from_arrays(offsets, pa.array(t, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(e, pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return over_blocks(rows.select(*keep, "x", "t", "y"), coefs.select("t", "coef", "intercept"), p + 1, use, schema)


def log_uniform(low: float, high: float, n: int, seed: int) -> list[float]:
    """Seeded log-uniform candidates: a fixed budget over a fixed range."""
    a, b = np.log10(low), np.log10(high)
    unit = [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(n)]
    return [float(10 ** (a + u * (b - a))) for u in unit]


def sweep_scores(rows: DataFrame, paths: DataFrame, p: int, alphas: list[float]) -> DataFrame:
    """Masked validation mse and mae of every candidate in one pass over the design rows."""

    def use(block: pa.Table, held: pa.Table) -> pa.RecordBatch:
        sums = np.zeros((len(alphas), 3))
        if block.num_rows and held.num_rows:
            x = _matrix(block["x"], p)
            at, t = _flat(block["t"])
            _, y = _flat(block["y"])
            targets = held["t"].to_numpy()
            coefs = np.asarray(held["coefs"].combine_chunks().flatten().flatten(), dtype=float).reshape(len(targets), len(alphas), p)
            shift = _matrix(held["intercepts"], len(alphas))
            place = np.full(max(int(t.max(initial=0)), int(targets.max())) + 1, -1)
            place[targets] = np.arange(len(targets))
            known = np.flatnonzero(place[t] >= 0)
            for k in range(len(alphas)):
                gap = y[known] - (x @ coefs[:, k].T + shift[:, k])[at[known], place[t[known]]]
                sums[k] = (gap * gap).sum(), np.abs(gap).sum(), len(known)
        columns = [pa.array(range(len(alphas)), pa.int64()), *[pa.array(c) for c in sums.T]]
        return pa.RecordBatch.from_arrays(columns, names=["trial", "sse", "sae", "n"])

    parts = over_blocks(rows.select("x", "t", "y"), paths, len(alphas) * (p + 1), use, "trial bigint, sse double, sae double, n double")
    grid = F.array(*[F.lit(a) for a in alphas])
    summed = parts.groupBy("trial").agg(F.sum("sse").alias("sse"), F.sum("sae").alias("sae"), F.sum("n").alias("n")).where("n > 0")
    return summed.select("trial", F.element_at(grid, F.col("trial").cast("int") + 1).alias("alpha"), (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"), F.col("n").cast("bigint").alias("n"))


def best_trial(trials: DataFrame, metric: str = "mse") -> DataFrame:
    """Trial with the smallest error; the earlier trial wins a tie."""
    return trials.agg(F.min_by(F.struct("trial", "alpha", "mse", "mae", "n"), F.struct(metric, "trial")).alias("b")).select("b.*")


def spline_knots(times: DataFrame, df: int, degree: int = 3) -> tuple[float, list[float], float]:
    """Boundary knots (train min, max) and inner knots at train quantiles for ``df`` columns."""
    if df < degree:
        raise ValueError(f"{df} columns are fewer than the spline degree {degree}.")
    inner = df - degree
    probs = [0.0, *[(i + 1) / (inner + 1) for i in range(inner)], 1.0]
    q = exact_quantiles(times, "time", probs, "spline-knots")
    return q[0], q[1:-1], q[-1]


def spline_basis(time: Column, low: float, inner: list[float], high: float, degree: int = 3) -> list[Column]:
    """B-spline columns without the first one; the last interval is closed on the right."""
    knots = [low] * (degree + 1) + list(inner) + [high] * (degree + 1)
    last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
    level = []
    for i in range(len(knots) - 1):
        inside = (time >= knots[i]) & ((time <= knots[i + 1]) if i == last else (time < knots[i + 1]))
        level.append(F.when(inside, 1.0).otherwise(0.0) if knots[i] < knots[i + 1] else F.lit(0.0))
    for d in range(1, degree + 1):
        step = []
        for i in range(len(level) - 1):
            col = F.lit(0.0)
            if knots[i + d] > knots[i]:
                col = col + (time - knots[i]) / (knots[i + d] - knots[i]) * level[i]
            if knots[i + d + 1] > knots[i + 1]:
                col = col + (knots[i + d + 1] - time) / (knots[i + d + 1] - knots[i + 1]) * level[i + 1]
            step.append(col)
        level = step
    return level[1:]


def spline_design(df: DataFrame, time: str, conditions: Header, knots: tuple[float, list[float], float]) -> DataFrame:
    """``x`` = intercept, treatment-coded condition, basis, and their interaction.

    The basis is zero outside the train time range; ``outside_range`` lists such rows, which callers refuse.
    """
    low, inner, high = knots
    basis = F.array(*spline_basis(F.col(time), low, inner, high))
    c, width = max(0, conditions.n - 1), len(inner) + 3
    met = df.join(conditions.table.select(F.col("name").alias("condition"), F.col("at").alias("_c")), "condition", "left").withColumn("_b", basis)
    plain = F.sequence(F.lit(0), F.lit(width - 1))
    own = F.coalesce(F.col("_c"), F.lit(0)) > 0
    at = F.concat(F.array(F.lit(0)), F.transform(plain, lambda i: i + 1 + c))
    v = F.concat(F.array(F.lit(1.0)), F.col("_b"))
    # A row has one condition: its column, and the columns of its products with the basis.
    at = F.when(own, F.concat(at, F.array(F.col("_c")), F.transform(plain, lambda i: F.lit(1 + c + width) + i * c + F.col("_c") - 1))).otherwise(at)
    v = F.when(own, F.concat(v, F.array(F.lit(1.0)), F.col("_b"))).otherwise(v)
    placed = met.withColumns({"at": F.transform(at, lambda i: i.cast("int")), "v": v}).drop("_b", "_c")
    full = (1 + c) * (1 + width)
    return densify(placed, full, "x", np.zeros(full))


def spline_header(conditions: Header, width: int) -> Header:
    """Column names of ``spline_design``."""
    spark, c = conditions.table.sparkSession, max(0, conditions.n - 1)
    fixed = spark.createDataFrame([("Intercept", 0), *[(f"bs(time)[{i}]", 1 + c + i) for i in range(width)]], "name string, at int")
    extra = conditions.table.where("at > 0").select(F.concat(F.lit("C(condition)[T."), "name", F.lit("]")).alias("name"), "at")
    of_basis = extra.select("name", "at", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    both = of_basis.select(F.concat(F.lit("bs(time)["), F.col("i").cast("string"), F.lit("]:"), "name").alias("name"), (F.lit(c + width) + F.col("i") * c + F.col("at")).cast("int").alias("at"))
    return Header(fixed.unionByName(extra).unionByName(both), (1 + c) * (1 + width))


def outside_range(df: DataFrame, time: str, knots: tuple[float, list[float], float]) -> DataFrame:
    return df.where(~F.col(time).between(knots[0], knots[2]))
