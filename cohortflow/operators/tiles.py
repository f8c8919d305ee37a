"""Matrices as DataFrames of tiles: products, elimination and ridge systems that no single task can hold.

A tile is (i, j, block): BLOCK rows of doubles, zero where the matrix ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.session import discard, stage

BLOCK = 512  # side of a tile: 2 MB
WIDE = 64  # targets of a tile of right-hand sides
SCHEMA = "i int, j int, block binary"


def unpack(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def numbered(df: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """The rows with a number 0..n-1 in the order they come in, and n. Written once, so the numbers hold.

    Only one count a partition reaches the driver.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(df.select("*", F.spark_partition_id().alias("_part"), within.alias("_row")), label)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), F.col("_part") + 1)
    return placed.withColumn(name, (F.col("_row") + start).cast("int")).drop("_part", "_row"), total


def from_entries(entries: DataFrame) -> DataFrame:
    """Tiles of the entries (i, j, value), equal places summed; tiles without an entry are absent."""
    summed = entries.groupBy("i", "j").agg(F.sum("value").alias("value"))

    def run(part: pa.Table) -> pa.Table:
        out = np.zeros((BLOCK, BLOCK))
        out[part["i"].to_numpy() % BLOCK, part["j"].to_numpy() % BLOCK] = part["value"].to_numpy()
        return pa.table([part["bi"][:1], part["bj"][:1], pa.array([out.tobytes()], pa.binary())], names=["i", "j", "block"])

    at = summed.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("value").cast("double"), F.floor(F.col("i") / BLOCK).cast("int").alias("bi"), F.floor(F.col("j") / BLOCK).cast("int").alias("bj"))
    return at.groupBy("bi", "bj").applyInArrow(run, SCHEMA)


def _tile(i: list[int], j: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "block"])


def added(parts: DataFrame, ways: int = 1) -> DataFrame:
    """The sum of tiles with the same place, over ``ways`` partial sums so that no task gathers very many."""

    def run(same: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in same["block"])
        return pa.table([same["i"][:1], same["j"][:1], pa.array([total.tobytes()], pa.binary())], names=["i", "j", "block"])

    if ways > 1:
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ways)).cast("int")
        parts = parts.withColumn("salt", salt).groupBy("i", "j", "salt").applyInArrow(lambda same: run(same), SCHEMA)
    return parts.groupBy("i", "j").applyInArrow(run, SCHEMA)


def product(a: DataFrame, b: DataFrame, steps: int, turn: bool = False) -> DataFrame:
    """The matrix product of tiles a(i, k) and b(k, j) over ``steps`` values of k; with ``turn`` a is given as (k, i) and turned."""
    left = a.select(F.col("j" if turn else "i").alias("i"), F.col("i" if turn else "j").alias("k"), F.col("block").alias("left"))
    right = b.select(F.col("i").alias("k"), "j", F.col("block").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                i, j, x, y = (batch.column(c)[n].as_py() for c in range(4))
                x = unpack(x, BLOCK)
                yield _tile([i], [j], [(x.T if turn else x) @ unpack(y, BLOCK)])

    return added(left.join(right, "k").select("i", "j", "left", "right").mapInArrow(run, SCHEMA), int(np.ceil(np.sqrt(steps))))


def solved(system: DataFrame, right: DataFrame, side: int, direct: int) -> DataFrame:
    """The tiles x(i, j) with system x = right. ``system`` is symmetric, positive definite and ``side`` tiles wide.

    Up to ``direct`` rows are inverted at once. Beyond, each step clears one column of tiles from all others (Gauss-Jordan), right-hand
    sides included: a step reads and writes the tiles once, only its pivot tile is on the driver, and there are as many steps as tiles
    on the diagonal.
    """
    spark = system.sparkSession
    if side * BLOCK <= max(direct, BLOCK):
        whole = np.zeros((side * BLOCK, side * BLOCK))
        for row in system.collect():  # direct x direct numbers at most
            a, b = row["i"] * BLOCK, row["j"] * BLOCK
            whole[a : a + BLOCK, b : b + BLOCK] = unpack(row["block"], BLOCK)
        shared = spark.sparkContext.broadcast(np.linalg.inv(whole))

        def run(column: pa.Table) -> pa.Table:
            stack = np.zeros((side, BLOCK, len(unpack(column["block"][0].as_py(), BLOCK)[0])))
            for i, raw in zip(column["i"].to_pylist(), column["block"]):
                stack[i] = unpack(raw.as_py(), BLOCK)
            out = (shared.value @ stack.reshape(side * BLOCK, -1)).reshape(stack.shape)
            return pa.Table.from_batches([_tile(list(range(side)), [column["j"][0].as_py()] * side, list(out))])

        return right.groupBy("j").applyInArrow(run, SCHEMA)
    state = stage(system.union(right.withColumn("j", (F.col("j") + side).cast("int"))), "elimination")
    for k in range(side):
        pivot = state.where(f"i = {k} AND j = {k}").select("block").first()["block"]  # one tile
        inverse = spark.sparkContext.broadcast(np.linalg.inv(unpack(pivot, BLOCK)))

        def scale(batches: Iterator[pa.RecordBatch], inverse=inverse) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = [inverse.value @ unpack(b.as_py(), BLOCK) for b in batch.column(2)]
                yield _tile(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blocks)

        def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    i, j, block, column, row = (batch.column(c)[n].as_py() for c in range(5))
                    yield _tile([i], [j], [unpack(block, BLOCK) - unpack(column, BLOCK) @ unpack(row, BLOCK)])

        row = stage(state.where(f"i = {k} AND j > {k}").mapInArrow(scale, SCHEMA), "pivot-row")
        column = state.where(f"j = {k} AND i <> {k}").select("i", F.col("block").alias("column"))
        rest = state.where(f"j > {k} AND i <> {k}").join(column, "i").join(row.select("j", F.col("block").alias("row")), "j")
        before, state = state, stage(rest.select("i", "j", "block", "column", "row").mapInArrow(clear, SCHEMA).union(row), "elimination")
        discard(before, row)
    return state.select("i", (F.col("j") - side).cast("int").alias("j"), "block")


def design_tiles(rows: DataFrame, p: int) -> DataFrame:
    """Tiles of the design: row r (``r``) of the numbers ``x``."""
    wide = -(-p // BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, (1 << 22) // (wide * BLOCK))  # 32 MB
        for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            x = np.zeros((batch.num_rows, wide * BLOCK))
            x[:, :p] = np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, p)
            r = np.repeat(batch.column(0).to_numpy(), wide)
            parts = [b.tobytes() for b in x.reshape(-1, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(r // BLOCK, pa.int32()), pa.array(np.tile(np.arange(wide), batch.num_rows), pa.int32()), pa.array(r % BLOCK, pa.int32()), pa.array(parts, pa.binary())], names=["i", "j", "r", "part"])

    def stack(part: pa.Table) -> pa.Table:
        out = np.zeros((BLOCK, BLOCK))
        out[part["r"].to_numpy()] = np.frombuffer(b"".join(part["part"].to_pylist())).reshape(-1, BLOCK)
        return pa.table([part["i"][:1], part["j"][:1], pa.array([out.tobytes()], pa.binary())], names=["i", "j", "block"])

    return rows.select("r", "x").mapInArrow(cut, "i int, j int, r int, part binary").groupBy("i", "j").applyInArrow(stack, SCHEMA)


def target_tiles(rows: DataFrame, means: DataFrame, n: int, centred: bool) -> DataFrame:
    """Tiles of the targets less their means, 0 where one is missing; not centred, the mean is added again everywhere."""
    cells = rows.select("r", F.explode(F.arrays_zip("t", "y")).alias("c")).select("r", "c.t", "c.y").join(means, "t")
    entries = cells.select(F.floor(F.col("r") / BLOCK).cast("int").alias("i"), F.floor(F.col("t") / WIDE).cast("int").alias("j"), (F.col("r") % BLOCK).alias("r"), (F.col("t") % WIDE).alias("t"), (F.col("y") - F.col("y_mean")).alias("v"))

    def dense(part: pa.Table) -> pa.Table:
        out = np.zeros((BLOCK, WIDE))
        np.add.at(out, (part["r"].to_numpy(), part["t"].to_numpy()), part["v"].to_numpy())
        return pa.table([part["i"][:1], part["j"][:1], pa.array([out.tobytes()], pa.binary())], names=["i", "j", "block"])

    def level(part: pa.Table) -> pa.Table:
        j, mean = part["j"][0].as_py(), np.zeros(WIDE)
        if not centred:
            mean[part["t"].to_numpy()] = part["y_mean"].to_numpy()
        places = np.arange(-(-n // BLOCK) * BLOCK).reshape(-1, BLOCK)
        return pa.Table.from_batches([_tile(list(range(len(places))), [j] * len(places), [(at < n)[:, None] * mean for at in places])])

    grid = means.select("y_mean", F.floor(F.col("t") / WIDE).cast("int").alias("j"), (F.col("t") % WIDE).alias("t"))  # every tile, also without a cell
    return added(entries.groupBy("i", "j").applyInArrow(dense, SCHEMA).union(grid.groupBy("j").applyInArrow(level, SCHEMA)))


def ridge(rows: DataFrame, p: int, alphas: list[float], penalty: DataFrame | None, intercept: bool, direct: int) -> DataFrame:
    """Ridge coefficients ``t, coefs, intercepts`` (one for each alpha) of rows ``x, t, y`` with p columns.

    With fewer rows than columns, and no further penalty, the system is that of the rows (dual): X'(XX' + alpha I)^-1 Y; else that of
    the columns. Either is as wide as the smaller side.
    """
    numbered_rows, n = numbered(rows.select("x", "t", "y"), "r", "wide-rows")
    high, wide = -(-n // BLOCK), -(-p // BLOCK)
    raw = stage(design_tiles(numbered_rows, p), "design-tiles")
    means = stage(numbered_rows.select(F.explode(F.arrays_zip("t", "y")).alias("c")).groupBy(F.col("c.t").alias("t")).agg(F.avg("c.y").alias("y_mean")), "target-means")
    mean = _column_means(raw, n, wide) if intercept else np.zeros(wide * BLOCK)
    shared = rows.sparkSession.sparkContext.broadcast(mean)  # one design row

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            inside = [(np.arange(a * BLOCK, (a + 1) * BLOCK) < n)[:, None] for a in i]
            yield _tile(i, j, [unpack(raw.as_py(), BLOCK) - at * shared.value[b * BLOCK : (b + 1) * BLOCK] for raw, at, b in zip(batch.column(2), inside, j)])

    x = stage(raw.mapInArrow(centre, SCHEMA), "centred-tiles") if intercept else raw
    y = stage(target_tiles(numbered_rows, means, n, intercept), "target-tiles")
    dual = n < p and penalty is None
    if dual:
        turned = x.select(F.col("j").alias("i"), F.col("i").alias("j"), "block")
        gram, right, side, size = _outer(x, turned, wide), y, high, n
    else:
        gram, right, side, size = product(x, x, high, turn=True), stage(product(x, y, high, turn=True), "right-sides"), wide, p
    if penalty is not None:
        gram = added(gram.union(from_entries(penalty)))
    gram = stage(gram, "gram-tiles")
    fits = []
    for k, alpha in enumerate(alphas):
        found = solved(_on_diagonal(gram, alpha, size), right, side, direct)
        if dual:
            found = product(x, found, high, turn=True)
        fits.append(_rows_of(found, mean, p).withColumn("k", F.lit(k)))
    every = reduce(DataFrame.union, fits).join(means, "t")
    packed = every.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", "coef", (F.col("y_mean") - F.col("shift")).alias("intercept")))).alias("e"))
    shift = F.col("e.intercept") if intercept else F.transform("e", lambda _: F.lit(0.0))
    return stage(packed.select("t", F.col("e.coef").alias("coefs"), shift.alias("intercepts")), "wide-coefficients")


def _column_means(raw: DataFrame, n: int, wide: int) -> np.ndarray:
    """As many numbers as a design row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [unpack(b.as_py(), BLOCK).sum(axis=0) for b in batch.column(2)]
            yield _tile([0] * batch.num_rows, batch.column(1).to_pylist(), [s[None, :] for s in sums])

    mean = np.zeros((wide, BLOCK))
    for row in added(raw.mapInArrow(run, SCHEMA)).collect():
        mean[row["j"]] = np.frombuffer(row["block"]) / max(1, n)
    return mean.ravel()


def _outer(x: DataFrame, turned: DataFrame, steps: int) -> DataFrame:
    """x x' by tiles; the right factor's tiles are turned where they are multiplied."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _tile(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [unpack(b.as_py(), BLOCK).T for b in batch.column(2)])

    return product(x, turned.mapInArrow(turn, SCHEMA), steps)


def _on_diagonal(gram: DataFrame, alpha: float, size: int) -> DataFrame:
    """gram + alpha I, and 1 on the diagonal past the matrix's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for a, b, raw in zip(i, j, batch.column(2)):
                block = unpack(raw.as_py(), BLOCK).copy()
                if a == b:
                    block += np.diag(np.where(np.arange(a * BLOCK, (a + 1) * BLOCK) < size, alpha, 1.0))
                out.append(block)
            yield _tile(i, j, out)

    return gram.mapInArrow(run, SCHEMA)


def _rows_of(coefs: DataFrame, mean: np.ndarray, p: int) -> DataFrame:
    """(t, coef, shift) from tiles (column block, target tile): a row for each target, and its product with the column means."""

    def run(part: pa.Table) -> pa.Table:
        out = np.zeros((len(mean), WIDE))
        for i, raw in zip(part["i"].to_pylist(), part["block"]):
            out[i * BLOCK : (i + 1) * BLOCK] = unpack(raw.as_py(), BLOCK)
        offsets = pa.array(np.arange(WIDE + 1, dtype=np.int32) * p)
        t = part["j"][0].as_py() * WIDE + np.arange(WIDE)
        return pa.table([pa.array(t, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(out[:p].T.ravel())), pa.array(mean @ out)], names=["t", "coef", "shift"])

    return coefs.groupBy("j").applyInArrow(run, "t int, coef array<double>, shift double")
