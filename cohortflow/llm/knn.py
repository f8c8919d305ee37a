"""Exact top-k inner products of integer vectors by a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import vectors
from cohortflow.session import stage

#: Most pivots (half the square root of the rows are taken), rows and queries of one task, queries scored at a time.
PIVOTS, ROWS, QUERIES, STRIP = 2_048, 16_384, 2_048, 128
#: Relative slack of the bounds against rounding.
SLACK = 1e-9


def search(df: DataFrame, queries: Column, k: int = 10, factor: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(factor * x) vectors, exactly.

    Every row joins the cell of its nearest pivot. A cell's summary is its row count, radius and
    largest norm; the pivots are rows themselves. For a query they bound the k-th best score from below
    (the k-th best pivot, or the cells that hold k rows) and any score in a cell from above (through
    the pivot and the radius, or the largest norm). A query goes just to the cells whose upper bound
    reaches its lower bound, large cells are cut into chunks by row, and each chunk that a query visits is solved
    alone; rows of cells that no query visits are not sent anywhere.

    ``queries`` tests vec_id; a query's candidates are all rows with another id, ties go to the smaller
    id, and repeated rows count as often as they occur. Rows without an id and vectors that are null, of
    another length than most, or hold null or non-finite components take no part. Components have to
    stay below 2^53 and scores below 2^63 after scaling.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    dim = vectors.dimension(rows, "vec")
    out_schema = "query_id bigint, query_no bigint, vec_id bigint, score bigint"
    if not dim:
        return vectors.merged(spark.createDataFrame([], out_schema), k)
    whole = stage(_scaled(rows, dim, factor), "vectors")
    n = whole.count()
    wanted = min(PIVOTS, int(np.ceil(np.sqrt(n) / 2)))
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()  # at most PIVOTS rows
    if not sample:
        return vectors.merged(spark.createDataFrame([], out_schema), k)
    pivots = np.unique(np.array([np.frombuffer(r["vec"], "<i8") for r in sample]), axis=0).astype(np.float64)
    pivot_ids = np.array([r["vec_id"] for r in sample])
    pivot_rows = np.array([np.frombuffer(r["vec"], "<i8") for r in sample]).astype(np.float64)
    celled = stage(_assign(whole, pivots).withColumn("row", F.monotonically_increasing_id()), "cells")  # written once, so the number holds
    summary = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect()  # one row a cell
    count, radius, norm = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for s in summary:
        count[s["cell"]], radius[s["cell"]], norm[s["cell"]] = s["n"], s["radius"], s["norm"]
    mine = whole.where(queries).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))
    asked = stage(mine.distinct().join(mine.groupBy("query_id").agg(F.count("*").alias("own")), "query_id"), "asked")
    query_blocks = max(1, -(-asked.count() // QUERIES))
    chunks = np.maximum(1, -(-count // ROWS))
    known = spark.sparkContext.broadcast((pivots, pivot_ids, pivot_rows, count, radius, norm, chunks))  # PIVOTS rows at most
    right = asked.mapInArrow(lambda batches: _route(batches, known.value, k), "cell int, chunk int, query_id bigint, query binary, least double")
    right = stage(right.withColumn("block", vectors.blocks("query_id", query_blocks)), "routed")
    chunk_of = F.element_at(F.lit(chunks.tolist()).cast("array<int>"), F.col("cell") + 1)
    chunked = celled.select("cell", F.pmod(F.xxhash64("row"), chunk_of).cast("int").alias("chunk"), "vec_id", "vec")
    left = chunked.join(right.select("cell", "chunk", F.col("block").alias("_block")).distinct(), ["cell", "chunk"]).withColumnRenamed("_block", "block")  # a row goes to the blocks of queries that visit its chunk
    keys = ["cell", "chunk", "block"]
    parts = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(lambda a, b: _solve(a, b, k), out_schema)
    return vectors.merged(parts, k)


def _scaled(rows: DataFrame, dim: int, factor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in vectors.rows_of(batches, dim):
            yield pa.RecordBatch.from_arrays([ids, vectors.packed(np.floor(factor * x).astype("<i8"))], names=["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id bigint, vec binary")


def _assign(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, vec_id, vec, far, norm): nearest pivot, the distance to it, and the vector's norm."""
    shared = whole.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        half = (p * p).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.unpacked(batch.column(1), "<i8").astype(np.float64)
            cell = np.argmin(half - x @ p.T, axis=1).astype(np.int32)
            far, norm = np.linalg.norm(x - p[cell], axis=1), np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), pa.array(far), pa.array(norm)], names=["cell", "vec_id", "vec", "far", "norm"])

    return whole.mapInArrow(run, "cell int, vec_id bigint, vec binary, far double, norm double")


def _route(batches: Iterator[pa.RecordBatch], known: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """The cells and chunks that a query has to visit, with the score it has to reach."""
    pivots, pivot_ids, pivot_rows, count, radius, norm, chunks = known
    for batch in batches:
        if not batch.num_rows:
            continue
        q, ids = vectors.unpacked(batch.column(1), "<i8").astype(np.float64), batch.column(0).to_numpy()
        own = batch.column(2).to_numpy()
        size = np.linalg.norm(q, axis=1)
        middle, reach = q @ pivots.T, size[:, None] * radius
        slack = SLACK * (size[:, None] * norm + 1)
        upper = np.minimum(middle + reach, size[:, None] * norm) + slack
        lower = middle - reach - slack
        least = np.full(len(q), -np.inf)
        order = np.argsort(-lower, axis=1)
        held = np.cumsum(np.where(count[order] > 0, count[order], 0), axis=1)
        enough = held >= k + own[:, None]  # all rows of the query's id may be among them
        at = enough.argmax(axis=1)
        some = enough.any(axis=1)
        least[some] = np.take_along_axis(lower, order, axis=1)[np.arange(len(q)), at][some]
        if len(pivot_ids) > k:
            direct = np.where(ids[:, None] == pivot_ids, -np.inf, q @ pivot_rows.T)
            least = np.maximum(least, np.partition(direct, -k, axis=1)[:, -k] - slack.max(axis=1))
        qi, cell = np.nonzero((upper >= least[:, None]) & (count > 0))
        times = chunks[cell]
        qi, cell = np.repeat(qi, times), np.repeat(cell, times)
        chunk = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
        columns = [pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(ids[qi]), batch.column(1).take(pa.array(qi)), pa.array(least[qi])]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "chunk", "query_id", "query", "least"])


def _solve(rows: pa.Table, wanted: pa.Table, k: int) -> pa.Table:
    names, out = ["query_id", "query_no", "vec_id", "score"], []
    if rows.num_rows and wanted.num_rows:
        ids, x = rows["vec_id"].to_numpy(), vectors.unpacked(rows["vec"], "<i8")
        query_ids, q, least = wanted["query_id"].to_numpy(), vectors.unpacked(wanted["query"], "<i8"), wanted["least"].to_numpy()
        exact = np.abs(x).max(initial=0) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**53
        xt = np.ascontiguousarray((x.astype(np.float64) if exact else x).T)  # doubles hold sums below 2^53 exactly
        for at in range(0, len(q), STRIP):
            strip, own = q[at : at + STRIP], query_ids[at : at + STRIP]
            scores = strip.astype(xt.dtype) @ xt
            qi, xi = np.nonzero((scores >= least[at : at + STRIP, None]) & (own[:, None] != ids))
            score = scores[qi, xi].astype(np.int64)
            best = vectors.top(qi, ids[xi], score, k)
            number = (strip * np.arange(1, strip.shape[1] + 1)).sum(axis=1) + 31 * (strip * strip).sum(axis=1)
            out.append(pa.table([own[qi[best]], number[qi[best]], ids[xi[best]], score[best]], names=names))
    return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 4, names=names)
