"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import vectors
from cohortflow.session import stage

#: Rows and queries of one task, and queries estimated at a time.
ROWS, QUERIES, STRIP = 16_384, 2_048, 64
#: Half-width of the error bound in standard deviations of the estimate.
WIDTH = 3.0
#: Candidate pairs reranked at a time.
PAIRS = 1 << 18
#: Best estimates, as a multiple of k, that are computed exactly to set a query's threshold.
FIRST = 8


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix of the next multiple of 8 rows (padding is zero), the same on every machine."""
    wide = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, wide)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(vec_id, code, norm, align, vec) of every valid row.

    The code holds the signs of the rotated direction, ``align`` the cosine between that direction and
    its code, and ``vec`` the original vector as doubles. Rows without an id, and vectors that are
    null, zero, of another length than most, or hold null or non-finite components take no part.
    """
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    dim = vectors.dimension(rows, "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for ids, x in vectors.rows_of(batches, dim):
            norm = np.sqrt((x * x).sum(axis=1))
            some = (norm > 0) & np.isfinite(norm)
            x, norm, ids = x[some], norm[some], ids.filter(pa.array(some))
            y = (x / norm[:, None]) @ turn.T
            align = np.abs(y).sum(axis=1) / np.sqrt(len(turn))
            codes = np.packbits(y > 0, axis=1)
            yield pa.RecordBatch.from_arrays([ids, vectors.packed(codes), pa.array(norm), pa.array(align), vectors.packed(x)], names=["vec_id", "code", "norm", "align", "vec"])

    schema = "vec_id bigint, code binary, norm double, align double, vec binary"
    return rows.mapInArrow(run, schema) if dim else df.sparkSession.createDataFrame([], schema)


def search(indexed: DataFrame, queries: Column, k: int = 20, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for the index rows where ``queries`` holds.

    Rows and queries meet in blocks of bounded size. In a block the packed bits and the two scalars
    give every inner product with its error bound; the best estimates are computed exactly, and so is
    every row whose upper bound reaches the k-th of these. Scores are sums of double products in
    component order. A query's candidates are all rows with another id; a query with fewer than k has
    them all. Repeated rows are candidates, and queries, as often as they occur with different vectors.
    """
    asked = indexed.where(queries).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).distinct()
    n, m = indexed.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    by = "row" if "row" in indexed.columns else "vec_id"  # numbered rows part rows of one id
    left = indexed.withColumn("a", vectors.blocks(by, row_blocks)).drop("row").withColumn("b", every(query_blocks))
    right = asked.withColumn("b", vectors.blocks("query_id", query_blocks)).withColumn("a", every(row_blocks))

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        return _block(rows, wanted, k, seed)

    parts = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "query_id bigint, query_no bigint, vec_id bigint, score double")
    return vectors.merged(parts, k)


def _block(rows: pa.Table, wanted: pa.Table, k: int, seed: int) -> pa.Table:
    names, out = ["query_id", "query_no", "vec_id", "score"], []
    if rows.num_rows and wanted.num_rows:
        ids, codes = rows["vec_id"].to_numpy(), vectors.unpacked(rows["code"], "u1")
        norm, align = rows["norm"].to_numpy(), rows["align"].to_numpy()
        x, q = vectors.unpacked(rows["vec"], "<f8"), vectors.unpacked(wanted["query"], "<f8")
        query_ids = wanted["query_id"].to_numpy()
        turn, bits = rotation(x.shape[1], seed), codes.shape[1] * 8
        spread = WIDTH * np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(max(1, bits - 1))
        scale = (norm / (align * np.sqrt(bits))).astype(np.float32)
        signs = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), 1.0, -1.0)
        by_part, xt = np.ascontiguousarray(codes.T), np.ascontiguousarray(x.T)
        keep = min(FIRST * k + 1, len(ids))
        for at in range(0, len(q), STRIP):
            strip, own = q[at : at + STRIP], query_ids[at : at + STRIP]
            size = np.sqrt((strip * strip).sum(axis=1))
            tables = ((strip @ turn.T).reshape(len(strip), -1, 8) @ signs.T).astype(np.float32)  # query x byte x value
            found = np.zeros((len(strip), len(ids)), np.float32)
            for part, values in enumerate(by_part):
                found += tables[:, part, :][:, values]
            found *= scale
            found[own[:, None] == ids] = -np.inf
            best = np.argpartition(found, len(ids) - keep, axis=1)[:, len(ids) - keep :]
            qi, xi = np.repeat(np.arange(len(strip)), keep), best.ravel()
            first = np.where(own[qi] == ids[xi], -np.inf, _products(strip.T, xt, qi, xi)).reshape(best.shape)
            least = -np.sort(-first, axis=1)[:, min(k, keep) - 1]
            upper = found + (size[:, None] * (norm * spread)).astype(np.float32)
            qi, xi = np.nonzero((upper >= least[:, None] * (1 - 1e-6 * np.sign(least[:, None]))) & (found > -np.inf))
            score = _products(strip.T, xt, qi, xi)
            high = score >= least[qi]  # only these can be among the k best
            qi, xi, score = qi[high], xi[high], score[high]
            best = vectors.top(qi, ids[xi], score, k)
            qi, xi = qi[best], xi[best]
            number = np.array([hash_of(v) for v in strip])
            out.append(pa.table([own[qi], number[qi], ids[xi], score[best]], names=names))
    empty = pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
    return pa.concat_tables(out) if out else empty


def hash_of(vector: np.ndarray) -> int:
    """Tells queries of the same id and different vectors apart."""
    return int(np.frombuffer(vector.tobytes(), "<u8").astype(np.uint64).dot(np.arange(1, len(vector) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1))


def _products(qt: np.ndarray, xt: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in component order, so equal vectors have equal scores."""
    out = np.empty(len(qi))
    for at in range(0, len(qi), PAIRS):
        a, b = qi[at : at + PAIRS], xi[at : at + PAIRS]
        total = np.zeros(len(a))
        for left, right in zip(qt, xt):
            total += left[a] * right[b]
        out[at : at + PAIRS] = total
    return out


def neighbours(df: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """The k nearest rows found for the rows where ``queries`` (a test of vec_id) holds; see ``index`` and ``search``."""
    numbered = index(df, vec_id, vector, seed).withColumn("row", F.monotonically_increasing_id())
    return search(stage(numbered, "codes"), queries, k, seed)  # written once, so the numbers hold
