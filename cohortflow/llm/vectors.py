"""What the two vector searches share: valid vectors, top-k selection and the merge of partial answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest vector length (the smaller at a tie), 0 without vectors. Other lengths take no part in a search."""
    sizes = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count()
    top = sizes.orderBy(F.desc("count"), "n").first()  # one row for each length
    return top["n"] if top else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values (double) of the vectors of length ``dim`` with finite components only."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def packed(values: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    raw = np.ascontiguousarray(values)
    width = raw.shape[1] * raw.itemsize
    offsets = pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets, pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """A matrix of the bytes of each row."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to the smaller id, ordered by query and rank."""
    order = np.lexsort((ids, -score, query))
    sorted_query = query[order]
    starts = np.flatnonzero(np.r_[True, sorted_query[1:] != sorted_query[:-1]]) if len(order) else np.array([], int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def merged(parts: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of partial answers (query_id, query_no, vec_id, score).

    The rank limit is also applied before the shuffle, so a query brings at most k rows from each task.
    """
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks(column: str, n: int):
    """Number of the block, of n, that a row falls into."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def rows_of(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the valid rows with an id, batch by batch, from batches of (id, vector)."""
    for batch in batches:
        rows, values = matrix(batch.column(1), dim)
        ids = batch.column(0).take(pa.array(rows))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        yield ids.filter(pa.array(known)), values[known]
