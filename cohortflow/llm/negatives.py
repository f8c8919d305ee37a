"""Hard negatives of anchors: packed pair keys, a secondary sort, and one pass that opens windows at positives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm import vectors
from cohortflow.session import stage

#: Rows of a cell and anchors of a block on average; anchors scored at a time.
ROWS, ANCHORS, STRIP = 1 << 15, 1 << 12, 64
SIGN = np.uint64(1 << 63)
PAIR = "anchor_id bigint, anchor_no bigint, key binary"


def scaled(df: DataFrame, factor: int, dim: int) -> DataFrame:
    """(vec_id, label, vec): vectors as floor(factor * x) in packed whole numbers; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = vectors.matrix(batch.column(2), dim)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), vectors.packed(np.floor(factor * x).astype("<i8"))], names=["vec_id", "label", "vec"])

    return df.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "vec_id bigint, label bigint, vec binary")


def pack(score: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """17 bytes whose order is that of falling score, positives before negatives, rising id."""
    out = np.empty((len(ids), 17), np.uint8)
    out[:, :8] = (~(score.astype(np.int64).view(np.uint64) ^ SIGN)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = negative
    out[:, 9:] = (ids.astype(np.int64).view(np.uint64) ^ SIGN).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def unpack(keys: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 17)
    score = (~np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64) ^ SIGN).view(np.int64)
    ids = (np.ascontiguousarray(raw[:, 9:]).view(">u8").ravel().astype(np.uint64) ^ SIGN).view(np.int64)
    return score.tolist(), raw[:, 8].tolist(), ids.tolist()


def _number(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Tells anchors of the same id apart."""
    odd = np.arange(1, 2 * x.shape[1] + 2, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x.view(np.uint64) * odd[:-1]).sum(axis=1) + label.astype(np.int64).view(np.uint64) * odd[-1]).view(np.int64)


class Cell:
    """The rows of one cell by rising id, so that of equal scores the first is the smallest id."""

    def __init__(self, rows: pa.Table):
        ids = rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], rows["label"].to_numpy()[order]
        x = vectors.unpacked(rows["vec"], "<i8")[order]
        self.most = float(np.abs(x).max(initial=0)) * x.shape[1]
        self.x, self.xt = x, np.ascontiguousarray(x.T.astype(np.float64))

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Whole inner products; doubles hold sums below 2^53 exactly."""
        if self.most * float(np.abs(q).max(initial=0)) < 2**53:
            return (q.astype(np.float64) @ self.xt).astype(np.int64)
        return q @ self.x.T


def _highest(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of every row (all, if fewer), the first column first at a tie."""
    least = np.iinfo(np.int64).min
    left, rows, columns = np.where(allowed, scores, least), [], []
    every = np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        best = left.argmax(axis=1)
        some = allowed[every, best] & (left[every, best] > least)
        if not some.any():
            break
        rows.append(every[some])
        columns.append(best[some])
        left[every, best] = least
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _emit(anchors: pa.Table, at: np.ndarray, score: np.ndarray, negative: bool, ids: np.ndarray) -> pa.Table:
    take = pa.array(at)
    return pa.table([anchors["anchor_id"].take(take), anchors["anchor_no"].take(take), vectors.packed(pack(score, np.full(len(ids), negative), ids))], names=["anchor_id", "anchor_no", "key"])


def _none() -> pa.Table:
    return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["anchor_id", "anchor_no", "key"])


def _strips(anchors: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for at in range(0, anchors.num_rows, STRIP):
        strip = anchors.slice(at, STRIP).combine_chunks()
        yield strip, vectors.unpacked(strip["vec"], "<i8")


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The k best rows of a cell with the anchor's label."""
    out = []
    if rows.num_rows and anchors.num_rows:
        cell = Cell(rows)
        for strip, q in _strips(anchors):
            scores = cell.scores(q)
            own, label = strip["anchor_id"].to_numpy()[:, None], strip["label"].to_numpy()[:, None]
            at, found = _highest(scores, (cell.labels == label) & (cell.ids != own), k)
            out.append(_emit(strip, at, scores[at, found], False, cell.ids[found]))
    return pa.concat_tables(out) if out else _none()


def _negatives(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each window of an anchor, the k best rows of a cell with another label in it; a row in two windows comes once."""
    out = []
    if rows.num_rows and anchors.num_rows:
        cell = Cell(rows)
        for strip, q in _strips(anchors):
            scores, label = cell.scores(q), strip["label"].to_numpy()[:, None]
            other = cell.labels != label
            windows = strip["windows"].to_pylist()
            pairs = []
            for i in range(max(map(len, windows))):
                tops = np.array([w[i] if i < len(w) else -1 for w in windows], np.int64)[:, None]  # no score lies between -50 and -95
                pairs.append(_highest(scores, other & (100 * scores >= low * tops) & (100 * scores <= high * tops), k))
            both = np.unique(np.concatenate([at * len(cell.ids) + found for at, found in pairs]))
            at, found = both // len(cell.ids), both % len(cell.ids)
            out.append(_emit(strip, at, scores[at, found], True, cell.ids[found]))
    return pa.concat_tables(out) if out else _none()


def mine(df: DataFrame, anchors: Column, label: Column, factor: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row where ``anchors`` (a test of vec_id) holds.

    A score is the inner product of floor(factor * x) vectors. An anchor's positives are its ``positives`` best rows
    with its label; a positive's window holds the rows with another label whose score is ``low`` to ``high`` hundredths
    of the positive's, and its ``negatives`` best are returned. Higher scores come first, ties by smaller id.

    Rows are dealt to cells by label and, where a label has many rows, by position, so a label with a third of all rows
    is many cells. An anchor visits the cells of its label first, which gives its positives and with them its
    windows, and then all cells. Only the best of a cell in each window leave it, which keeps every
    row that can be among the best of all. Pairs travel as packed keys, are dealt by anchor and sorted within
    partitions; a pass over them opens a window at each positive and returns negatives as they come,
    so a task holds the open windows of one anchor and nothing else of it.

    Rows without id or label, and vectors that are null, of another length than most, or
    hold null or non-finite components take no part. A row never meets a row of its own id; otherwise repeated rows
    count as often as they occur, and so do anchors with different vectors or labels. Scores have to stay
    below 2^63 / 100 after scaling.
    """
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    dim = vectors.dimension(rows, "vec")
    if not dim:
        return df.sparkSession.createDataFrame([], schema)
    whole = stage(scaled(rows, factor, dim).withColumn("row", F.monotonically_increasing_id()), "vectors")  # written once, so the number holds
    n = whole.count()
    groups = max(1, -(-n // ROWS))
    group = F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int")
    sizes = whole.groupBy(group.alias("group")).agg(F.count("*").alias("n")).select("group", F.ceil(F.col("n") / ROWS).cast("int").alias("chunks"))
    sizes = stage(sizes, "cells")  # one row for about ROWS rows
    celled = stage(whole.withColumn("group", group).join(sizes, "group").select("group", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "label", "vec"), "celled")
    cells = sizes.select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asked = stage(_anchors(whole.where(anchors)), "anchors")
    blocks = max(1, -(-asked.count() // ANCHORS))
    block = F.pmod(F.xxhash64("anchor_id", "anchor_no"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = celled.withColumn("block", every)
    keys = ["group", "chunk", "block"]
    mine_ = asked.withColumn("group", group).withColumn("block", block).join(cells, "group")
    first = left.groupBy(keys).cogroup(mine_.groupBy(keys)).applyInArrow(lambda a, b: _positives(a, b, positives), PAIR)
    best = stage(_first(first, positives), "positives")
    tops = best.groupBy("anchor_id", "anchor_no").agg(F.sort_array(F.collect_set("score"), False).alias("windows"))  # as many as positives
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    open_ = asked.join(tops, ["anchor_id", "anchor_no"]).withColumn("block", block).withColumn("group", everywhere).join(cells, "group")
    second = left.groupBy(keys).cogroup(open_.groupBy(keys)).applyInArrow(lambda a, b: _negatives(a, b, negatives, low, high), PAIR)
    pairs = best.select("anchor_id", "anchor_no", "key").union(second)
    dealt = pairs.repartition("anchor_id", "anchor_no").sortWithinPartitions("anchor_id", "anchor_no", "key")
    return dealt.mapInArrow(lambda batches: _windows(batches, negatives, low, high), schema)


def _anchors(rows: DataFrame) -> DataFrame:
    """(anchor_id, anchor_no, label, vec) of the distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = _number(vectors.unpacked(batch.column(2), "<i8"), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), batch.column(1), batch.column(2)], names=["anchor_id", "anchor_no", "label", "vec"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, "anchor_id bigint, anchor_no bigint, label bigint, vec binary").distinct()


def _first(pairs: DataFrame, k: int) -> DataFrame:
    """The first k pairs of each anchor by key, with their scores. The limit also holds before the shuffle."""
    order = Window.partitionBy("anchor_id", "anchor_no").orderBy("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score, _, _ = unpack(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.int64())], names=["anchor_id", "anchor_no", "key", "score"])

    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    return ranked.mapInArrow(run, f"{PAIR}, score bigint")


def _windows(batches: Iterator[pa.RecordBatch], most: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Streams the sorted pairs of one anchor after another; a window is a positive with the negatives returned so far."""
    names, anchor, windows = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], None, []
    for batch in batches:
        out: list[tuple] = []
        if batch.num_rows:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *unpack(batch.column(2).to_pylist()))
            for anchor_id, number, score, negative, other in rows:
                if (anchor_id, number) != anchor:
                    anchor, windows = (anchor_id, number), []
                if not negative:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    if window[2] < most and low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((anchor_id, window[0], window[2], other, window[1], score))
        values = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "rank" else pa.int64()) for n, v in zip(names, values)], names=names)
