"""Packing of documents into token sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import bpe
from cohortflow.llm.slices import slices
from cohortflow.session import stage

#: Hash buckets of token ids, dimensions of the projection, and bits of a coordinate.
HASHED, DIMS, DEPTH = 8_192, 4, 12
#: Pieces returned at a time.
OUT = 4_096


def projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(HASHED, DIMS)).astype(np.float32)


def cell(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Grid coordinates of a document: its hashed token counts, scaled to length one and projected.

    Coordinates are about normal for unrelated documents; the normal distribution function spreads them over the grid.
    """
    if not len(ids):
        return np.zeros(DIMS, np.int64)
    counts = np.bincount((ids.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(8)).astype(np.int64) % HASHED, minlength=HASHED).astype(np.float32)
    point = counts @ matrix / np.linalg.norm(counts)
    return np.minimum((1 / (1 + np.exp(-1.702 * point)) * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1)


def hilbert(point: np.ndarray) -> int:
    """Position along the Hilbert curve through the grid of DEPTH bits a side.

    From the top bit down, each axis with the bit set flips the lower bits of the first axis, and each
    without it swaps them with the first axis; a Gray decoding over the axes follows.
    """
    x, top = [int(v) for v in point], 1 << (DEPTH - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(DIMS):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    flips, bit = 0, top
    while bit > 1:
        if x[-1] & bit:
            flips ^= bit - 1
        bit >>= 1
    key = 0
    for level in range(DEPTH - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ flips) >> level & 1)
    return key


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is encoded once, gets the end id, and goes to the range of its key on the curve (ties
    by a hash of the row, so equal documents spread over ranges). A range is then laid out in curve
    order, filling one sequence after another; what is left in its last one is cut into sequences of
    powers of two. A sequence is padded to the capacity unless its length is a power of two, so none
    needs padding. ``capacity`` must be a power of two. Rows are packed as often as they occur; a null
    text is an empty one and gives the end id alone; other columns are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, matrix = bpe.library(path), projection(seed)

        def tokens(value: str) -> np.ndarray:
            try:
                return np.array(library.encode(value, allowed_special="all"), "<u4")
            except ValueError:  # its pattern engine gives up on very long runs of white space
                return bpe.encoder(path).encode(value)

        for batch in slices(batches):
            keys, packed = [], []
            for x in batch.column(1):
                ids = tokens(x.as_py() or "")
                keys.append(hilbert(cell(ids, matrix)))
                packed.append(_narrow(np.append(ids, end_id)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(packed, pa.binary())], names=["key", "doc_id", "ids"])

    encoded = stage(rows.mapInArrow(encode, f"key bigint, doc_id {kind}, ids binary"), "encoded")
    ordered = encoded.withColumn("tie", F.xxhash64("doc_id", "ids")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    numbered = ordered.select(F.spark_partition_id().cast("bigint").alias("part"), "doc_id", "ids")
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return numbered.mapInArrow(lambda batches: _lay_out(batches, capacity), schema)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as bytes behind their width: two bytes an id where all fit, else four."""
    wide = int(ids.max()) >= 1 << 16
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def _widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1).astype("<u4")


def _lay_out(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of one range. A sequence is held back until it is full; only its ids' pieces are kept, at most ``capacity``."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out: list[tuple] = []
    open_: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence being filled
    room, number, kind = capacity, 0, None

    def close(parts: list[tuple]) -> None:
        nonlocal number
        offset = 0
        for name, start, ids, total in parts:
            out.append((name, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset))
            offset += len(ids)
        number += 1

    def flush() -> pa.RecordBatch:
        columns = [pa.array([row[0] for row in out], kind), *(pa.array([row[i] for row in out], pa.int64()) for i in range(1, 7))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        kind = batch.schema[1].type
        if number == 0 and batch.num_rows:
            number = batch.column(0)[0].as_py() << 40
        for name, raw in zip(batch.column(1), batch.column(2)):
            name, ids, at = name.as_py(), _widen(raw.as_py()), 0
            while at < len(ids):
                piece = ids[at : at + room]
                open_.append((name, at, piece, len(ids)))
                at, room = at + len(piece), room - len(piece)
                if not room:
                    close(open_)
                    open_, room = [], capacity
            if len(out) >= OUT:
                yield flush()
    left = capacity - room
    while left:
        size = 1 << (left.bit_length() - 1)
        taken, need = [], size
        while need:
            name, at, ids, total = open_.pop(0)
            if len(ids) > need:
                open_.insert(0, (name, at + need, ids[need:], total))
                ids = ids[:need]
            taken.append((name, at, ids, total))
            need -= len(ids)
        close(taken)
        left -= size
    if out:
        yield flush()
