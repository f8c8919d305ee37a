"""Encoding, decoding and token counts of whole texts with a tokenizer file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import bpe

#: Number type of ids in binary columns: little-endian unsigned 32 bit.
ID = "<u4"


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids as bytes, four to an id. A null text is an empty one; other columns are ignored."""
    rows, kind = _rows(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            ids = pa.array((coder.encode(x.as_py() or "").tobytes() for x in batch.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids), special ids written out. Null ids give the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            texts = pa.array((coder.decode(np.frombuffer(x.as_py() or b"", ID)).decode() for x in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids in decimal and of their decoded text.

    Encodes and decodes in one pass, so that neither ids nor texts leave the task.
    """
    rows, kind = _rows(docs, doc_id, text)

    def digests(coder: bpe.Encoder, value: str) -> tuple[int, str, str]:
        ids = coder.encode(value)
        return len(ids), hashlib.sha256(coder.decimal.join(ids)[:-1]).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            made = [digests(coder, x.as_py() or "") for x in batch.column(1)]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def prefix_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts): entry k + 1 of the array is the token count of the first k characters, k from 0 to the whole text.

    Any budget question is then a look at the array; see ``within_budget``. Byte-level vocabularies only.
    """
    rows, kind = _rows(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1)):  # a row at a time: the arrays are as long as the texts
                counts = coder.prefix_counts(x.as_py() or "").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], batch.schema[0].type), pa.ListArray.from_arrays([0, len(counts)], pa.array(counts))], names=["doc_id", "counts"])

    return rows.mapInArrow(run, f"doc_id {kind}, counts array<int>")


def within_budget(counted: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_chars, n_tokens): the longest prefix of at most ``budget`` tokens, from stored prefix counts alone.

    A longer prefix can have fewer tokens than a shorter one, so the last count within the budget decides.
    """
    last = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i)))
    return counted.select("doc_id", last.alias("n_chars"), F.get("counts", last).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, from the last prefix count of every word. A null text is an empty one."""
    rows, kind = _rows(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            counts = pa.array((coder.count(x.as_py() or "") for x in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    sized = rows.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = sized.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()
