"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.components import components
from cohortflow.session import stage

BITS = 64
SEED = 42
#: Shingles hashed at a time, which bounds the memory of a very long text.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text (A-Z lower-cased, repeats counted)."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and x20, x09-x0D as white space
    if not words:
        return 0
    grams = iter([b" ".join(words)]) if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    ones, total = np.zeros(BITS, np.int64), 0
    while block := [xxhash.xxh64_intdigest(g, SEED) for g in islice(grams, BLOCK)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row. A null or wordless text has fingerprint zero."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 bit masks; any two codes within the radius agree on all bits of some mask.

    Bit i has a nonzero vector phi(i) of radius + 1 bits, and the mask of a nonzero vector v holds the
    bits whose phi is not orthogonal to v. The phi of up to ``radius`` differing bits span less than
    the whole space, so some v is orthogonal to them all, and its mask holds none of these bits.
    """
    vectors = range(1, 1 << (radius + 1))
    phi = [1 + i % len(vectors) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in vectors]


def near_links(prints: DataFrame, fp: str = "fp", radius: int = 2) -> DataFrame:
    """Links (src, dst) that join all distinct codes within ``radius`` (1 or 2) bits of each other.

    Codes meet in the covering tables. Those that share a bucket with another code differ there only
    in bits outside the mask, so each lists the codes at most one such bit away: two codes are within
    two bits just if they list a common one. At most 65 codes lie within one bit of any code, so these
    last groups are small whatever the data, and no bucket is ever expanded to pairs.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    codes = prints.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)])
    rows = codes.select("fp", F.explode(tables).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    met = rows.join(full, ["t", "key"], "left_semi").select("fp", "t")
    steps = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    near = met.select("fp", F.explode(F.element_at(steps, F.col("t") + 1)).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("via"))
    stars = near.groupBy("via").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_sort("fps").alias("fps"))
    return stars.select(F.col("fps")[0].alias("src"), F.explode(F.slice("fps", 2, BITS + 1)).alias("dst")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id whose row can be reached over fingerprints at most ``radius``
    bits apart. Rows without an id are kept, take part in links and get the smallest id reached (null
    if there is none); repeated rows are returned as often as they occur; other columns are ignored.
    """
    prints = stage(fingerprints(docs, doc_id, text, shingle), "prints")
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    roots = components(near_links(first, "fp", radius)).select(F.col("node").alias("fp"), "root")
    members = stage(roots.join(first, "fp"), "members")
    heads = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = members.join(heads, "root").select("fp", "component_id")
    classes = first.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(stage(classes, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word
