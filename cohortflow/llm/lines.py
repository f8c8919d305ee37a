"""Lines repeated across documents, dropped by probing sharded minimal perfect hash tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.mphf import Hash
from cohortflow.session import stage

SPACE = b" \t\n\v\f\r"
#: Repeated keys, and probes, of a shard on average.
KEYS, PROBES = 1 << 16, 1 << 18
#: A key that more than one in HOT of all probes ask for is answered in place; so there are fewer than HOT of these.
HOT = 4096
#: Stands for a missing id: after every other document.
LAST = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _halves(key: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(key)
    return whole & 0xFFFFFFFFFFFFFFFF, whole >> 64


def _long_keys(text: bytes | None, least: int) -> set[bytes]:
    """The distinct keys of a text that have ``least`` code points or more."""
    found = set(map(line_key, (text or b"").split(b"\n")))
    return {k for k in found if len(k) >= least and (k.isascii() or len(k.decode()) >= least)}


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, part, text): the id, a digest that tells texts of one id apart, and the text's bytes."""
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text)).alias("part"), F.col(text).cast("binary").alias("text"))


def _hashes(rows: DataFrame, least: int, hot: frozenset = frozenset()) -> DataFrame:
    """(low, high, doc, part) of the distinct long keys of every row, those in ``hot`` left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [[h for h in map(_halves, _long_keys(x.as_py(), least)) if h not in hot] for x in piece.column(2)]
                sizes = np.array([len(f) for f in found])
                halves = np.array([h for f in found for h in f], np.uint64).reshape(-1, 2).view(np.int64)
                back = pa.array(np.repeat(np.arange(len(found)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), piece.column(0).take(back), piece.column(1).take(back)], names=["low", "high", "doc", "part"])

    return rows.mapInArrow(run, "low bigint, high bigint, doc bigint, part bigint")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("high"), F.lit(shards)).cast("int")


def shard_tables(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, fingerprints, counts, keepers): the minimal perfect hash of a shard's keys and its three arrays.

    Entry i is the key with number i: 64 bits of it, the documents that hold it (255 at most), and the
    smallest of them.
    """

    def run(table: pa.Table) -> pa.Table:
        low, high = (table[c].to_numpy().view(np.uint64) for c in ("low", "high"))
        index = Hash.build(low, high)
        order = np.argsort(index.numbers(low, high))
        arrays = [low[order].tobytes(), np.minimum(table["n"].to_numpy()[order], 255).astype(np.uint8).tobytes(), table["keeper"].to_numpy()[order].tobytes()]
        return pa.table([table["shard"][:1], *[pa.array([a], pa.binary()) for a in [index.to_bytes(), *arrays]]], names=["shard", "hash", "fingerprints", "counts", "keepers"])

    return repeated.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(run, "shard int, hash binary, fingerprints binary, counts binary, keepers binary")


def _answers(tables: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc, part, low, high) of the probes whose key is in the tables with another keeper.

    Tables and probes are dealt by shard and sorted, so a task holds one table at a time and probes stream past.
    """
    none = [F.lit(None).cast("bigint").alias(c) for c in ("low", "high", "doc", "part")]
    blank = [F.lit(None).cast("binary").alias(c) for c in ("hash", "fingerprints", "keepers")]
    both = tables.select("shard", "hash", "fingerprints", "keepers", *none).union(probes.select("shard", *blank, "low", "high", "doc", "part"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("hash").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index = stored = keepers = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
            for lo, hi in zip(starts, [*starts[1:], len(shard)]):
                part = batch.slice(lo, hi - lo)
                if part.column(1)[0].is_valid:
                    held = shard[lo]
                    index = Hash.from_bytes(part.column(1)[0].as_py())
                    stored, keepers = np.frombuffer(part.column(2)[0].as_py(), np.uint64), np.frombuffer(part.column(3)[0].as_py(), np.int64)
                    part = part.slice(1)
                if held != shard[lo] or not part.num_rows:
                    continue
                low, high = (part.column(c).to_numpy().view(np.uint64) for c in (4, 5))
                at = index.numbers(low, high)
                goes = (at >= 0) & (stored[at] == low) & (keepers[at] != part.column(6).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(goes)) for c in (6, 7, 4, 5)], names=["doc", "part", "low", "high"])

    return dealt.mapInArrow(run, "doc bigint, part bigint, low bigint, high bigint")


def repeated_keys(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(low, high, n, keeper) of the keys that two documents or more hold, n counting rows; and the probes there will be."""
    seen = Observation()
    counted = _hashes(rows, least).groupBy("low", "high").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"), F.max("doc").alias("last"))
    counted = counted.observe(seen, F.sum("n").alias("n"))
    return stage(counted.where("keeper < last").drop("last"), "repeated-lines"), seen.get["n"] or 0


def without_repeated(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_dropped) of every row of ``docs``, ``row`` being the row as it is.

    Lines end at \\n. Lines that share a key (see ``line_key``) of ``least`` code points or more, found in at
    least two documents, stay in the one with the smallest id alone; there all of them stay. ``kept`` holds
    the lines that stay in their order. A null or empty text is one empty line.

    Rows with the same id are one document: they neither count twice nor take lines from each other. Rows
    without an id are one document after all others. Ids have to be whole numbers. Other columns pass
    through whatever their names.

    Keys are 128-bit digests. A key's place comes from the hash of its shard and its low half is the
    fingerprint, so a key that is not in the table passes for one that is with a chance of 2^-64.
    Documents ask for each of their keys once, and the few keys that a large part of all documents asks for are
    answered in place, so no shard draws more probes than others. Texts meet their answers in one join.
    """
    spark = docs.sparkSession
    rows = _rows(docs, doc_id, text)
    repeated, probes = repeated_keys(rows, least)
    shards = max(1, -(-repeated.count() // KEYS), -(-probes // PROBES))
    common = repeated.where(F.col("n") * HOT > probes).collect()  # fewer than HOT rows, for their n add up to probes at most
    hot = {(r["low"] % (1 << 64), r["high"] % (1 << 64)): r["keeper"] for r in common}
    shared = spark.sparkContext.broadcast(hot)
    tables = stage(shard_tables(repeated, shards), "line-tables")
    asked = _hashes(rows, least, frozenset(hot)).withColumn("shard", _shard(shards))
    gone = _answers(tables, asked).distinct().groupBy("doc", "part").agg(F.collect_list(F.struct("low", "high")).alias("gone"))  # the lines of one text at most
    whole = docs.select(F.struct("*").alias("row")).select("row", *[c.alias(f"_{n}") for n, c in _identity(doc_id, text)])
    met = whole.join(gone, (F.col("_doc") == F.col("doc")) & (F.col("_part") == F.col("part")), "left")
    met = met.select("row", F.col("_doc").alias("doc"), F.col(f"row.{text}").cast("binary").alias("text"), F.col("gone.low").alias("low"), F.col("gone.high").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                kept, counts, dropped = [], [], []
                for doc, raw, low, high in zip(*[piece.column(c).to_pylist() for c in range(1, 5)]):
                    lines = (raw or b"").split(b"\n")
                    bad = {(a % (1 << 64), b % (1 << 64)) for a, b in zip(low or (), high or ())}
                    goes = {k for k in _long_keys(raw, least) if (h := _halves(k)) in bad or keepers.get(h, doc) != doc}
                    stay = [x for x in lines if line_key(x) not in goes] if goes else lines
                    kept.append(b"\n".join(stay))
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    out = T.StructType([whole.schema["row"], T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return met.mapInArrow(run, out)


def _identity(doc_id: str, text: str) -> list[tuple[str, Column]]:
    return [("doc", F.coalesce(F.col(f"row.{doc_id}").cast("bigint"), F.lit(LAST))), ("part", F.xxhash64(F.col(f"row.{text}")))]
