"""Order-free content fingerprints of tables and the frozen-versus-current comparison."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.hashing import canonical_value, digest_words


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """One row ``name, n_rows, digest`` that does not depend on row or column order.

    Each row is hashed over its sorted columns; the twelve 20-bit words of the row digests are
    summed, which keeps duplicates apart and merges map-side, so no rows are gathered.
    """
    kinds = dict(df.dtypes)
    columns = sorted(df.columns)
    text = F.concat_ws("|", *[canonical_value(F.col(c), kinds[c]) for c in columns])
    row = df.select(F.sha2(text, 256).alias("h"))
    words = row.select(*[w.alias(f"w{i}") for i, w in enumerate(digest_words(F.col("h")))])
    names = words.columns
    sums = words.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    head = F.lit(",".join(columns))
    return sums.select(
        F.lit(name).alias("name"), "n_rows",
        F.sha2(F.concat_ws("|", head, F.col("n_rows").cast("string"), *[F.col(c).cast("string") for c in names]), 256).alias("digest"),
    )


def config_hash(payload: dict) -> str:
    """sha256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def run_hashes(tables: DataFrame, split: DataFrame, config: dict, seed: int) -> DataFrame:
    """All names and hashes of a run: each table, their combination, split, config and seed.

    ``tables`` has one row per table, so the combined hash orders a handful of rows.
    """
    combined = tables.agg(
        F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest")))), 256).alias("digest")
    ).select(F.lit("data_hash").alias("name"), "digest")
    fixed = tables.sparkSession.createDataFrame([("config_hash", config_hash(config)), ("seed", str(seed))], "name string, digest string")
    return (
        tables.select(F.concat(F.lit("data_hash."), "name").alias("name"), "digest")
        .unionByName(combined).unionByName(split.select(F.lit("split_hash").alias("name"), "digest")).unionByName(fixed)
    )


def fingerprint_diff(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Names that are missing, extra or changed; any row is a refusal."""
    a = frozen.select("name", F.col("digest").alias("frozen"))
    b = current.select("name", F.col("digest").alias("current"))
    status = F.when(F.col("current").isNull(), "missing").when(F.col("frozen").isNull(), "extra").otherwise("changed")
    return a.join(b, "name", "full").where(~F.col("frozen").eqNullSafe(F.col("current"))).select("name", status.alias("status"))
