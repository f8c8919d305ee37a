"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import ann, knn, lines, lm, negatives, packing, pii, secrets, simhash, spans, tokens, toxicity, trie, twins
from cohortflow.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What SQL can express; the other queries are tested against brute force, a library, or held-out rows.
SQL: dict[str, str] = twins.SQL


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, fingerprints up to 2 bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    counts = [spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.label(F.col("base"), pii.KINDS), 256).alias("base_sha256"), spans.label(F.col("found"), pii.KINDS).alias("spans"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, further = [r.name for r in secrets.BASE], [r.name for r in secrets.FURTHER]
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    counts = [spans.count(F.col("found"), kind).alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(spans.label(base, kinds), 256).alias("base_sha256"), spans.label(F.col("found"), kinds + further).alias("spans"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), ~lm.held_out())


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated(table(spark, sf_dir, "documents"), least=10)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), span=100, most=6)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
