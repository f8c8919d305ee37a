"""Small documents with every awkward case, and columns whose names clash with those used inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHING = ["fp", "key", "ids", "words", "row", "base", "found", "part", "root", "toxic", "score", "train", "component_id", "rules", "kind"]


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows as a documents table, with clashing columns."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    return docs.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING])


def awkward(words: str = "one two three four five six seven") -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, an id with two texts, white space alone, and a very long text."""
    long = " ".join(f"{words} w{i % 977}" for i in range(20_000))
    return [(1, words), (2, None), (3, ""), (None, words), (None, None), (5, words), (5, words), (6, " \n\t "), (7, long), (8, words.upper()), (9, "two words"), (9, "other text here")]
