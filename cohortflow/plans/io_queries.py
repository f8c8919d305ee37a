"""Queries that write tables to shared storage and read them back: readers, wide matrices, published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortflow.operators.fingerprint import fingerprint
from cohortflow.plans.proxies import event_study, table
from cohortflow.plans.registry import query
from cohortflow.plans.sql import with_query
from cohortflow.session import scratch
from cohortflow.sources import sinks, tables


@query(
    "read_tables",
    """SELECT format, c_custkey, c_name, c_mktsegment FROM customer, (VALUES ('csv'), ('parquet'), ('tsv'), ('txt')) f(format)""",
)
def read_tables(spark, sf):
    """Customers written and read in every format of curated tables."""
    rows, parts = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), []
    for suffix in ("csv", "parquet", "tsv", "txt"):
        path = f"{scratch(spark, 'customers')}.{suffix}"
        if suffix == "parquet":
            rows.write.parquet(path)
        else:
            rows.write.option("header", True).option("sep", tables.SEPARATORS[f".{suffix}"]).csv(path)
        read = tables.read_table(spark, path)
        parts.append(read.select(F.lit(suffix).alias("format"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "wide_matrix",
    """WITH c AS (SELECT o_custkey::VARCHAR AS sample_id, strftime(o_orderdate, '%Y-%m') AS feature, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)
    SELECT s.sample_id, 'rna' AS modality, f.feature, c.value FROM (SELECT DISTINCT sample_id FROM c) s CROSS JOIN (SELECT DISTINCT feature FROM c) f LEFT JOIN c USING (sample_id, feature)""",
)
def wide_matrix(spark, sf):
    """Customers by months of orders as a delimited matrix file, read back as cells."""
    cells = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("sample_id"), F.date_format("o_orderdate", "yyyy-MM").alias("feature")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    path = f"{scratch(spark, 'matrix')}.tsv"
    sinks.write_matrix(cells, path)
    return tables.read_matrices(spark, [{"path": path, "role": "matrix", "modality": "rna"}])


@query(
    "id_map_file",
    """SELECT p_type AS modality, p_partkey::VARCHAR AS source_id, p_brand AS target_id, 'undeclared' AS target_id_type FROM part""",
)
def id_map_file(spark, sf):
    """Parts to brands as an id-map file without a type column."""
    path = f"{scratch(spark, 'ids')}.csv"
    rows = table(spark, sf, "part").select(F.col("p_type").alias("modality"), F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("target_id"))
    rows.write.option("header", True).csv(path)
    return tables.read_id_map(spark, path)


@query(
    "structure_file",
    """SELECT DISTINCT 'met' AS modality, p_brand AS feature_id, 'C' || replace(p_brand, '#', '') AS smiles FROM part WHERE p_size > 10""",
)
def structure_file(spark, sf):
    """Brands and made-up structures as a structure-map file: any header case, repeated rows, rows without a structure."""
    path = f"{scratch(spark, 'structures')}.tsv"
    smiles = F.when(F.col("p_size") > 10, F.concat(F.lit("C"), F.replace("p_brand", F.lit("#"), F.lit(""))))
    rows = table(spark, sf, "part").select(F.lit("met").alias("Modality"), F.concat(F.lit(" "), "p_brand").alias(" Feature_ID"), smiles.alias("SMILES"))
    rows.write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_structure_map(spark, path)


@query(
    "published_tables",
    with_query(
        """SELECT name, n_rows, true AS same FROM (SELECT 'cells' AS name, count(*) AS n_rows FROM p1_cells UNION ALL SELECT 'observations', count(*) FROM p1_obs
        UNION ALL SELECT 'split', count(*) FROM p1_obs)""",
        "p1_cells", "p1_obs",
    ),
)
def published_tables(spark, sf):
    """A study's cells, ordered observations and locked split published in one step; each is read back and keeps its fingerprint."""
    study = event_study(spark, sf)
    path = scratch(spark, "published")
    split, by = sinks.locked_table(study.observations)
    found = {"cells": (study.cells, ["modality", "split"]), "observations": sinks.ordered_observations(study.observations), "split": (split, by)}
    sinks.publish(found, path)
    parts = []
    for name, (df, _) in found.items():
        back = fingerprint(spark.read.schema(df.schema).parquet(f"{path}/{name}"), name)
        parts.append(back.join(fingerprint(df, name).select("name", F.col("digest").alias("_digest")), "name").select("name", "n_rows", (F.col("digest") == F.col("_digest")).alias("same")))
    return reduce(lambda a, b: a.unionByName(b), parts)
