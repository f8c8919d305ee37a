"""Writers of the locked and reported tables. What they write appears whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.numeric import finite
from cohortflow.operators import linear
from cohortflow.operators.split import locked_split


class PublishFailed(RuntimeError):
    """What was read back is not what was written, or the place is taken; nothing was published."""


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _content(df: DataFrame) -> list[Column]:
    """Row count and an order-free sum of row hashes over all columns."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return [F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).alias("hash")]


def publish(tables: dict[str, tuple[DataFrame, list[str]]], path: str, fmt: str = "parquet") -> None:
    """Write all tables (with their partition columns) as folders of ``path`` in one step.

    They are written beside it first, in a staging folder. The rows are counted and hashed as they pass, the files
    are read back and have to give the same, and then one rename puts all of them in place. Whatever fails
    before leaves nothing at ``path`` and no staging folder. ``path`` itself is the table if its name is empty.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    files, target = _files(spark, path)
    if files.exists(target):
        raise PublishFailed(f"{path} exists")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    _, folder = _files(spark, staging)
    try:
        for name, (df, by) in tables.items():
            seen = Observation()
            place = f"{staging}/{name}".rstrip("/")
            df.observe(seen, *_content(df)).write.mode("errorifexists").partitionBy(*by).format(fmt).save(place)
            back = spark.read.schema(df.schema).format(fmt).load(place).agg(*_content(df)).first()
            if (back["rows"], back["hash"]) != (seen.get["rows"], seen.get["hash"]):
                raise PublishFailed(f"{name or path}: {back['rows']} rows read back, {seen.get['rows']} written, or their content differs")
        files.mkdirs(target.getParent())
        if not files.rename(folder, target):
            raise PublishFailed(f"{path} could not be put in place")
    finally:
        files.delete(folder, True)


def locked_table(labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """The locked split table, one folder per split so later reads are pruned."""
    return locked_split(labelled), ["split"]


def ordered_observations(observations: DataFrame) -> tuple[DataFrame, list[str]]:
    """Observations in order of their id: files hold ranges of it, rows are sorted within."""
    return observations.repartitionByRange("observation_id").sortWithinPartitions("observation_id"), []


def layered(cells: DataFrame, sample_qc: DataFrame, feature_qc: DataFrame, provenance: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Cells with their layers by modality and split, and the QC and provenance tables beside them."""
    return {"cells": (cells, ["modality", "split"]), "sample_qc": (sample_qc, []), "feature_qc": (feature_qc, []), "provenance": (provenance, [])}


def write_split(labelled: DataFrame, path: str) -> None:
    publish({"": locked_table(labelled)}, path)


def write_observations(observations: DataFrame, path: str) -> None:
    publish({"": ordered_observations(observations)}, path)


def write_layered(cells: DataFrame, sample_qc: DataFrame, feature_qc: DataFrame, provenance: DataFrame, path: str) -> None:
    publish(layered(cells, sample_qc, feature_qc, provenance), path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    publish({name: (table, []) for name, table in tables.items()}, path, fmt)


def write_matrix(cells: DataFrame, path: str) -> None:
    """``sample_id, feature, value`` as a tab-separated matrix, a row for each sample and a column for each feature in alphabetical order."""
    names = linear.header(cells, F.col("feature"))
    header = "\t".join(["sample_id", *[r["name"] for r in names.table.orderBy("at").collect()]])  # the file's first line
    placed = cells.join(names.table.withColumnRenamed("name", "feature"), "feature").groupBy("sample_id").agg(F.collect_list(F.struct("at", F.col("value").alias("v"))).alias("e"))
    rows = linear.densify(placed.select("sample_id", F.col("e.at").alias("at"), F.col("e.v").alias("v")), names.n, "x")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["\t".join([str(s), *["" if v is None else repr(v) for v in x]]) for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    text = rows.select("sample_id", "x").mapInArrow(lines, "line string").withColumnRenamed("line", header)
    text.write.mode("errorifexists").option("header", True).option("sep", "\u0001").option("quote", "\u0000").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def metric_rows(report: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric, value, written``; undefined or infinite values are not written."""
    return report.unpivot(keys, metrics, "metric", "value").withColumn("written", finite(F.col("value")))


def append_metrics(rows: DataFrame, path: str) -> DataFrame:
    """Append the defined metrics of a run and return the skipped ones."""
    rows.where("written").drop("written").write.mode("append").parquet(path)
    return rows.where("NOT written").drop("written")
