"""Session defaults and the shared staging area used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cohortflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on. Partition counts are left to the cluster unless passed."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; in local mode with nothing set, a folder beside the warehouse tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(root)
    return root


def _staged_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/staged/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in shared storage, deleted by ``clean``."""
    return f"{_staged_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query as soon as it has ended, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Later branches read pruned Parquet instead of recomputing the upstream plan, and a lost
    executor costs a re-read, not a re-run. What was shuffled for it is deleted once it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


#: Rows of a part that one task joins or groups at a time.
PART_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts whose number grows with ``rows``, so that a task's memory does not.

    Left to itself, adaptive execution merges parts by their compressed bytes, and a task may get millions of narrow rows. Joins and
    aggregations by these keys need no further shuffle. A small input is left as it is.
    """
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > 8 else df


def discard(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for these frames, once nothing that is still to run reads it."""
    for df in staged:
        _delete(df.sparkSession, df._staged_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged. Frames that read it can't be used afterwards."""
    _delete(spark, _staged_folder(spark))
