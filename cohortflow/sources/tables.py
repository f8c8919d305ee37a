"""Readers of curated tables: matrices, sample sheets, id maps, structure maps."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = {".tsv": "\t", ".txt": "\t", ".csv": ","}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, TSV or CSV by suffix. Text columns stay strings unless a schema is given."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    for suffix, sep in SEPARATORS.items():
        if path.endswith(suffix):
            reader = spark.read.option("header", True).option("sep", sep)
            return (reader.schema(schema) if schema is not None else reader).csv(path)
    raise ValueError(f"{path}: use .parquet, .tsv, .txt or .csv")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sample sheet with every column as text and ``time`` as double."""
    sheet = read_table(spark, path)
    return sheet.withColumn("time", F.col("time").cast("double")) if "time" in sheet.columns else sheet


CELLS = "sample_id string, modality string, feature string, value double"
#: Cells made at a time.
PIECE = 1 << 20


def _melted(names: pa.Array, samples: pa.Array, columns: list[pa.Array], modality: str) -> Iterator[pa.RecordBatch]:
    """One cell for each row and column, row by row; NaN becomes NULL."""
    most = max(1, PIECE // max(1, len(columns)))
    for at in range(0, len(samples), most):
        part = samples.slice(at, most)
        values = np.empty((len(part), len(columns)))
        for j, column in enumerate(columns):
            values[:, j] = column.slice(at, most).fill_null(np.nan).to_numpy(zero_copy_only=False)
        flat = values.ravel()
        rows = pa.array(np.repeat(np.arange(len(part)), len(columns)))
        each = pa.array(np.tile(np.arange(len(columns)), len(part)))
        kind = pa.array([modality], pa.string()).take(pa.array(np.zeros(len(flat), int)))
        yield pa.RecordBatch.from_arrays([part.take(rows), kind, names.take(each), pa.array(flat, mask=np.isnan(flat))], names=["sample_id", "modality", "feature", "value"])


def matrix_cells(wide: DataFrame, modality: str) -> DataFrame:
    """Wide matrix to long cells; NaN becomes NULL. Columns are melted in Arrow batches, so the plan does not grow with them."""
    if "sample_id" not in wide.columns:
        raise ValueError(f"The {modality} matrix has no sample_id column.")
    place = wide.columns.index("sample_id")
    features = [c for c in wide.columns if c != "sample_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(features, pa.string())
        for batch in batches:
            columns = [c.cast(pa.float64()) for j, c in enumerate(batch.columns) if j != place]
            yield from _melted(names, batch.column(place).cast(pa.string()), columns, modality)

    return wide.toDF(*[f"c{j}" for j in range(len(wide.columns))]).mapInArrow(run, CELLS)  # names may hold dots


def text_matrix_cells(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """Cells of a delimited matrix with a header, read by lines: each is split once, against the header.

    The plan is one scan and one step however many columns there are, and the rows of a file are spread over tasks.
    A folder's files all have the header. Values are numbers, empty or NaN; a line holds one row.
    """
    sep = next(v for k, v in SEPARATORS.items() if path.rstrip("/").endswith(k))
    lines = spark.read.text(path)
    first = lines.first()
    header = next(csv.reader([first["value"]], delimiter=sep)) if first else []
    if "sample_id" not in header:
        raise ValueError(f"The {modality} matrix has no sample_id column.")
    place = header.index("sample_id")
    features = [c for c in header if c != "sample_id"]
    kinds = {c: pa.string() if c == "sample_id" else pa.float64() for c in header}
    line = first["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(features, pa.string())
        for batch in batches:
            rows = [x for x in batch.column(0).to_pylist() if x and x != line]
            if rows:
                parsed = pa_csv.read_csv(
                    io.BytesIO("\n".join(rows).encode()), pa_csv.ReadOptions(column_names=header, use_threads=False, block_size=1 << 30),
                    pa_csv.ParseOptions(delimiter=sep), pa_csv.ConvertOptions(column_types=kinds, null_values=[""], strings_can_be_null=True),
                ).combine_chunks()
                columns = [parsed.column(j).combine_chunks() for j in range(len(header))]
                yield from _melted(names, columns[place], [c for j, c in enumerate(columns) if j != place], modality)

    return lines.mapInArrow(run, CELLS)


def read_matrices(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Cells of the manifest files with role ``matrix``; other roles are ignored."""
    parts = [
        matrix_cells(read_table(spark, f["path"]), f["modality"]) if f["path"].endswith(".parquet") else text_matrix_cells(spark, f["path"], f["modality"])
        for f in files if f["role"] == "matrix"
    ]
    if not parts:
        raise ValueError("The manifest lists no matrix file.")
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    table = read_table(spark, path)
    missing = [c for c in ("modality", "source_id", "target_id") if c not in table.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}.")
    if "target_id_type" not in table.columns:
        table = table.withColumn("target_id_type", F.lit("undeclared"))
    return table.select("modality", "source_id", "target_id", "target_id_type")


def structure_rows(table: DataFrame) -> DataFrame:
    """Header in any case; rows without a structure dropped; one row per distinct mapping."""
    lowered = table.toDF(*[c.strip().lower() for c in table.columns])
    trimmed = lowered.select(*[F.trim(c).alias(c) for c in ("modality", "feature_id", "smiles")])
    return trimmed.where("smiles IS NOT NULL AND smiles <> ''").distinct()


def structure_conflicts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("modality", "feature_id").agg(F.count_distinct("smiles").alias("n_structures")).where("n_structures > 1")


def read_structure_map(spark: SparkSession, path: str) -> DataFrame:
    """Feature to structure table; comments skipped, conflicts and an empty result rejected."""
    rows = structure_rows(spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path))
    if rows.isEmpty():
        raise ValueError(f"{path} maps no feature.")
    if not structure_conflicts(rows).isEmpty():
        raise ValueError(f"{path} maps a feature to several structures.")
    return rows
