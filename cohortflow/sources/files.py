"""Rules over file inventories: roles, repositories, download plans, receipts, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Filename markers by role.
COMPRESSION_SUFFIXES = [".tar.gz", ".tgz", ".gz", ".bz2", ".xz"]
RAW_SUFFIXES = [".fastq", ".fq", ".sra", ".bam", ".cram", ".raw", ".mzml", ".mzxml", ".wiff", ".d", ".lcd", ".baf"]
RAW_COMPRESSED = [".fastq.gz", ".fq.gz", ".fastq.bz2", ".fq.bz2"]
MATRIX_MARKERS = [".tsv", ".csv", ".txt", ".tab", ".parquet", "series_matrix", "_series_matrix.txt"]
ARCHIVE_SUFFIXES = [".zip", ".tar", ".tar.gz", ".tgz", ".7z"]
SHEET_SUFFIXES = [".tsv", ".csv", ".txt"]

# Known organisms and their taxon ids.
TAXA = {
    "homo sapiens": 9606, "human": 9606, "mus musculus": 10090, "mouse": 10090, "rattus norvegicus": 10116, "rat": 10116,
    "danio rerio": 7955, "zebrafish": 7955, "drosophila melanogaster": 7227, "saccharomyces cerevisiae": 4932,
    "arabidopsis thaliana": 3702, "caenorhabditis elegans": 6239,
}


def _ends(col: Column, suffixes: list[str]) -> Column:
    escaped = "|".join(s.replace(".", "\\.") for s in suffixes)
    return col.rlike(f"({escaped})$")


def file_role(name: Column) -> Column:
    """Role from the file name only: raw beats archive beats sample sheet beats matrix.

    A name with "sample" and a table suffix is a sample sheet here; that test comes before the
    matrix markers, which would otherwise always win.
    """
    lower = F.lower(name)
    core = F.regexp_replace(lower, "(" + "|".join(s.replace(".", "\\.") for s in COMPRESSION_SUFFIXES) + ")$", "")
    markers = "|".join(m.replace(".", "\\.") for m in MATRIX_MARKERS)
    return (
        F.when(_ends(lower, RAW_COMPRESSED) | _ends(core, RAW_SUFFIXES), "rejected_raw")
        .when(_ends(lower, ARCHIVE_SUFFIXES), "archive")
        .when(F.contains(core, F.lit("sample")) & _ends(core, SHEET_SUFFIXES), "sample_sheet")
        .when(core.rlike(markers), "matrix")
        .otherwise("unknown")
    )


def source_of(requests: DataFrame) -> DataFrame:
    """Repository of each request: an explicit flag wins, then local path, URL, accession, DOI.

    Columns ``source, accession, url, local_path, paper_doi`` (nullable). ``reject`` says why a
    request cannot be served.
    """
    acc = F.upper(F.trim(F.coalesce("accession", F.lit(""))))
    explicit = F.when(F.col("source").isNotNull() & (F.col("source") != "doi"), F.col("source"))
    has_acc, has_url = F.col("accession").isNotNull() & (F.col("accession") != ""), F.col("url").isNotNull()
    inferred = F.coalesce(
        explicit,
        F.when(F.col("local_path").isNotNull() & ~has_url & ~has_acc, "local"),
        F.when(has_url & ~has_acc, "url"),
        F.when(F.startswith(acc, F.lit("GSE")) | F.startswith(acc, F.lit("GDS")), "geo"),
        F.when(F.startswith(acc, F.lit("PXD")), "pride"),
        F.when(F.startswith(acc, F.lit("E-")) | F.startswith(acc, F.lit("S-")), "biostudies"),
        F.when(F.col("paper_doi").isNotNull() & (acc == "") & ~has_url, "doi"),
    )
    named = F.when(inferred == "arrayexpress", "biostudies").otherwise(inferred)
    out = requests.withColumn("resolved", named)
    reject = (
        F.when(F.col("resolved").isNull(), "cannot_infer_source")
        .when(F.col("resolved").isin("sra", "mw"), "source_not_served")
        .when((F.col("resolved") == "geo") & acc.rlike(r"^GDS\d+$"), "dataset_not_series")
        .when((F.col("resolved") == "geo") & ~acc.rlike(r"^GSE\d+$"), "not_a_series_accession")
        .when((F.col("resolved") == "pride") & ~F.startswith(acc, F.lit("PXD")), "not_a_project_accession")
    )
    return out.withColumn("reject", reject)


def dataset_id(source: Column, accession: Column, filename: Column) -> Column:
    """``source_accession`` (or file stem), unusual characters as ``_``, lower case."""
    stem = F.when(filename.isNotNull(), F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    raw = F.coalesce(F.when(accession != "", accession), stem, F.lit("ingest"))
    return F.lower(F.concat_ws("_", source, F.regexp_replace(raw, r"[^\p{L}\p{N}._-]", "_")))


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Scheme, host, decoded last path segment, and whether the scheme is allowed."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    return df.withColumns(
        {
            "scheme": scheme, "host": host, "filename": F.when(name == "", "downloaded_file").otherwise(name),
            "allowed": scheme.isin("http", "https"),
        }
    )


def download_plan(inventory: DataFrame) -> DataFrame:
    """Files to fetch: not raw, not an archive, and with a URL or a local path."""
    return inventory.where(~F.col("role").isin("rejected_raw", "archive") & (F.col("url").isNotNull() | F.col("local_path").isNotNull()))


def plan_counts(inventory: DataFrame, key: str = "dataset_id") -> DataFrame:
    return inventory.groupBy(key).agg(F.count("*").alias("n_files"), F.count_if(F.col("role") == "rejected_raw").alias("n_raw_skipped"))


def apply_receipts(inventory: DataFrame, receipts: DataFrame) -> DataFrame:
    """Landed path, digest and size by data set and file name; files without a receipt keep what they had.

    Of several receipts for one file the one with the greatest path counts.
    """
    key = ["dataset_id", "filename"]
    r = receipts.groupBy(*key).agg(F.max(F.struct(F.col("dest").alias("p"), F.col("sha256").alias("h"), F.col("bytes_written").alias("b"))).alias("r"))
    r = r.select(*key, F.col("r.p").alias("_p"), F.col("r.h").alias("_h"), F.col("r.b").alias("_b"))
    return inventory.join(r, key, "left").withColumns(
        {"path": F.coalesce("_p", "path"), "sha256": F.coalesce("_h", "sha256"), "size_bytes": F.coalesce("_b", "size_bytes")}
    ).drop("_p", "_h", "_b")


#: Files up to this size are read by the binary source; longer ones are hashed piece by piece in a task.
WHOLE_FILE = 1 << 28


def landed_digests(spark: SparkSession, folder: str, whole: int = WHOLE_FILE, by_dataset: bool = False) -> DataFrame:
    """Size, sha256 and md5 of every landed file, of any size. With ``by_dataset`` files lie in a folder for each data set, which is then named."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", by_dataset).load(folder)
    if by_dataset:
        of = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dataset_id")
        return landed_files_in(files, F.concat_ws("/", of, F.regexp_extract("path", r"([^/]+)$", 1)), whole).select(
            F.substring_index("filename", "/", 1).alias("dataset_id"), F.expr("substr(filename, instr(filename, '/') + 1)").alias("filename"), "size_bytes", "sha256", "md5")
    return landed_files_in(files, F.regexp_extract("path", r"([^/]+)$", 1), whole)


def landed_files_in(files: DataFrame, name: Column, whole: int) -> DataFrame:
    name = name.alias("filename")
    small = files.where(F.col("length") <= whole).select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    paths = files.where(F.col("length") > whole).select("path", name, F.col("length").alias("size_bytes")).repartition("path")
    return small.unionByName(paths.mapInPandas(_digest_files, "filename string, size_bytes bigint, sha256 string, md5 string"))


def _digest_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            store, path = FileSystem.from_uri(quote(row.path, safe=":/%"))
            sha, md5 = hashlib.sha256(), hashlib.md5()
            with store.open_input_stream(path) as stream:
                while piece := stream.read(1 << 22):
                    sha.update(piece)
                    md5.update(piece)
            yield pd.DataFrame({"filename": [row.filename], "size_bytes": [row.size_bytes], "sha256": [sha.hexdigest()], "md5": [md5.hexdigest()]})


def verify_landed(expected: DataFrame, landed: DataFrame, max_bytes: int) -> DataFrame:
    """Status per expected file: missing, too_large, sha256_mismatch, official_mismatch or ok.

    Files are known by data set and name where both tables have a data set, else by name, which then has to be unique.
    """
    key = ["dataset_id", "filename"] if "dataset_id" in expected.columns and "dataset_id" in landed.columns else ["filename"]
    want = F.regexp_replace(F.lower(F.trim("official_checksum")), "md5:|sha256:", "")
    got = F.when(F.col("official_checksum_alg") == "sha256", F.col("l.sha256")).when(F.col("official_checksum_alg") == "md5", F.col("l.md5"))
    e, joined = expected.alias("e"), landed.alias("l")
    has_official = F.col("official_checksum").isNotNull() & F.col("official_checksum_alg").isNotNull()
    status = (
        F.when(F.col("l.filename").isNull(), "missing")
        .when(F.col("l.size_bytes") > max_bytes, "too_large")
        .when(F.col("e.sha256").isNotNull() & (F.lower("e.sha256") != F.col("l.sha256")), "sha256_mismatch")
        .when(has_official & ~F.coalesce(got == want, F.lit(False)), "official_mismatch")
        .otherwise("ok")
    )
    same = reduce(lambda a, b: a & b, [F.col(f"e.{c}") == F.col(f"l.{c}") for c in key])
    return e.join(joined, same, "left").select(
        *[F.col(f"e.{c}").alias(c) for c in key], F.col("l.size_bytes").alias("size_bytes"), F.col("l.sha256").alias("sha256"), status.alias("status")
    )


# Content kinds that are never taken as data.
FORBIDDEN_KINDS = ["script", "executable", "shell"]


def capture_text(df: DataFrame, source: str, text: str, kind: str) -> DataFrame:
    """Repository prose as data: NULs removed, digest taken, executable kinds refused."""
    cleaned = F.replace(F.col(text), F.lit("\u0000"), F.lit(""))
    kinds = F.lower(F.trim(kind))
    return df.select(
        F.col(source).alias("source"), cleaned.alias("text"), F.sha2(cleaned, 256).alias("sha256"),
        kinds.alias("content_kind"), kinds.isin(FORBIDDEN_KINDS).alias("refused"),
    )


def taxon_ids(df: DataFrame, name: str) -> DataFrame:
    """Taxon id of a known organism name; unknown names stay NULL."""
    pairs = F.create_map(*[F.lit(v) for kv in TAXA.items() for v in kv])
    return df.withColumn("taxon_id", F.try_element_at(pairs, F.lower(F.trim(name))))
