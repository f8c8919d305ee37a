"""File catalog, landed response, literature and fingerprint queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortflow.functions import text as text_fns
from cohortflow.functions.numeric import rounded
from cohortflow.operators import fingerprint, literature, readiness
from cohortflow.plans.proxies import event_study, table
from cohortflow.plans.registry import query
from cohortflow.plans.sql import fragment, r6, with_query
from cohortflow.sources import files, landed, sinks
from cohortflow.session import stage

# File names made from part names, with suffixes that reach every role.
SUFFIXES = [".fastq.gz", ".tsv", "_samples.csv", ".zip", ".counts.txt.gz", ".mzML", "_series_matrix.txt.gz", ".pdf", ".tar.gz", ".d"]
fragment(
    "f_names",
    f"SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_size % 10 {' '.join(f'WHEN {i} THEN {s!r}' for i, s in enumerate(SUFFIXES))} END AS filename, p_size, p_brand, p_retailprice FROM part",
)
ROLE_SQL = r"""CASE WHEN regexp_matches(lower({n}), '(\.fastq\.gz|\.fq\.gz|\.fastq\.bz2|\.fq\.bz2)$') OR regexp_matches({core}, '(\.fastq|\.fq|\.sra|\.bam|\.cram|\.raw|\.mzml|\.mzxml|\.wiff|\.d|\.lcd|\.baf)$') THEN 'rejected_raw'
  WHEN regexp_matches(lower({n}), '(\.zip|\.tar|\.tar\.gz|\.tgz|\.7z)$') THEN 'archive'
  WHEN contains({core}, 'sample') AND regexp_matches({core}, '(\.tsv|\.csv|\.txt)$') THEN 'sample_sheet'
  WHEN regexp_matches({core}, '(\.tsv|\.csv|\.txt|\.tab|\.parquet|series_matrix)') THEN 'matrix' ELSE 'unknown' END"""


def role_sql(name: str) -> str:
    core = rf"regexp_replace(lower({name}), '(\.tar\.gz|\.tgz|\.gz|\.bz2|\.xz)$', '')"
    return ROLE_SQL.replace("{n}", name).replace("{core}", core)


def named_files(spark, sf):
    suffix = F.lit(None).cast("string")
    for i, s in enumerate(SUFFIXES):
        suffix = F.when(F.col("p_size") % 10 == i, s).otherwise(suffix)
    return table(spark, sf, "part").withColumn("filename", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix))


@query("file_role", with_query(f"SELECT p_partkey AS id, filename, {role_sql('filename')} AS role FROM f_names", "f_names"))
def file_role(spark, sf):
    return named_files(spark, sf).select(F.col("p_partkey").alias("id"), "filename", files.file_role(F.col("filename")).alias("role"))


@query(
    "href_inventory",
    rf"""WITH l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*"([^"]+)"', 1)) AS href FROM pages),
      n AS (SELECT page_id, base, regexp_extract(replace(href, '&amp;', '&'), '([^/]*)$', 1) AS filename FROM l)
    SELECT page_id, filename, {role_sql('filename')} AS role, regexp_replace(base, '[^/]*$', '') || filename AS url FROM n WHERE filename NOT IN ('', 'index.html', '..')""",
)
def href_inventory(spark, sf):
    return landed.listing_links(table(spark, sf, "pages"), "html", "url", ["page_id"])


@query(
    "url_parts",
    r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
        url_decode(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)) AS name FROM pages)
    SELECT page_id, scheme, host, CASE WHEN name = '' THEN 'downloaded_file' ELSE name END AS filename, scheme IN ('http', 'https') AS allowed FROM u""",
)
def url_parts(spark, sf):
    return files.url_parts(table(spark, sf, "pages").select("page_id", "url")).drop("url")


@query(
    "accession_source",
    """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'sra' WHEN o_orderkey % 13 = 0 THEN 'arrayexpress' END AS source,
        CASE o_orderstatus WHEN 'F' THEN 'gse' || o_orderkey::VARCHAR WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PXD' ELSE 'GDS' END || o_orderkey::VARCHAR
          ELSE CASE o_orderkey % 4 WHEN 0 THEN 'E-MTAB-' || o_orderkey::VARCHAR WHEN 1 THEN 'X' || o_orderkey::VARCHAR WHEN 2 THEN NULL ELSE 'GSEx' END END AS accession,
        CASE WHEN o_orderkey % 3 = 0 THEN 'https://h/f.tsv' END AS url FROM orders),
      s AS (SELECT *, upper(trim(coalesce(accession, ''))) AS acc FROM r),
      t AS (SELECT *, CASE WHEN coalesce(source, CASE WHEN url IS NOT NULL AND acc = '' THEN 'url' WHEN starts_with(acc, 'GSE') OR starts_with(acc, 'GDS') THEN 'geo' WHEN starts_with(acc, 'PXD') THEN 'pride'
          WHEN starts_with(acc, 'E-') OR starts_with(acc, 'S-') THEN 'biostudies' END) = 'arrayexpress' THEN 'biostudies'
        ELSE coalesce(source, CASE WHEN url IS NOT NULL AND acc = '' THEN 'url' WHEN starts_with(acc, 'GSE') OR starts_with(acc, 'GDS') THEN 'geo' WHEN starts_with(acc, 'PXD') THEN 'pride'
          WHEN starts_with(acc, 'E-') OR starts_with(acc, 'S-') THEN 'biostudies' END) END AS resolved FROM s)
    SELECT id, resolved, CASE WHEN resolved IS NULL THEN 'cannot_infer_source' WHEN resolved = 'sra' THEN 'source_not_served'
        WHEN resolved = 'geo' AND regexp_matches(acc, '^GDS\\d+$') THEN 'dataset_not_series' WHEN resolved = 'geo' AND NOT regexp_matches(acc, '^GSE\\d+$') THEN 'not_a_series_accession' END AS reject,
      lower(concat_ws('_', resolved, coalesce(accession, 'ingest'))) AS dataset_id FROM t""".replace("\\\\", "\\"),
)
def accession_source(spark, sf):
    k = F.col("o_orderkey")
    text = k.cast("string")
    other = F.when(k % 4 == 0, F.concat(F.lit("E-MTAB-"), text)).when(k % 4 == 1, F.concat(F.lit("X"), text)).when(k % 4 == 3, "GSEx")
    requests = table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 11 == 0, "sra").when(k % 13 == 0, "arrayexpress").alias("source"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("gse"), text))
        .when(F.col("o_orderstatus") == "O", F.concat(F.when(k % 2 == 0, "PXD").otherwise("GDS"), text)).otherwise(other).alias("accession"),
        F.when(k % 3 == 0, "https://h/f.tsv").alias("url"), F.lit(None).cast("string").alias("local_path"), F.lit(None).cast("string").alias("paper_doi"),
    )
    out = files.source_of(requests)
    ident = files.dataset_id(F.col("resolved"), F.col("accession"), F.lit(None).cast("string"))
    return out.select("id", "resolved", "reject", ident.alias("dataset_id"))


@query(
    "untrusted_capture",
    """SELECT source, text, sha256(text) AS sha256, CASE lang WHEN 'de' THEN 'script' ELSE lang END AS content_kind, lang = 'de' AS refused FROM documents""",
)
def untrusted_capture(spark, sf):
    docs = table(spark, sf, "documents").withColumn("kind", F.when(F.col("lang") == "de", " Script ").otherwise(F.col("lang")))
    return files.capture_text(docs, "source", "text", "kind")


@query(
    "taxon_lookup",
    """SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 9606 WHEN 'MACHINERY' THEN 10090 END AS taxon_id FROM customer""",
)
def taxon_lookup(spark, sf):
    name = F.when(F.col("c_mktsegment") == "BUILDING", " Homo Sapiens").when(F.col("c_mktsegment") == "MACHINERY", "MOUSE").otherwise(F.col("c_mktsegment"))
    return files.taxon_ids(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), name.alias("name")), "name").drop("name")


@query(
    "project_files",
    with_query(
        f"""SELECT p_brand, filename, CASE WHEN p_size % 7 = 0 THEN 'rejected_raw' ELSE {role_sql('filename')} END AS role, CASE WHEN p_size % 3 <> 0 THEN 'https://files/' || filename END AS url,
          p_size::BIGINT * 1000 AS size_bytes, CASE WHEN p_size % 2 = 0 THEN 'sha' || p_partkey::VARCHAR ELSE 'md' || p_partkey::VARCHAR END AS official_checksum,
          CASE WHEN p_size % 2 = 0 THEN 'sha256' ELSE 'md5' END AS official_checksum_alg FROM f_names""",
        "f_names",
    ),
)
def project_files(spark, sf):
    """Listings of a few files per response, written as JSON and parsed back."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    link = F.when(size % 3 == 0, F.concat(F.lit("ftp://files/"), "filename")).otherwise(F.concat(F.lit("https://files/"), "filename"))
    item = F.struct(
        F.col("filename").alias("fileName"), F.when(size % 7 == 0, "raw").otherwise("other").alias("fileCategory"), (size * 1000).alias("fileSizeBytes"),
        F.when(size % 2 == 0, F.concat(F.lit("sha"), k)).alias("sha256"), F.when(size % 2 == 1, F.concat(F.lit("md"), k)).alias("checksum"),
        F.array(F.struct(link.alias("value"))).alias("publicFileLocations"),
    )
    # One response holds the parts of a brand in one hundred of the key range: a bounded list.
    grouped = named_files(spark, sf).groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.collect_list(item).alias("files"))
    wrapped = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.struct("files").alias("_embedded")))).otherwise(F.to_json("files"))
    return landed.project_files(grouped.select("p_brand", wrapped.alias("payload")), "payload", ["p_brand"])


@query(
    "study_files",
    with_query(
        f"""SELECT 'S-' || p_brand AS accession, filename, {role_sql('filename')} AS role, 'https://www.ebi.ac.uk/biostudies/files/S-' || p_brand || '/' || filename AS url,
          p_size::BIGINT AS size_bytes, 'md' || p_partkey::VARCHAR AS official_checksum, 'md5' AS official_checksum_alg FROM f_names""",
        "f_names",
    ),
)
def study_files(spark, sf):
    attribute = F.array(F.struct(F.lit("MD5").alias("name"), F.concat(F.lit("md"), F.col("p_partkey").cast("string")).alias("value")))
    item = F.struct(F.col("filename").alias("path"), F.col("p_size").alias("size"), attribute.alias("attributes"))
    grouped = named_files(spark, sf).groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.collect_list(item).alias("files"))
    section = F.struct(F.struct(F.array(F.struct("files")).alias("subsections")).alias("section"))
    payloads = grouped.select(F.concat(F.lit("S-"), "p_brand").alias("accession"), F.to_json(section).alias("payload"))
    return landed.study_files(landed.json_nodes(payloads, "payload", ["accession"]), "accession", ["accession"])


@query(
    "study_attributes",
    """SELECT s_suppkey AS id, 'organism' AS name, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', CASE WHEN s_acctbal > 0 THEN 'credit' ELSE 'debit' END FROM supplier""",
)
def study_attributes(spark, sf):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    balance = F.when(F.col("s_acctbal") > 0, "credit").otherwise("debit")
    doc = F.struct(
        F.array(pair("Organism ", F.lit("overridden"))).alias("attributes"),
        F.struct(F.array(pair("organism", F.col("s_name")), pair("Balance", balance)).alias("attributes")).alias("section"),
    )
    payloads = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(doc).alias("payload"))
    return landed.study_attributes(landed.json_nodes(payloads, "payload", ["id"]), ["id"])


@query(
    "series_summary",
    """SELECT c_custkey AS id, 'u' || c_custkey::VARCHAR AS uid, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'GEO GSE' || c_custkey::VARCHAR END AS title,
      CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'undeclared' END AS organism, 'note ' || c_nationkey::VARCHAR AS abstract FROM customer""",
)
def series_summary(spark, sf):
    c = table(spark, sf, "customer").withColumn("uid0", F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    record = F.struct(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("title"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("taxon"),
        F.concat(F.lit("note "), F.col("c_nationkey").cast("string")).alias("summary"),
    )
    search = F.to_json(F.struct(F.struct(F.array("uid0").alias("idlist")).alias("esearchresult")))
    summary = F.to_json(F.struct(F.create_map("uid0", record).alias("result")))
    rows = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("GSE"), F.col("c_custkey").cast("string")).alias("acc"), search.alias("search"), summary.alias("summary"))
    found = landed.search_uids(rows, "search", ["id", "acc", "summary"])
    return landed.series_summary(found, "summary", "uid", "acc", ["id", "uid"])


def page_inventory(spark, sf):
    parts = named_files(spark, sf)
    return parts.select(
        F.col("p_brand").alias("dataset_id"), "filename", files.file_role(F.col("filename")).alias("role"),
        F.when(F.col("p_retailprice") > 950, F.concat(F.lit("https://h/"), "filename")).alias("url"), F.lit(None).cast("string").alias("local_path"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("raw/file")).alias("path"), F.when(F.col("p_partkey") % 4 == 0, F.lit("abc")).alias("sha256"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("def")).alias("official_checksum"), F.col("p_partkey").alias("size_bytes"),
    )


@query(
    "download_plan",
    with_query(
        f"""SELECT p_brand AS dataset_id, count(*) AS n_files, count(*) FILTER (WHERE role = 'rejected_raw') AS n_raw_skipped,
          count(*) FILTER (WHERE role NOT IN ('rejected_raw', 'archive') AND p_retailprice > 950) AS n_planned FROM (SELECT *, {role_sql('filename')} AS role FROM f_names) GROUP BY 1""",
        "f_names",
    ),
)
def download_plan(spark, sf):
    inventory = page_inventory(spark, sf)
    planned = files.download_plan(inventory).groupBy("dataset_id").agg(F.count("*").alias("n_planned"))
    return files.plan_counts(inventory).join(planned, "dataset_id", "left").withColumn("n_planned", F.coalesce("n_planned", F.lit(0)))


@query(
    "apply_receipts",
    """WITH i AS (SELECT p_brand AS dataset_id, 'f' || (p_partkey % 50)::VARCHAR AS filename, CASE WHEN p_partkey % 2 = 0 THEN 'raw/file' END AS path, CASE WHEN p_partkey % 4 = 0 THEN 'abc' END AS sha256, p_partkey AS size_bytes FROM part),
    r AS (SELECT p_brand AS dataset_id, 'f' || (p_partkey % 50)::VARCHAR AS filename, arg_max(p_partkey, 'landed/' || p_partkey::VARCHAR) AS k FROM part WHERE p_partkey % 5 = 0 GROUP BY 1, 2)
    SELECT i.dataset_id, i.filename, coalesce('landed/' || k::VARCHAR, path) AS path, coalesce('h' || k::VARCHAR, sha256) AS sha256, coalesce(k * 2, size_bytes) AS size_bytes FROM i LEFT JOIN r ON i.dataset_id = r.dataset_id AND i.filename = r.filename""",
)
def apply_receipts(spark, sf):
    """Data sets share file names, and a file may have several receipts."""
    part = table(spark, sf, "part")
    name = lambda key: F.concat(F.lit("f"), (F.col(key) % 50).cast("string")).alias("filename")
    inventory = page_inventory(spark, sf).withColumn("filename", name("size_bytes"))
    text = F.col("p_partkey").cast("string")
    receipts = part.where("p_partkey % 5 = 0").select(
        F.col("p_brand").alias("dataset_id"), name("p_partkey"), F.concat(F.lit("landed/"), text).alias("dest"), F.concat(F.lit("h"), text).alias("sha256"), (F.col("p_partkey") * 2).alias("bytes_written")
    )
    return files.apply_receipts(inventory, receipts).select("dataset_id", "filename", "path", "sha256", "size_bytes")


@query("landed_files")
def landed_files(spark, sf):
    """Size and digests of the landed table files themselves. The receipts of half of them, by name, hold another digest."""
    digests = files.landed_digests(spark, sf)
    wrong = F.conv(F.substring(F.md5("filename"), 1, 1), 16, 10).cast("int") >= 8
    expected = digests.select("filename", F.when(wrong, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), F.concat(F.lit("MD5:"), F.upper("md5")).alias("official_checksum"), F.lit("md5").alias("official_checksum_alg"))
    return files.verify_landed(expected, digests, 1 << 31)


@query(
    "verify_landed",
    """WITH landed AS (SELECT lang AS dataset_id, doc_id::VARCHAR AS filename, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256, md5(text) AS md5, text FROM documents),
    expected AS (
      SELECT dataset_id, filename, CASE WHEN text LIKE '% %' THEN sha256(trim(text, ' ')) END AS sha256, 'MD5:' || upper(CASE WHEN size_bytes > 2000 THEN md5 ELSE md5(text || '.') END) AS official FROM landed
      UNION ALL SELECT 'benchmark', item_id::VARCHAR, NULL, NULL FROM benchmark)
    SELECT e.dataset_id, e.filename, l.size_bytes, l.sha256, CASE WHEN l.filename IS NULL THEN 'missing' WHEN l.size_bytes > 20000 THEN 'too_large'
      WHEN e.sha256 <> l.sha256 THEN 'sha256_mismatch' WHEN e.official <> 'MD5:' || upper(l.md5) THEN 'official_mismatch' ELSE 'ok' END AS status
    FROM expected e LEFT JOIN landed l USING (dataset_id, filename)""",
)
def verify_landed(spark, sf):
    """Documents as landed files of a data set per language; receipts that fit, are of another text, or of files that never came."""
    docs, raw = table(spark, sf, "documents"), F.col("text").cast("binary")
    landed = docs.select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").cast("string").alias("filename"), F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"), "text",
    )
    other = F.md5(F.concat("text", F.lit(".")).cast("binary"))
    expected = landed.select(
        "dataset_id", "filename", F.when(F.col("text").contains(" "), F.sha2(F.trim("text").cast("binary"), 256)).alias("sha256"),
        F.concat(F.lit("MD5:"), F.upper(F.when(F.col("size_bytes") > 2000, F.col("md5")).otherwise(other))).alias("official_checksum"), F.lit("md5").alias("official_checksum_alg"),
    )
    none = F.lit(None).cast("string")
    gone = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("dataset_id"), F.col("item_id").cast("string").alias("filename"), none.alias("sha256"), none.alias("official_checksum"), none.alias("official_checksum_alg"))
    return files.verify_landed(expected.unionByName(gone), landed.drop("text"), 20_000)


@query(
    "readiness_gates",
    with_query(
        f"""SELECT dataset_id, unnest(['processed_matrix', 'raw_excluded', 'unknown_files', 'archives', 'checksums', 'official_checksum', 'license', 'sampling_design', 'experimental_units', 'sample_sheet', 'pairing', 'organism', 'human_review']) AS gate,
          unnest([CASE WHEN m > 0 THEN 'green' ELSE 'red' END, CASE WHEN r = 0 THEN 'green' ELSE 'yellow' END, CASE WHEN u = 0 THEN 'green' ELSE 'yellow' END, CASE WHEN a = 0 THEN 'green' ELSE 'yellow' END,
            CASE WHEN m = 0 THEN 'red' WHEN h = 0 THEN 'green' ELSE 'yellow' END, CASE WHEN v = 0 THEN 'green' ELSE 'yellow' END, 'red', 'red', 'red', CASE WHEN m > 5 THEN 'yellow' ELSE 'red' END, 'red', 'yellow', 'red']) AS level,
          unnest([m, r, u, a, h, v, 0, 0, 0, 0, 0, 0, 1]) AS count
        FROM (SELECT p_brand AS dataset_id, count(*) FILTER (WHERE role = 'matrix') AS m, count(*) FILTER (WHERE role = 'rejected_raw') AS r, count(*) FILTER (WHERE role = 'unknown') AS u, count(*) FILTER (WHERE role = 'archive') AS a,
            count(*) FILTER (WHERE role = 'matrix' AND p_partkey % 2 = 0 AND p_partkey % 4 <> 0) AS h, count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 4 <> 0) AS v
          FROM (SELECT *, {role_sql('filename')} AS role FROM f_names) GROUP BY 1)""",
        "f_names",
    ),
)
def readiness_gates(spark, sf):
    inventory = page_inventory(spark, sf)
    matrices = inventory.groupBy("dataset_id").agg(F.count_if(F.col("role") == "matrix").alias("n"))
    none = F.lit(None).cast("string")
    datasets = matrices.select(
        "dataset_id", F.lit("Unknown").alias("license"), F.lit("some organism").alias("organism"), F.lit(None).cast("int").alias("taxon_id"), none.alias("sampling_design"),
        none.alias("pairing_level"), F.lit(False).alias("units_reviewed"), F.when(F.col("n") > 5, "parsed").otherwise("none").alias("sheet_state"),
        F.lit("required").alias("status"), F.lit(1).alias("n_unresolved"),
    )
    return readiness.readiness_gates(datasets, inventory).drop("how_to_fix")


# Literature: documents are hits, frequent corpus words play identifiers and cue words.
CUES = literature.CueWords(perturbation=("rewh",), binding=("elle",), correlation=("pour",), pathway=("sich",), up=("that",), down=("this",))
N_TERMS, TOP_N = 12, 6
fragment("lt_docs", "SELECT doc_id, source AS source_name, doc_id::VARCHAR AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents")
fragment(
    "lt_words",
    f"""SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS rk FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 4
    GROUP BY w ORDER BY rk LIMIT {N_TERMS}""",
)
fragment(
    "lt_cands",
    "SELECT a.w || '->' || b.w AS candidate_id, a.w AS source_id, b.w AS target_id, CASE a.rk % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'unknown' END AS predicted_direction, a.rk AS rk FROM lt_words a JOIN lt_words b ON b.rk = a.rk + 1 WHERE a.rk % 2 = 1",
    "lt_words",
)
fragment(
    "lt_text",
    """SELECT d.*, lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''))) AS tx, CASE doc_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'unknown' END AS predicted_direction FROM lt_docs d""",
    "lt_docs",
)


def graded_sql(source: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains(tx, '{w}')" for w in words) + ")"
    up, down = has(CUES.up), has(CUES.down)
    direction = f"CASE WHEN {up} AND NOT {down} THEN 'up' WHEN {down} AND NOT {up} THEN 'down' ELSE 'unknown' END"
    any_cue = has(CUES.perturbation + CUES.binding + CUES.correlation + CUES.pathway)
    stance = f"CASE WHEN tx = '' THEN 'unrelated' WHEN predicted_direction <> 'unknown' AND rd <> 'unknown' THEN CASE WHEN rd = predicted_direction THEN 'supports' ELSE 'contradicts' END WHEN {any_cue} THEN 'supports' ELSE 'unrelated' END"
    level = f"CASE WHEN tx = '' THEN 'N' WHEN st = 'contradicts' THEN 'X' WHEN {has(CUES.perturbation)} THEN 'A' WHEN {has(CUES.binding)} THEN 'B' WHEN {has(CUES.correlation)} THEN 'C' WHEN {has(CUES.pathway)} THEN 'D' WHEN st = 'unrelated' THEN 'N' ELSE 'D' END"
    return f"""SELECT *, {level} AS lv, CASE WHEN tx = '' THEN NULL ELSE contains(tx, 'heit') END AS same_species, CASE WHEN tx = '' OR trim(title) = '' AND title = '' THEN '{literature.ABSENCE}' ELSE trim(title) END AS sentence
      FROM (SELECT *, {stance} AS st FROM (SELECT *, {direction} AS rd FROM {source}))"""


def corpus(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("pmid"), F.lit(None).cast("string").alias("doi"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lit(None).cast("string").alias("year"), F.col("text").alias("abstract"),
    )


def corpus_candidates(spark, sf):
    """Pairs of the most frequent words: the corpus itself supplies the identifiers."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 4)
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(N_TERMS)
    ranked = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "w"))), lambda s: s["w"]).alias("ws")).select(F.posexplode("ws").alias("p", "w"))
    a = ranked.where("p % 2 = 0").select((F.col("p") + 1).alias("rk"), F.col("w").alias("source_id"))
    b = ranked.where("p % 2 = 1").select(F.col("p").alias("rk"), F.col("w").alias("target_id"))
    direction = F.when(F.col("rk") % 3 == 0, "up").when(F.col("rk") % 3 == 1, "down").otherwise("unknown")
    return a.join(b, "rk").select(F.concat_ws("->", "source_id", "target_id").alias("candidate_id"), "source_id", "target_id", direction.alias("predicted_direction"), "rk")


def _graded_docs(spark, sf):
    k = F.col("doc_id") % 3
    docs = corpus(spark, sf).withColumn("predicted_direction", F.when(k == 0, "up").when(k == 1, "down").otherwise("unknown"))
    return literature.grade(docs, CUES, organism="Heit")


@query("lit_direction", with_query(f"SELECT doc_id, rd AS relation_direction FROM ({graded_sql('lt_text')})", "lt_text"))
def lit_direction(spark, sf):
    return _graded_docs(spark, sf).select("doc_id", "relation_direction")


@query(
    "lit_stance_level",
    with_query(f"SELECT doc_id, st AS stance, lv AS evidence_level, same_species, sentence AS evidence_sentence FROM ({graded_sql('lt_text')})", "lt_text"),
)
def lit_stance_level(spark, sf):
    return _graded_docs(spark, sf).select("doc_id", "stance", "evidence_level", "same_species", "evidence_sentence")


@query(
    "lit_dedupe",
    """SELECT source AS source_name, doc_id, md5(text) AS doi FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def lit_dedupe(spark, sf):
    hits = corpus(spark, sf).withColumns({"pmid": F.lit(None).cast("string"), "doi": F.md5("abstract")})
    return literature.first_hits(hits, [], ["source_name", "doc_id"]).select("source_name", "doc_id", "doi")


@query(
    "lit_query",
    with_query("SELECT candidate_id, '(' || source_id || ') AND (' || target_id || ') AND (regulat* OR bind* OR interact* OR phosphorylat*) AND (human)' AS query_string FROM lt_cands", "lt_cands"),
)
def lit_query(spark, sf):
    cands = corpus_candidates(spark, sf)
    return cands.select("candidate_id", text_fns.search_query(F.col("source_id"), F.col("target_id"), organism="human").alias("query_string"))


fragment(
    "lt_match",
    """SELECT d.doc_id, d.source_name, d.pmid, d.title, d.abstract, lower(concat_ws(' ', nullif(d.title, ''), nullif(d.abstract, ''))) AS tx, c.candidate_id, c.source_id, c.target_id, c.predicted_direction
    FROM lt_docs d JOIN lt_cands c ON contains(lower(concat_ws(' ', nullif(d.title, ''), nullif(d.abstract, ''))), c.source_id) AND contains(lower(concat_ws(' ', nullif(d.title, ''), nullif(d.abstract, ''))), c.target_id)""",
    "lt_docs", "lt_cands",
)


@query("lit_match", with_query("SELECT doc_id, candidate_id, predicted_direction FROM lt_match", "lt_match"))
def lit_match(spark, sf):
    hits = literature.match_corpus(corpus(spark, sf), corpus_candidates(spark, sf), TOP_N, ["rk"])
    return hits.select("doc_id", "candidate_id", "predicted_direction")


MAX_HITS = 5


@query(
    "lit_evidence",
    with_query(
        f"""SELECT c.candidate_id, coalesce(g.source_name, 'pubmed_eutils') AS source_name, g.pmid, coalesce(g.pmid_ok, false) AS pmid_authentic,
          CASE WHEN coalesce(g.pmid_ok, false) THEN g.st ELSE 'unrelated' END AS stance, CASE WHEN coalesce(g.pmid_ok, false) THEN g.lv ELSE 'N' END AS evidence_level,
          CASE WHEN coalesce(g.pmid_ok, false) THEN g.sentence ELSE '{literature.ABSENCE}' END AS evidence_sentence, 'needs_review' AS reviewer_status
        FROM lt_cands c LEFT JOIN (SELECT *, pmid IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1) AS pmid_ok FROM ({graded_sql('(SELECT *, row_number() OVER (PARTITION BY candidate_id, source_name ORDER BY doc_id) AS hit FROM lt_match)')}) WHERE hit <= {MAX_HITS}) g USING (candidate_id)""",
        "lt_cands", "lt_match",
    ),
)
def lit_evidence(spark, sf):
    """Match, cap per source, dedupe, verify against a bibliography, grade, and fail closed."""
    cands = stage(corpus_candidates(spark, sf), "literature-candidates")
    hits = literature.match_corpus(corpus(spark, sf), cands, TOP_N, ["rk"])
    capped = literature.capped_hits(hits, ["candidate_id", "source_name"], ["doc_id"], MAX_HITS).withColumn("source_rank", literature.source_rank(F.col("source_name")))
    unique = literature.first_hits(capped, ["candidate_id"], ["source_rank", "doc_id"])
    docs = corpus(spark, sf)
    trusted = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    bibliography = docs.join(trusted, "doc_id").select("pmid", "title", "doi")
    graded = literature.fail_closed(literature.grade(literature.verify_ids(unique, bibliography), CUES, organism="Heit"))
    out = literature.evidence_table(cands, graded, searched_at="2024-01-01T00:00:00+00:00")
    return out.select("candidate_id", "source_name", "pmid", "pmid_authentic", "stance", "evidence_level", "evidence_sentence", "reviewer_status")


def bibliography_payloads(spark, sf):
    """One bibliography response per document, in both layouts."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("pmid"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    doi = F.concat(F.lit("10.1000/"), "pmid")
    record = F.struct(F.col("pmid").alias("uid"), F.concat(F.lit("doi: "), doi).alias("elocationid"), "title", F.lit("2021 Mar").alias("pubdate"))
    listed = F.struct("pmid", doi.alias("doi"), "title", F.lit("2020").alias("pubYear"), F.col("text").alias("abstractText"))
    keyed = F.to_json(F.struct(F.create_map("pmid", record).alias("result")))
    search = F.to_json(F.struct(F.struct(F.array(listed).alias("result")).alias("resultList")))
    return docs.select("doc_id", "lang", keyed.alias("keyed"), search.alias("listed"))


@query(
    "lit_landed_hits",
    """SELECT doc_id, 'pubmed_eutils' AS source_name, doc_id::VARCHAR AS pmid, '10.1000/' || doc_id::VARCHAR AS doi, nullif(split_part(text, chr(10), 1), '') AS title, '2021' AS year, NULL AS abstract FROM documents
    UNION ALL SELECT doc_id, 'europepmc', doc_id::VARCHAR, '10.1000/' || doc_id::VARCHAR, nullif(split_part(text, chr(10), 1), ''), '2020', nullif(text, '') FROM documents""",
)
def lit_landed_hits(spark, sf):
    payloads = bibliography_payloads(spark, sf)
    return landed.summary_hits(payloads, "keyed", ["doc_id"]).unionByName(landed.result_list_hits(payloads, "listed", ["doc_id"]))


# Fingerprints.
def fingerprint_sql(name: str, source: str, columns: dict[str, str]) -> str:
    """``columns`` maps each column to its canonical text expression."""
    ordered = sorted(columns)
    text = " || '|' || ".join(f"coalesce(length({columns[c]})::VARCHAR || ':' || {columns[c]}, '~')" for c in ordered)
    words = [f"('0x' || substr(h, {start}, 15))::BIGINT" for start in (1, 16, 31, 46)]
    sums = [f"coalesce(sum({w}), 0)::VARCHAR" for v in words for w in (f"({v} >> 40)", f"(({v} >> 20) & 1048575)", f"({v} & 1048575)")]
    return f"""SELECT '{name}' AS name, count(*) AS n_rows, sha256(concat_ws('|', '{','.join(ordered)}', count(*)::VARCHAR, {', '.join(sums)})) AS digest
      FROM (SELECT sha256({text}) AS h FROM {source})"""


_TEXT, _INT = "{c}", "{c}::VARCHAR"
_NUM = "CASE WHEN isnan({c}) THEN 'nan' WHEN isinf({c}) THEN CASE WHEN {c} > 0 THEN 'inf' ELSE '-inf' END ELSE printf('%.9e', CASE WHEN {c} = 0 THEN 0.0 ELSE {c}::DOUBLE * (1 + pow(2, -40)) END) END"
_TIME = "epoch_us({c})::VARCHAR"
_VECTOR = "'[' || array_to_string(list_transform({c}, lambda v: printf('%.9e', CASE WHEN v = 0 THEN 0.0 ELSE v::DOUBLE * (1 + pow(2, -40)) END)), ',') || ']'"
# All columns of the tables, with the form of their text.
FP_KINDS = {
    "region": {"r_regionkey": _INT, "r_name": _TEXT},
    "nation": {"n_nationkey": _INT, "n_name": _TEXT, "n_regionkey": _INT},
    "customer": {"c_custkey": _INT, "c_name": _TEXT, "c_nationkey": _INT, "c_acctbal": _NUM, "c_mktsegment": _TEXT},
    "supplier": {"s_suppkey": _INT, "s_name": _TEXT, "s_nationkey": _INT, "s_acctbal": _NUM},
    "part": {"p_partkey": _INT, "p_name": _TEXT, "p_brand": _TEXT, "p_type": _TEXT, "p_size": _INT, "p_retailprice": _NUM},
    "orders": {"o_orderkey": _INT, "o_custkey": _INT, "o_orderstatus": _TEXT, "o_totalprice": _NUM, "o_orderdate": _TIME, "o_orderpriority": _TEXT},
    "lineitem": {
        "l_orderkey": _INT, "l_partkey": _INT, "l_suppkey": _INT, "l_linenumber": _INT, "l_quantity": _NUM, "l_extendedprice": _NUM,
        "l_discount": _NUM, "l_tax": _NUM, "l_returnflag": _TEXT, "l_linestatus": _TEXT, "l_shipdate": _TIME,
    },
    "events": {"event_id": _INT, "ts": _TIME, "user_id": _INT, "event_type": _TEXT, "value": _NUM, "props": _TEXT},
    "documents": {"doc_id": _INT, "text": _TEXT, "lang": _TEXT, "source": _TEXT, "n_chars": _INT},
    "embeddings": {"vec_id": _INT, "embedding": _VECTOR, "label": _INT},
    "pages": {"page_id": _INT, "url": _TEXT, "html": _TEXT},
    "benchmark": {"item_id": _INT, "text": _TEXT},
    "labels": {"doc_id": _INT, "quality": _INT, "toxic": _INT},
    "conversations": {"conv_id": _INT, "turn": _INT, "role": _TEXT, "text": _TEXT},
}
FP_COLUMNS = {name: {c: form.format(c=c) for c, form in columns.items()} for name, columns in FP_KINDS.items()}
FP_SQL = " UNION ALL ".join(fingerprint_sql(n, n, c) for n, c in FP_COLUMNS.items())


def _fingerprints(spark, sf):
    parts = [fingerprint.fingerprint(table(spark, sf, n), n) for n in FP_COLUMNS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("table_fingerprint", FP_SQL)
def table_fingerprint(spark, sf):
    return _fingerprints(spark, sf)


@query(
    "fingerprint_diff",
    """SELECT 'customer' AS name, 'changed' AS status FROM customer WHERE c_custkey = 3 AND c_name <> 'x' UNION ALL SELECT 'lineitem', 'changed' FROM (SELECT 1 FROM lineitem WHERE l_linenumber = 2 LIMIT 1)
    UNION ALL SELECT * FROM (VALUES ('documents', 'missing'), ('regions', 'extra')) t(name, status)""",
)
def fingerprint_diff(spark, sf):
    """The frozen tables against ones with a changed name, changed dates, a missing table and an extra one."""
    frozen = stage(_fingerprints(spark, sf), "frozen-fingerprints")  # a row a table, read twice
    later = table(spark, sf, "lineitem").withColumn("l_shipdate", F.when(F.col("l_linenumber") == 2, F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("l_shipdate")))
    changed = table(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") == 3, "x").otherwise(F.col("c_name")))
    same = frozen.where("name NOT IN ('lineitem', 'customer', 'documents')")
    current = reduce(lambda a, b: a.unionByName(b), [same, fingerprint.fingerprint(changed, "customer"), fingerprint.fingerprint(later, "lineitem"), fingerprint.fingerprint(table(spark, sf, "region"), "regions")])
    return fingerprint.fingerprint_diff(frozen, current)


fragment("rh_tables", FP_SQL)
fragment("rh_split", fingerprint_sql("split", "p1_units", {"unit": "unit", "split": "split"}), "p1_units")


@query(
    "run_hashes",
    with_query(
        f"""SELECT 'data_hash.' || name AS name, digest FROM rh_tables UNION ALL SELECT 'data_hash', sha256(string_agg(name || '=' || digest, '|' ORDER BY name || '=' || digest)) FROM rh_tables
        UNION ALL SELECT 'split_hash', digest FROM rh_split UNION ALL SELECT 'config_hash', '{fingerprint.config_hash({"alpha": 1.0, "seed": 7})}' UNION ALL SELECT 'seed', '7'""",
        "rh_tables", "rh_split",
    )
)
def run_hashes(spark, sf):
    units = event_study(spark, sf).observations.select(F.col("experimental_unit_id").alias("unit"), "split").distinct()
    return fingerprint.run_hashes(_fingerprints(spark, sf), fingerprint.fingerprint(units, "split"), {"alpha": 1.0, "seed": 7}, 7)


@query(
    "metric_rows",
    f"""SELECT c_mktsegment, metric, {r6('v', 'value')}, v IS NOT NULL AS written FROM (SELECT c_mktsegment, unnest(['mean', 'spread', 'debit']) AS metric, unnest([avg(c_acctbal), stddev_pop(c_acctbal), min(CASE WHEN c_mktsegment < 'C' THEN c_acctbal END)]) AS v FROM customer GROUP BY 1)""",
)
def metric_rows(spark, sf):
    report = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.avg("c_acctbal").alias("mean"), F.stddev_pop("c_acctbal").alias("spread"), F.min(F.when(F.col("c_mktsegment") < "C", F.col("c_acctbal"))).alias("debit")
    )
    return sinks.metric_rows(report, ["c_mktsegment"], ["mean", "spread", "debit"]).withColumn("value", rounded(F.col("value")))
