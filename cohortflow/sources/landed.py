"""Parsers of landed repository and bibliography responses held as JSON or HTML text.

Each parser takes one response per row and explodes it; nothing leaves the row it came from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.text import doi_from_text, year_prefix
from cohortflow.session import stage
from cohortflow.sources.files import file_role

# Categories of raw proteomics files, and the public file endpoint.
RAW_CATEGORIES = ["RAW", "PEAK", "SPECTRUM", "MS_RAW"]
STUDY_FILES = "https://www.ebi.ac.uk/biostudies/files"


def _json(node: Column | str, path: str) -> Column:
    """Value at a JSON path; empty text counts as absent."""
    value = F.get_json_object(node, path)
    return F.when(value != "", value)


def _is_list(text: Column) -> Column:
    return F.startswith(F.trim(text), F.lit("["))


def _items(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def project_files(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Proteomics project listing: a list, ``_embedded.files``, ``_embedded`` or ``files``."""
    text = F.col(payload)
    embedded = F.get_json_object(text, "$._embedded")
    nested = F.get_json_object(text, "$._embedded.files")
    files = F.get_json_object(text, "$.files")
    listing = (
        F.when(_is_list(text), text)
        .when(embedded.isNotNull() & _is_list(embedded), embedded)
        .when(nested.isNotNull() & _is_list(nested), nested)
        .when(embedded.isNull() & files.isNotNull() & _is_list(files), files)
    )
    rows = df.select(*keep, F.explode(_items(listing)).alias("f")).where(F.startswith("f", F.lit("{")))
    name = F.coalesce(_json("f", "$.fileName"), _json("f", "$.filename"))
    category = F.upper(F.coalesce(_json("f", "$.fileCategory"), _json("f", "$.category"), F.lit("")))
    sha = _json("f", "$.sha256")
    other = F.coalesce(_json("f", "$.checksum"), _json("f", "$.md5"))
    size = F.coalesce(_json("f", "$.fileSizeBytes"), _json("f", "$.fileSize"))
    link = F.coalesce(_json("f", "$.downloadLink"), _json("f", "$.ftpLocation"), _json("f", "$.publicFileLocations"))
    first = F.get(_items(link), F.lit(0))
    url = F.when(_is_list(link), F.when(F.startswith(first, F.lit("{")), F.get_json_object(first, "$.value")).otherwise(first)).otherwise(link)
    return rows.select(*keep, name.alias("filename"), category.alias("category"), sha.alias("_sha"), other.alias("_other"), size.alias("_size"), url.alias("_url")).where("filename IS NOT NULL").select(
        *keep, "filename",
        F.when(F.col("category").isin(RAW_CATEGORIES), "rejected_raw").otherwise(file_role(F.col("filename"))).alias("role"),
        F.when(F.col("_url").rlike("^http"), F.col("_url")).alias("url"),
        F.when(F.col("_size").rlike(r"^\d+$"), F.col("_size").try_cast("bigint")).alias("size_bytes"),
        F.coalesce("_sha", "_other").alias("official_checksum"),
        F.when(F.col("_sha").isNotNull(), "sha256").when(F.col("_other").isNotNull(), "md5").alias("official_checksum_alg"),
    )


#: Levels walked in one pass over the responses; deeper nodes take another pass.
LEVELS = 8


def _children(parent: Column) -> Column:
    """Containers directly inside a node, each with the path of positions that leads to it."""
    as_map = F.map_values(F.from_json(parent["node"], "map<string,string>"))
    inner = F.when(_is_list(parent["node"]), _items(parent["node"])).otherwise(as_map)
    placed = F.transform(inner, lambda c, i: F.struct(F.concat(parent["path"], F.array(i)).alias("path"), c.alias("node")))
    return F.coalesce(F.filter(placed, lambda c: c["node"].rlike(r"^\s*[\[{]")), F.array().cast("array<struct<path:array<int>,node:string>>"))


def json_nodes(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Every object of a nested response, at any depth, one row each.

    ``node_order`` is the path of positions from the root; paths sort in document order, an object
    before what it holds. Eight levels are walked within the row; only if some response goes deeper is
    what is left below them written and walked on.
    """
    start = F.struct(F.array().cast("array<int>").alias("path"), F.col(payload).alias("node"))
    rows, parts = df.select(*keep, F.array(start).alias("l0")), []
    while True:
        for d in range(LEVELS):
            rows = rows.withColumn(f"l{d + 1}", F.flatten(F.transform(f"l{d}", _children)))
        parts.append(rows.select(*keep, F.explode(F.concat(*[f"l{d}" for d in range(LEVELS)])).alias("n")))
        deeper = rows.where(F.size(f"l{LEVELS}") > 0)
        if deeper.isEmpty():
            break
        rows = stage(deeper.select(*keep, F.col(f"l{LEVELS}").alias("l0")), "json-nodes")
    nodes = reduce(lambda a, b: a.unionByName(b), parts).select(*keep, F.col("n.path").alias("node_order"), F.col("n.node").alias("node"))
    return nodes.where(F.col("node").rlike(r"^\s*\{"))


def study_attributes(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Attribute name (trimmed, lower case) to value; the last one wins."""
    rows = nodes.select(*keep, "node_order", F.posexplode(_items(F.get_json_object("node", "$.attributes"))).alias("at", "a"))
    named = rows.select(*keep, "node_order", "at", F.lower(F.trim(F.get_json_object("a", "$.name"))).alias("name"), F.get_json_object("a", "$.value").alias("value"))
    return named.where("name IS NOT NULL AND value IS NOT NULL").groupBy(*keep, "name").agg(F.max_by("value", F.struct("node_order", "at")).alias("value"))


def study_files(nodes: DataFrame, accession: str, keep: list[str]) -> DataFrame:
    """File nodes of a study: a ``path``, or a ``name`` with ``size`` or ``type``."""
    path, name = _json("node", "$.path"), _json("node", "$.name")
    size_text, kind = F.get_json_object("node", "$.size"), F.get_json_object("node", "$.type")
    where = F.coalesce(path, F.when(size_text.isNotNull() | kind.isNotNull(), name))
    attributes = F.transform(
        F.coalesce(_items(F.get_json_object("node", "$.attributes")), F.array().cast("array<string>")),
        lambda a: F.struct(F.lower(F.get_json_object(a, "$.name")).alias("n"), F.get_json_object(a, "$.value").alias("v")),
    )

    def attribute(label: str) -> Column:
        hit = F.filter(attributes, lambda a: (a["n"] == label) & (a["v"] != ""))
        return F.try_element_at(hit, F.lit(-1))["v"]

    own_sha, own_md5 = F.trim(_json("node", "$.sha256")), F.trim(_json("node", "$.md5"))
    size = F.coalesce(_json("node", "$.size"), _json("node", "$.sizeInBytes"))
    sha = F.when(own_sha.isNotNull(), own_sha).when(own_md5.isNull(), attribute("sha256"))
    md5 = F.when(own_sha.isNull(), F.coalesce(own_md5, F.when(sha.isNull(), attribute("md5"))))
    rows = nodes.select(
        *keep, F.col(accession).alias("_acc"), where.alias("_where"), path.alias("_path"), size.alias("_size"), sha.alias("_sha"), md5.alias("_md5")
    ).where("_where IS NOT NULL").withColumn("filename", F.regexp_extract("_where", r"([^/]*)$", 1)).where("filename <> ''")
    rel = F.regexp_replace(F.coalesce("_path", "filename"), "^/+", "")
    return rows.select(
        *keep, "filename", file_role(F.col("filename")).alias("role"), F.concat_ws("/", F.lit(STUDY_FILES), "_acc", rel).alias("url"),
        F.when(F.col("_size").rlike(r"^\d+$"), F.col("_size").try_cast("bigint")).alias("size_bytes"),
        F.coalesce("_sha", "_md5").alias("official_checksum"),
        F.when(F.col("_sha").isNotNull(), "sha256").when(F.col("_md5").isNotNull(), "md5").alias("official_checksum_alg"),
    )


HREF = r'<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*"([^"]+)"'


def listing_links(df: DataFrame, html: str, base: str, keep: list[str]) -> DataFrame:
    """File names linked from a directory listing, with role and absolute URL."""
    links = df.select(*keep, F.col(base).alias("_base"), F.explode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("href"))
    name = F.regexp_extract(F.replace("href", F.lit("&amp;"), F.lit("&")), r"([^/]*)$", 1)
    named = links.withColumn("filename", name).where(~F.col("filename").isin("", "index.html", ".."))
    folder = F.regexp_replace("_base", r"[^/]*$", "")
    return named.select(*keep, "filename", file_role(F.col("filename")).alias("role"), F.concat(folder, "filename").alias("url"))


def search_uids(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(_items(F.get_json_object(payload, "$.esearchresult.idlist"))).alias("uid"))


def series_summary(df: DataFrame, payload: str, uid: str, accession: str, keep: list[str]) -> DataFrame:
    """Title, organism and abstract of a series summary with their defaults."""
    records = F.from_json(F.get_json_object(payload, "$.result"), "map<string,string>")
    rows = df.select(*keep, F.col(accession).alias("_acc"), F.try_element_at(records, F.col(uid)).alias("rec"))
    return rows.select(
        *keep,
        F.coalesce(_json("rec", "$.title"), F.concat(F.lit("GEO "), "_acc")).alias("title"),
        F.coalesce(_json("rec", "$.taxon"), F.lit("undeclared")).alias("organism"),
        F.coalesce(_json("rec", "$.summary"), F.lit("")).alias("abstract"),
    )


def summary_hits(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Bibliography summary response (``result`` keyed by id) to hits."""
    records = F.from_json(F.get_json_object(payload, "$.result"), "map<string,string>")
    rows = df.select(*keep, F.explode(records).alias("uid", "rec")).where(F.startswith("rec", F.lit("{")))
    return rows.select(
        *keep, F.lit("pubmed_eutils").alias("source_name"), F.coalesce(_json("rec", "$.uid"), F.col("uid")).alias("pmid"),
        doi_from_text(F.get_json_object("rec", "$.elocationid")).alias("doi"), _json("rec", "$.title").alias("title"),
        year_prefix(F.get_json_object("rec", "$.pubdate")).alias("year"), F.lit(None).cast("string").alias("abstract"),
    )


def result_list_hits(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Bibliography search response (``resultList.result``) to hits."""
    rows = df.select(*keep, F.explode(_items(F.get_json_object(payload, "$.resultList.result"))).alias("rec")).where(F.startswith("rec", F.lit("{")))
    return rows.select(
        *keep, F.lit("europepmc").alias("source_name"), _json("rec", "$.pmid").alias("pmid"), _json("rec", "$.doi").alias("doi"),
        _json("rec", "$.title").alias("title"), _json("rec", "$.pubYear").alias("year"), _json("rec", "$.abstractText").alias("abstract"),
    )
