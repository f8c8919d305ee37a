"""Grading of landed literature text against candidate relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.hashing import digest_int
from cohortflow.functions.text import contains_any, mentions, search_query, squeeze, well_formed_doi, well_formed_pmid

# Cue words and the phrase for an empty search.
ABSENCE = "在本次检索范围内未找到直接证据"
SPLIT_WAYS = 64


@dataclass(frozen=True)
class CueWords:
    perturbation: tuple[str, ...] = ("knockout", "knock-out", "crispr", "overexpress", "perturbation", "causal")
    binding: tuple[str, ...] = ("bind", "chip-seq", "co-ip", "physical interaction", "pull-down")
    correlation: tuple[str, ...] = ("correlat", "co-express", "associated with", "coexpression")
    pathway: tuple[str, ...] = ("pathway", "reactome", "string")
    up: tuple[str, ...] = ("activate", "induce", "up-regulate", "upregulate", "increase")
    down: tuple[str, ...] = ("inhibit", "repress", "down-regulate", "downregulate", "decrease")


def hit_text(title: str = "title", abstract: str = "abstract") -> Column:
    """Lower-cased title and abstract; empty parts are skipped."""
    part = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.lower(F.concat_ws(" ", part(title), part(abstract)))


def grade(hits: DataFrame, words: CueWords = CueWords(), organism=None, tissue=None, condition=None) -> DataFrame:
    """Add reported direction, stance, evidence level, sentence and context flags.

    ``hits`` carry ``title``, ``abstract`` and ``predicted_direction`` (up, down, unknown).
    """
    rows = hits.withColumn("_text", hit_text())
    text = F.col("_text")
    flags = {f"_{name}": contains_any(text, getattr(words, name)) for name in ("up", "down", "perturbation", "binding", "correlation", "pathway")}
    rows = rows.withColumns(flags)
    up, down = F.col("_up"), F.col("_down")
    rows = rows.withColumn("relation_direction", F.when(up & ~down, "up").when(down & ~up, "down").otherwise("unknown"))
    any_cue = F.col("_perturbation") | F.col("_binding") | F.col("_correlation") | F.col("_pathway")
    both_known = (F.col("predicted_direction") != "unknown") & (F.col("relation_direction") != "unknown")
    empty = text == ""
    stance = (
        F.when(empty, "unrelated")
        .when(both_known, F.when(F.col("relation_direction") == F.col("predicted_direction"), "supports").otherwise("contradicts"))
        .when(any_cue, "supports")
        .otherwise("unrelated")
    )
    rows = rows.withColumn("stance", stance)
    level = (
        F.when(empty, "N")
        .when(F.col("stance") == "contradicts", "X")
        .when(F.col("_perturbation"), "A")
        .when(F.col("_binding"), "B")
        .when(F.col("_correlation"), "C")
        .when(F.col("_pathway"), "D")
        .when(F.col("stance") == "unrelated", "N")
        .otherwise("D")
    )
    context = {"same_species": organism, "same_tissue": tissue, "same_condition": condition}
    none = F.lit(None).cast("boolean")
    rows = rows.withColumns(
        {
            "evidence_level": level,
            "evidence_sentence": F.when(empty, ABSENCE).otherwise(F.trim(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(ABSENCE)))),
            **{name: F.when(empty, none).otherwise(mentions(text, needle)) for name, needle in context.items()},
        }
    )
    return rows.drop("_text", *flags)


# The sources in order of trust; others follow by name.
SOURCES = ["pubmed_eutils", "europepmc"]


def source_rank(name: Column) -> Column:
    """Sorts a hit's source: the trusted ones first, in their order."""
    at = F.array_position(F.array(*map(F.lit, SOURCES)), name)
    return F.struct(F.when(at > 0, at).otherwise(len(SOURCES) + 1).alias("rank"), name.alias("name"))


def first_hits(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First hit per id: PMID, else DOI, else source and title. The smallest ``order`` wins."""
    present = lambda c: F.when(F.col(c) != "", F.col(c))
    key = F.coalesce(present("pmid"), present("doi"), F.concat_ws(":", "source_name", F.coalesce("title", F.lit("None"))))
    rest = [c for c in hits.columns if c not in keys]
    return (
        hits.withColumn("_key", key).groupBy(*keys, "_key")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    )


def capped_hits(hits: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """First ``limit`` hits per key. Each of many slices is cut first, so a term found in most of
    the corpus is ranked in parts and only ``slices x limit`` rows meet in the final ranking."""
    salt = digest_int(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order]))) % SPLIT_WAYS
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = hits.withColumn("_salt", salt).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= limit)
    return cut.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= limit).drop("_r", "_salt")


def verify_ids(hits: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Identity checks: a PMID is authentic if the bibliography has it and the titles agree; a DOI
    only if the PMID is authentic, it is well formed, and the bibliography does not contradict it."""
    bib = bibliography.select(F.col("pmid").alias("_pmid"), F.col("title").alias("_title"), F.col("doi").alias("_doi"))
    joined = hits.join(bib, F.trim("pmid") == F.col("_pmid"), "left")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    titles = ~(has("title") & has("_title")) | (squeeze(F.col("title")) == squeeze(F.col("_title")))
    pmid_ok = well_formed_pmid(F.col("pmid")) & F.col("_pmid").isNotNull() & titles
    doi_ok = F.col("pmid_authentic") & well_formed_doi(F.col("doi")) & (F.col("_doi").isNull() | (squeeze(F.col("doi")) == squeeze(F.col("_doi"))))
    return joined.withColumn("pmid_authentic", F.coalesce(pmid_ok, F.lit(False))).withColumn("doi_authentic", F.coalesce(doi_ok, F.lit(False))).drop("_pmid", "_title", "_doi")


def fail_closed(graded: DataFrame) -> DataFrame:
    """Without a verified id a row is unrelated, level N, with the absence phrase."""
    bad = ~F.col("pmid_authentic") & ~F.col("doi_authentic")
    return graded.withColumns(
        {
            "stance": F.when(bad, "unrelated").otherwise(F.col("stance")),
            "evidence_level": F.when(bad, "N").otherwise(F.col("evidence_level")),
            "evidence_sentence": F.when(bad, ABSENCE).otherwise(F.col("evidence_sentence")),
        }
    )


def match_corpus(corpus: DataFrame, candidates: DataFrame, top_n: int, order: list) -> DataFrame:
    """Corpus rows that name both ends of a candidate.

    At most ``top_n`` (a report setting of at most 50) stable candidates ride along as one array,
    so the corpus is scanned once and no row pairs are built.
    """
    if not 1 <= top_n <= 50:
        raise ValueError("top_n is between 1 and 50")
    top = candidates.orderBy(*order).limit(top_n)
    fields = ["candidate_id", "source_id", "target_id", "predicted_direction"]
    packed = top.agg(F.collect_list(F.struct(*fields)).alias("_c"))
    rows = corpus.withColumns({"_text": hit_text(), "_c": packed.scalar()})
    hit = F.filter("_c", lambda c: F.contains(F.col("_text"), F.lower(c["source_id"])) & F.contains(F.col("_text"), F.lower(c["target_id"])))
    return rows.withColumn("_m", F.explode(hit)).select(*[c for c in corpus.columns], "_m.*")


def evidence_table(candidates: DataFrame, graded: DataFrame, organism=None, tissue=None, condition=None, searched_at: str | None = None) -> DataFrame:
    """Graded hits plus an explicit N record for a candidate without one; always needs review."""
    fields = ["candidate_id", "source_id", "target_id", "predicted_direction"]
    hit_columns = [
        "source_name", "pmid", "doi", "title", "year", "evidence_sentence", "relation_direction", "same_species", "same_tissue",
        "same_condition", "stance", "evidence_level", "pmid_authentic", "doi_authentic",
    ]
    joined = candidates.select(*fields).join(graded.select("candidate_id", *hit_columns), "candidate_id", "left")
    when = F.lit(searched_at) if searched_at else F.current_timestamp().cast("string")
    defaults = {
        "source_name": "pubmed_eutils", "evidence_sentence": ABSENCE, "relation_direction": "unknown", "stance": "unrelated", "evidence_level": "N",
    }
    return joined.withColumns(
        {
            **{name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()},
            "pmid_authentic": F.coalesce("pmid_authentic", F.lit(False)), "doi_authentic": F.coalesce("doi_authentic", F.lit(False)),
            "query_string": search_query(F.col("source_id"), F.col("target_id"), organism, tissue, condition),
            "searched_at": when, "reviewer_status": F.lit("needs_review"), "claim_kind": F.lit("hypothesis"),
        }
    )
