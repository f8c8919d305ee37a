"""Text predicates used by the catalog and literature operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier formats.
DOI_PATTERN = r"^10\.\d{4,9}/\S+$"
PMID_PATTERN = r"^\d{1,12}$"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def squeeze(text: Column) -> Column:
    """Collapse whitespace, trim, lower-case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def well_formed_doi(col: Column) -> Column:
    return F.coalesce(F.trim(col).rlike(DOI_PATTERN), F.lit(False))


def well_formed_pmid(col: Column) -> Column:
    return F.coalesce(F.trim(col).rlike(PMID_PATTERN), F.lit(False))


def mentions(text: Column, needle: str | None) -> Column:
    """NULL when no needle is configured, else whether the lower-cased text holds it."""
    if not needle:
        return F.lit(None).cast("boolean")
    return F.contains(text, F.lit(needle.lower()))


def doi_from_text(col: Column) -> Column:
    """From the first ``10.`` to the end, trimmed; NULL when absent."""
    at = F.locate("10.", col)
    tail = F.trim(F.substr(col, at, F.length(col)))
    return F.when((at > 0) & (tail != ""), tail)


def year_prefix(col: Column) -> Column:
    trimmed = F.trim(col)
    return F.when(trimmed.rlike(r"^\d{4}"), F.substring(trimmed, 1, 4))


def search_query(source: Column, target: Column, organism=None, tissue=None, condition=None) -> Column:
    """Deterministic search string; unset context terms are left out."""
    parts = [
        F.concat(F.lit("("), source, F.lit(")")),
        F.concat(F.lit("("), target, F.lit(")")),
        F.lit("(regulat* OR bind* OR interact* OR phosphorylat*)"),
    ]
    parts += [F.lit(f"({term})") for term in (organism, tissue, condition) if term]
    return F.concat_ws(" AND ", *parts)
