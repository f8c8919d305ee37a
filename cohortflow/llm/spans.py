"""Positions of regular-expression matches, in columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters kept before and after a match.
BEFORE, AFTER = 24, 12
#: Numbers per block of a running total, so that its work is n * WIDTH and not n * n.
WIDTH = 128

MATCHES = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def matches(text: Column, pattern: str, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as start, end, text and surroundings; code points, end exclusive.

    The text is cut at its matches; the lengths of the pieces and of the matches give the positions.
    Rows where ``when`` is not true, and null texts, give an empty array. The pattern must not match
    the empty string; Java's syntax holds.
    """
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    found = bind(both, _positions)
    test = text.isNotNull() if when is None else text.isNotNull() & when
    return F.when(test, found).otherwise(F.array().cast(MATCHES))


def _positions(x: Column) -> Column:
    gaps, hits = x["gaps"], x["hits"]
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

    def at(ends: Column) -> Column:
        return F.transform(
            hits,
            lambda h, i: F.struct(
                (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("text"),
                F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    return F.when(F.size(hits) > 0, bind(running(sizes), at)).otherwise(F.array().cast(MATCHES))


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, b: a + b)


def running(numbers: Column, fold: Callable[[Column], Column] = _total, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running totals (or another fold, 0 for nothing) of an array of whole numbers, 0 or more, by blocks of WIDTH."""

    def total(part: Column) -> Column:
        return F.coalesce(fold(part), F.lit(0))

    def ends(x: Column) -> Column:
        values = x["values"]
        return F.transform(values, lambda _, i: join(F.get(x["before"], (i / WIDTH).cast("int")), total(F.slice(values, (i / WIDTH).cast("int") * WIDTH + 1, i % WIDTH + 1))))

    def with_before(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(values) / WIDTH).cast("int")), lambda b: total(F.slice(values, b * WIDTH + 1, WIDTH)))
        before = bind(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))))
        return F.struct(values.alias("values"), before.alias("before"))

    return bind(bind(numbers, with_before), ends)


#: Spans of a page, and pages of a book.
PAGE = 64


def _cut(items: Column) -> Column:
    whole = F.transform(F.sequence(F.lit(0), F.greatest(((F.size(items) - 1) / PAGE).cast("int"), F.lit(0))), lambda b: F.slice(items, b * PAGE + 1, PAGE))
    return F.filter(whole, lambda part: F.size(part) > 0)


def paged(ordered: Column) -> Column:
    """Spans, in order and without overlaps, as books of pages, for ``overlaps``."""
    return bind(bind(ordered, _cut), _cut)


def overlaps(books: Column, c: Column) -> Column:
    """Whether a span overlaps one of the paged spans; only books and pages that reach into it are opened."""

    def meets(first: Column, last: Column) -> Column:
        return (first["start"] < c["end"]) & (c["start"] < last["end"])

    def on_page(page: Column) -> Column:
        return meets(F.get(page, F.lit(0)), F.element_at(page, -1)) & F.exists(page, lambda s: meets(s, s))

    def in_book(book: Column) -> Column:
        return meets(F.get(F.get(book, F.lit(0)), F.lit(0)), F.element_at(F.element_at(book, -1), -1)) & F.exists(book, on_page)

    return F.exists(books, in_book)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def label(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of spans (kind, start, end), by start and then kind as listed, comma-joined."""
    order = F.array(*map(F.lit, kinds))
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def named(found: Column, kind: str) -> Column:
    """Spans (kind, start, end) of matches."""
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def fitting(found: Column, pattern: str) -> Column:
    """Matches whose text holds the pattern."""
    return F.filter(found, lambda m: m["text"].rlike(pattern))


def count(found: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
