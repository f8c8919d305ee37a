"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold. The index
lists, for every trigram that some rule asks for, the documents that hold it. A rule's expression then
runs only over documents whose postings satisfy its query; a rule without mandatory trigrams runs over
all. The expressions decide, so the index never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import spans
from cohortflow.session import stage

#: Exact strings followed at a time while a query is derived, and the widest character set spelt out.
MAX_EXACT, MAX_SET = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and how to keep a match (``m["text"]``); None keeps all."""

    name: str
    pattern: str
    keep: str | None = None


#: The three base kinds. A kept match satisfies the second expression as a whole.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$"),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    Rule("hex", r"[0-9a-f]{24,}+"),
)
#: Published formats of further credentials.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

Query = frozenset[frozenset[str]]
#: Satisfied by any text.
ANY: Query = frozenset([frozenset()])


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams; every match holds all of at least one set. {{}} if nothing is mandatory."""
    return _query(list(parser.parse(pattern)))


def _query(sequence: Iterable) -> Query:
    out, exact = ANY, {""}
    for node in sequence:
        strings = _strings(node)
        if strings is not None and len(exact) * len(strings) <= MAX_EXACT:
            exact = {a + b for a in exact for b in strings}
            continue
        out = _both(out, _grams(exact))
        exact = strings if strings is not None else {""}
        if strings is None:
            out = _both(out, _within(node))
    return _both(out, _grams(exact))


def _within(node) -> Query:
    """Query of a node that stands for too many strings to list."""
    op, value = node
    if op is kind.SUBPATTERN:
        return _query(value[-1])
    if op is kind.BRANCH:
        return _shortest(q for branch in value[1] for q in _query(branch))
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT) and value[0] > 0:
        return _query(value[2])
    return ANY


def _strings(node) -> set[str] | None:
    """All strings of a node in lower case, or None if they are too many."""
    op, value = node
    if op is kind.LITERAL:
        return {chr(value).lower()}
    if op is kind.AT:
        return {""}
    if op is kind.IN:
        return {chr(v).lower() for o, v in value} if len(value) <= MAX_SET and all(o is kind.LITERAL for o, v in value) else None
    if op is kind.SUBPATTERN:
        return _all(value[-1])
    if op is kind.BRANCH:
        parts = [_all(branch) for branch in value[1]]
        return None if None in parts or sum(map(len, parts)) > MAX_EXACT else set().union(*parts)
    if op is kind.MAX_REPEAT and value[0] in (0, 1) and value[1] == 1:
        inner = _all(value[2])
        return None if inner is None else inner | {""} if value[0] == 0 else inner
    return None


def _all(sequence: Iterable) -> set[str] | None:
    out = {""}
    for node in sequence:
        strings = _strings(node)
        if strings is None or len(out) * len(strings) > MAX_EXACT:
            return None
        out = {a + b for a in out for b in strings}
    return out


def _grams(exact: set[str]) -> Query:
    return _shortest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact)


def _both(a: Query, b: Query) -> Query:
    return _shortest(x | y for x in a for y in b)


def _shortest(sets: Iterable[frozenset[str]]) -> Query:
    """Without the sets that hold another one: the smaller is the weaker demand."""
    sets = set(sets)
    return frozenset(s for s in sets if not any(t < s for t in sets))


def index(docs: DataFrame, rules: Iterable[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, doc_id), once each, of the trigrams that the rules ask for, over lower-cased texts."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) for g in s})
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(held).alias("gram")).distinct().select("gram", "doc_id")


def candidates(postings: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(doc_id, rules): documents whose postings meet a rule's query, by merging the posting lists on the document."""
    held = postings.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))  # the rules bound the set
    tests = [F.when(_holds(trigram_query(r.pattern)), F.lit(r.name)) for r in rules]
    return held.select("doc_id", F.array_compact(F.array(*tests)).alias("rules")).where(F.size("rules") > 0)


def _holds(query: Query) -> Column:
    test = F.lit(False)
    for grams in sorted(query, key=sorted):
        every = F.lit(True)
        for g in sorted(grams):
            every = every & F.array_contains("grams", g)
        test = test | every
    return test


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): per row the spans (kind, start, end) of all rules; other columns are ignored.

    Null and empty texts have none. Rows that share an id, or have none, are looked up together in the
    index and verified each by itself.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    indexed = [r for r in rules if trigram_query(r.pattern) != ANY]
    hits = candidates(stage(index(rows, indexed), "postings"), indexed)
    met = rows.join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    found = []
    for rule in rules:
        kept = spans.matches(F.col("text"), rule.pattern, F.array_contains("rules", rule.name) if rule in indexed else None)
        if rule.keep:
            kept = spans.fitting(kept, rule.keep)
        found.append(spans.named(kept, rule.name))
    return met.select("doc_id", F.concat(*found).alias("found"))

