"""Personal data: candidate spans, boosted trees over them, calibrated thresholds. DataFrame operations only.

High-recall expressions propose overlapping spans of every kind, spelt-out and broken-up forms among
them. Those that meet a kind's base rule are kept as they are. Gradient-boosted trees score the others by
format and context, and a threshold per kind, calibrated on held-out documents, selects among them.

The trees learn from all documents: candidates that meet the base rule, the same ones
rewritten into the loose forms, and copies spoilt so that no rule holds any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import spans
from cohortflow.session import stage

KINDS = ["email", "ip", "card", "phone"]

#: The base expressions. A run that can't match from its start can't match later on, so
#: a match begins at the start of a run of its first characters or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond these: spelt-out addresses, and digit groups with any of the usual separators.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[(]\x20?at\x20?[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]++)++"
LOOSE_NUMBER = r"\+?\(?[0-9](?:[\x20().\[\]/-]{0,3}[0-9])++"
OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Trees, their depth, and the precision a threshold has to reach.
TREES, DEPTH, PRECISION = 10, 3, 0.995
#: Share of the documents, in sixteenths, held out to calibrate the thresholds.
HELD_OUT = 5


@dataclass(frozen=True)
class Model:
    """Trees as nested tests over the features, and the threshold of each kind (1.01: none is selected)."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base(text: Column) -> dict[str, Column]:
    """Matches of each kind that meet its base rule."""
    def part(kind: str, pattern: str, when: Column, keep) -> Column:
        return F.filter(spans.matches(text, pattern, when), keep)

    some_digit = text.rlike("[0-9]")
    return {
        "email": spans.matches(text, EMAIL, text.contains("@")),
        "ip": part("ip", IP, some_digit, lambda m: _is_ip(m["text"])),
        "card": part("card", CARD, some_digit, lambda m: _is_card(m["text"])),
        "phone": part("phone", PHONE, text.contains("+"), lambda m: F.length(digits(m["text"])).between(10, 15)),
    }


def _is_ip(text: Column) -> Column:
    return text.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")


def _is_card(text: Column) -> Column:
    number = digits(text)
    return F.length(number).between(14, 19) & F.call_function("luhn_check", number)


def loose(text: Column) -> Column:
    """Candidates (kind, start, end, text, before, after) of the high-recall expressions."""
    spelt = text.rlike(r"(?:@|[\[(]\x20?at\x20?[\])])")
    mail = F.transform(spans.matches(text, LOOSE_EMAIL, spelt), lambda m: _candidate(F.lit("email"), m))
    found = F.filter(spans.matches(text, LOOSE_NUMBER, text.rlike("[0-9]")), lambda m: F.length(digits(m["text"])).between(4, 19))
    return F.concat(mail, F.transform(found, lambda m: _candidate(_number_kind(m["text"]), m)))


def _number_kind(text: Column) -> Column:
    groups = F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))
    dotted = (groups == 4) & (F.length(F.translate(text, "0123456789[]() ", "")) == 3) & text.contains(".")
    return F.when(dotted, "ip").when(F.length(digits(text)) >= 14, "card").otherwise("phone")


def _candidate(kind: Column, m: Column) -> Column:
    return F.struct(kind.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["before"].alias("before"), m["after"].alias("after"))


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: _candidate(F.lit(kind), m))


def features(c: Column) -> Column:
    """Format and context of a candidate, as numbers."""
    text, number = c["text"], digits(c["text"])
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\x20?[\[(]\x20?at\x20?[\])]\x20?", "@"), r"\x20?[\[(]\x20?dot\x20?[\])]\x20?", "."), r"[\x20\[\]]", "")
    flag = lambda test: test.cast("double")
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", "")).cast("double")
    values = [
        F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("double"),
        F.length(text).cast("double"),
        F.length(number).cast("double"),
        count("A-Za-z"), count(r"\x20"), count("."), count("-"), count("/"), count(r"()\[\]"),
        F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        flag(text.startswith("+")),
        flag(F.length(number).between(12, 19) & F.call_function("luhn_check", number)),
        flag(_is_ip(plain)),
        flag(plain.rlike("^" + EMAIL.split(")", 2)[-1].removeprefix(")") + "$")),
        flag(plain.rlike(r"\.[A-Za-z]{2,}$")),
        flag(c["before"].rlike(r"[A-Za-z0-9]$")), flag(c["after"].rlike("^[A-Za-z0-9]")),
        flag(c["before"].rlike(r"[.,:;=/#$-]\x20?$")), flag(c["after"].rlike(r"^\x20?[%/=]")),
        flag(c["before"].rlike(r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|account|addr|ip|host|server)[^A-Za-z0-9]{0,4}[a-z]{0,4}[^A-Za-z0-9]{0,3}$")),
        flag(c["before"].rlike(r"(?i)(?:order|ref|no|nr|id|version|page|line|isbn|item)[^A-Za-z0-9]{0,4}$")),
    ]
    return F.array(*[F.coalesce(v, F.lit(0.0)) for v in values])


def score(f: Column, model: Model) -> Column:
    """Probability of a candidate's features: the logistic value of twice the trees' weighted sum."""
    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        index, at, left, right = node
        return F.when(F.get(f, F.lit(index)) <= at, walk(left)).otherwise(walk(right))

    total = sum((walk(t) * w for t, w in zip(model.trees, model.weights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * total))


def training_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, kind, features, label) of the candidates of some documents and of their rewritten and spoilt copies."""
    rows = docs.select(F.pmod(F.xxhash64(text), F.lit(16)).alias("part"), F.col(text).alias("text"))
    good = F.concat(*[_of_kind(m, kind) for kind, m in base(F.col("text")).items()])
    found = rows.select("part", F.explode(good).alias("c"))
    c = F.col("c")
    shift = F.translate(c["text"], "0123456789", "1234567890")
    spelt = F.when(c["kind"] == "email", F.regexp_replace(F.regexp_replace(c["text"], "@", " (at) "), r"\.", " (dot) ")).when(
        c["kind"] == "card", F.regexp_replace(digits(c["text"]), "([0-9]{4})(?=[0-9])", "$1.")).when(
        c["kind"] == "ip", F.regexp_replace(c["text"], r"\.", "[.]")).otherwise(F.regexp_replace(F.translate(c["text"], "()", ""), r"[\x20-]", "."))
    spoilt = F.when(c["kind"] == "email", F.regexp_replace(c["text"], r"\.[^.@]*$", "")).when(
        c["kind"] == "card", F.when(~F.call_function("luhn_check", digits(shift)), shift)).when(
        c["kind"] == "ip", F.regexp_replace(c["text"], "^[0-9]+", "731")).otherwise(F.regexp_replace(F.translate(c["text"], "+() ", ""), "^([0-9]{1,9}).*$", "$1"))
    variants = F.array(
        F.struct(c["text"].alias("text"), F.lit(1.0).alias("label")), F.struct(spelt.alias("text"), F.lit(1.0).alias("label")),
        F.struct(spoilt.alias("text"), F.lit(0.0).alias("label")),
    )
    made = found.select("part", "c", F.explode(variants).alias("v")).where("v.text is not null")
    made = made.select("part", c["kind"].alias("kind"), features(c.withField("text", F.col("v.text"))).alias("features"), F.col("v.label").alias("label"))
    other = rows.select("part", F.explode(_beyond(loose(F.col("text")), base(F.col("text")))).alias("c"))
    return made.union(other.select("part", c["kind"].alias("kind"), features(c).alias("features"), F.lit(0.0).alias("label")))


def _beyond(candidates: Column, kept: dict[str, Column]) -> Column:
    """Candidates that overlap no base span of their kind."""

    def clear(found: Column) -> Column:
        def of(kind: str, base_spans: Column) -> Column:
            return spans.bind(spans.paged(base_spans), lambda pages: F.filter(found, lambda c: (c["kind"] == kind) & ~spans.overlaps(pages, c)))

        return F.concat(*[of(kind, spans.named(m, kind)) for kind, m in kept.items()])

    return spans.bind(candidates, clear)


def fit(docs: DataFrame, text: str = "text", trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Model:
    """Trees and thresholds from the candidates of all documents.

    Without positive and negative candidates there are no trees and nothing beyond the base spans is
    selected. A kind's threshold is the lowest score, in hundredths, from which on the held-out
    candidates are right with the given precision.
    """
    rows = stage(training_rows(docs.where(F.col(text).isNotNull()), text), "candidates")
    train = rows.where(F.col("part") >= HELD_OUT)
    if train.select("label").distinct().count() < 2:
        return Model((), (), dict.fromkeys(KINDS, 1.01))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=1, featuresCol="vector")
    fitted = boosted.fit(train.select("label", array_to_vector("features").alias("vector")))
    model = Model(tuple(_node(t._java_obj.rootNode()) for t in fitted.trees), tuple(fitted.treeWeights), {})
    scored = rows.where(F.col("part") < HELD_OUT).select("kind", "label", F.floor(score(F.col("features"), model) * 100).alias("bin"))
    bins = scored.groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # at most 101 a kind
    return Model(model.trees, model.weights, {kind: _threshold([b for b in bins if b["kind"] == kind], precision) for kind in KINDS})


def _node(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _node(node.leftChild()), _node(node.rightChild())


def _threshold(bins: list, precision: float) -> float:
    good = n = 0
    least = 1.01
    for b in sorted(bins, key=lambda b: -b["bin"]):
        good, n = good + b["good"], n + b["n"]
        if good >= precision * n and b["bin"] >= 50:
            least = b["bin"] / 100
        else:
            break
    return least


def found(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """The rows with two arrays of spans (kind, start, end) added: _base and _found (base spans and those selected)."""
    kept = base(F.col(text))
    rows = rows.withColumns({f"_{kind}": m for kind, m in kept.items()})
    by_kind = {kind: F.col(f"_{kind}") for kind in KINDS}
    certain = F.concat(*[spans.named(m, kind) for kind, m in by_kind.items()])
    more = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if model.trees and min(model.thresholds.values()) <= 1:
        least = F.create_map(*[F.lit(x) for k in KINDS for x in (k, model.thresholds[k])])
        chosen = F.filter(_beyond(loose(F.col(text)), by_kind), lambda c: spans.bind(features(c), lambda f: score(f, model)) >= F.element_at(least, c["kind"]))
        more = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.withColumns({"_base": certain, "_found": F.concat(certain, more)}).drop(*[f"_{kind}" for kind in KINDS])


def find(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): per row the base spans and all spans (kind, start, end).

    Spans hold code points, end exclusive. Null and empty texts have none; repeated rows are handled
    each by itself; other columns are ignored. No row is moved.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return found(rows, model, "text").select("doc_id", F.col("_base").alias("base"), F.col("_found").alias("found"))


def redacted(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows with their spans of personal data replaced, and ``n_chars``, if there is such a column, counted anew.

    A null text stays null and its count as it was. All other columns are carried along, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    out = found(rows, model, "text").select("row", redact(F.col("text"), F.col("_found")).alias("text"))
    new = {text: F.col("text"), n_chars: F.coalesce(F.length("text"), F.col("row")[n_chars]).cast(docs.schema[n_chars].dataType) if n_chars in docs.columns else None}
    return out.select(*[(F.col("row")[c] if new.get(c) is None else new[c]).alias(c) for c in docs.columns])


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets, overlapping spans by one mark.

    The text is cut into chunks once, so a long text with many spans is not walked from its start for each.
    """
    step = 4096

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        a, b = (start / step).cast("int"), (end / step).cast("int")
        part = F.array_join(F.slice(chunks, a + 1, b - a + 1), "")
        return F.substring(part, start - a * step + 1, end - start)

    def build(x: Column) -> Column:
        chunks, ordered, n = x["chunks"], x["spans"], x["n"]
        # the end of what is covered before each span decides where its gap begins
        covered = spans.running(F.transform(ordered, lambda s: s["end"]), F.array_max, F.greatest)
        marks = F.zip_with(ordered, F.concat(F.array(F.lit(0)), F.slice(covered, 1, F.size(ordered) - 1)), lambda s, at: F.struct(at.alias("from"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        cut = F.transform(marks, lambda m: F.when(m["start"] >= m["from"], F.concat(piece(chunks, m["from"], m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))).otherwise(F.lit("")))
        tail = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return F.concat(F.array_join(cut, ""), piece(chunks, tail, n))

    chunks = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % step), F.lit(0))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.struct(chunks.alias("chunks"), ordered.alias("spans"), F.length(text).alias("n"))
    return F.when(F.size(found) > 0, spans.bind(whole, build)).otherwise(text)
