"""Toxicity categories by a classifier chain of linear models over selected words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.slices import slices
from cohortflow.session import stage

#: Labelled documents that are learnt from (about), words selected, and least documents with a word.
SAMPLE_DOCS, WORDS, MIN_DOCS = 8_000, 192, 5
#: Longest text, in bytes, that is learnt from; it bounds the sample. Every text is scored whole.
SAMPLE_BYTES = 1 << 17
FOLDS, RIDGE, STEPS = 4, 1e-2, 8
#: Least likelihood ratio statistic of a marker: far beyond what the best of all words reaches by chance.
LEAST_GAIN = 30.0

#: Lengths of the word beginnings that count as words of their own, written with a star.
STEMS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Chain:
    """The selected words, and per category the weights (words, earlier categories, constant) and threshold."""

    words: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]


def _counts(text: str, number: dict[str, int]) -> Counter:
    """Times that each numbered word, or a word with a numbered beginning, occurs."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for name in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
            if name in number:
                out[number[name]] += n
    return out


def _row(counts: dict[int, int], n: int) -> np.ndarray:
    x = np.zeros(n)
    for i, c in counts.items():
        x[i] = 1 + np.log(c)
    return x


def candidate_words(sample: DataFrame, target: str, words: int = WORDS, min_docs: int = MIN_DOCS) -> list[str]:
    """Words and word beginnings likelier in documents that carry the target, by the likelihood ratio of their document counts."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = [F.transform(F.filter(found, _longer(k)), _stem(k)) for k in STEMS]
    held = sample.select(F.col(target).cast("int").alias("y"), F.explode(F.array_distinct(F.concat(found, *stems))).alias("word"))
    by_word = held.groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    size = sample.agg(F.coalesce(F.sum(target), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    if not 0 < size["a"] < size["n"]:
        return []
    rate = size["a"] / size["n"]
    a, b = F.col("a"), F.col("n") - F.col("a")
    gain = a * F.log(a / F.col("n") / rate) + F.when(b > 0, b * F.log(b / F.col("n") / (1 - rate))).otherwise(0.0)
    likelier = by_word.where(a > F.col("n") * rate)
    return [r["word"] for r in likelier.orderBy(F.desc(F.round(gain, 6)), "word").limit(words).collect()]


def _longer(k: int):
    return lambda w: F.length(w) > k


def _stem(k: int):
    return lambda w: F.concat(F.left(w, F.lit(k)), F.lit("*"))


def cover(held: np.ndarray, y: np.ndarray, least: float = LEAST_GAIN) -> list[int]:
    """Words (columns of ``held``) chosen one after another, each by what the documents without any earlier one show.

    A word that only copies of one document share goes with the first real marker in them. The gain is
    the likelihood ratio statistic; a round ends when the best is below ``least``. Further rounds find
    the markers that the documents of others hid; they end when a round's best is a fifth of the first's.
    """
    chosen: list[int] = []
    first = 0.0
    while True:
        live, begun = np.ones(len(held), bool), len(chosen)
        while live.any() and 0 < y[live].mean() < 1:
            n, a, rate = held[live].sum(axis=0), held[live & (y > 0)].sum(axis=0), y[live].mean()
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = 2 * (a * np.log(a / n / rate) + np.where(n > a, (n - a) * np.log((n - a) / n / (1 - rate)), 0))
            gain = np.where((n > 0) & (a > n * rate), gain, 0)
            gain[chosen] = 0
            best = int(np.argmax(gain))
            if gain[best] < max(least, first / 5 if len(chosen) == begun else 0):
                break
            first = first or gain[best]
            chosen.append(best)
            live &= ~held[:, best]
        if len(chosen) == begun:
            return chosen


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE * max(1, len(x)) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 8 / (1e-12 + np.abs(step).max()))
    return w


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Weights and thresholds of the categories (columns of y), in order.

    A later model sees the earlier categories' probabilities. In training these are out-of-fold, so
    that it meets them as uncertain as they will be on new documents. The threshold is the
    out-of-fold probability of highest F1, halfway to the next lower one.
    """
    weights, thresholds = [], []
    for target in y.T:
        out = np.zeros(len(x))
        for f in np.unique(fold):
            inside, rest = fold == f, fold != f
            out[inside] = sigmoid(np.c_[x[inside], np.ones(inside.sum())] @ logistic(x[rest], target[rest])) if rest.any() else target.mean()
        weights.append(logistic(x, target))
        thresholds.append(_best_threshold(out, target))
        x = np.c_[x, out]
    return weights, thresholds


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    last = np.r_[p[order][1:] != p[order][:-1], True] if len(p) else np.array([], bool)
    if not last.any() or not y.any():
        return 1.01
    at = np.flatnonzero(last)[np.argmax(f1[last])]
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Chain:
    """A chain of three categories from labelled documents: ``target``, repeated, severe.

    Labels name only the first. Markers are the words that ``cover`` selects; "repeated" documents carry it and hold two markers or more, "severe" ones carry it and hold
    more markers a word than the median document that does. About ``sample_docs`` labelled documents
    are learnt from, chosen by a hash of their id. Rows without a label, id or text are left out; an id
    labelled more than once counts by its largest label. Without both classes nothing is ever flagged.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(target).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    share = min(1.0, sample_docs / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    sample = stage(texts.join(known, "doc_id"), "labelled")
    words = candidate_words(sample, "y")
    if not words:
        return Chain((), (), (1.01, 1.01, 1.01))
    number = {w: i for i, w in enumerate(words)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counts(t.as_py(), number) for t in batch.column(1)]
            total = pa.array([len(_WORD.findall(t.as_py())) for t in batch.column(1)], pa.int64())
            held = [pa.array([list(c.keys()) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), total, *held], names=["doc_id", "y", "total", "word", "n"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    counted = sample.select("doc_id", "text", "y").mapInArrow(read, f"doc_id {kind}, y int, total bigint, word array<int>, n array<int>")
    rows = counted.select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), "y", "total", "word", "n").toArrow().to_pylist()  # about sample_docs rows of WORDS counts
    held = [dict(zip(r["word"], r["n"])) for r in rows]
    x, y = np.array([_row(h, len(words)) for h in held]), np.array([r["y"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Chain((), (), (1.01, 1.01, 1.01))
    markers = cover(x > 0, y)
    if not markers:
        return Chain((), (), (1.01, 1.01, 1.01))
    marked = np.array([sum(h.get(i, 0) for i in markers) for h in held])
    rate = marked / np.maximum(1, [r["total"] for r in rows])
    targets = np.c_[y, y * (marked >= 2), y * (rate > np.median(rate[y > 0]))]
    weights, thresholds = fit_chain(x[:, markers], targets, np.array([r["fold"] for r in rows]))
    return Chain(tuple(words[i] for i in markers), tuple(weights), tuple(thresholds))


def judged(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """(row, toxic, p_toxic, p_repeated, p_severe): every row as a struct, with what the chain says of its whole text.

    A null text is an empty one; repeated rows are judged each.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # WORDS words and three weights for each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value.words, shared.value.weights
        number = {w: i for i, w in enumerate(words)}
        for batch in slices(batches):
            p = np.zeros((3, batch.num_rows))
            if words:
                for i, value in enumerate(batch.column(1)):
                    x = _row(_counts(value.as_py() or "", number), len(words))
                    for c, w in enumerate(weights):
                        p[c, i] = sigmoid(x @ w[:-1] + w[-1])
                        x = np.append(x, p[c, i])
            toxic = pa.array(p[0] >= shared.value.thresholds[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), toxic, *map(pa.array, p)], names=["row", "toxic", "p_toxic", "p_repeated", "p_severe"])

    schema = T.StructType([rows.schema["row"], T.StructField("toxic", T.BooleanType()), *[T.StructField(n, T.DoubleType()) for n in ("p_toxic", "p_repeated", "p_severe")]])
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, toxic, p_toxic, p_repeated, p_severe) of every row; see ``judged``. Other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return judged(rows, chain).select("row.doc_id", "toxic", "p_toxic", "p_repeated", "p_severe")
