"""Language-model scores of whole documents: corpus counts joined with a recurrent model's class probabilities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.gru import Model
from cohortflow.session import stage

#: The end of a text as a token; no word can be a space.
END = " "
#: Words of the recurrent model, words whose counts every task holds (none longer than LONG bytes), distinct
#: words counted before they are passed on.
MODEL_WORDS, SHARED_WORDS, LONG, HELD = 1_024, 150_000, 64, 200_000
#: Rounds of learning, each over another share of the training documents; sums of models made in tasks, and of these for the driver.
ROUNDS, SALTS, LAST = 3, 64, 8
#: Size of a class of words, and of the state.
CLASS, WIDTH = 32, 16
#: Steps of a factor of two in word counts by which the shared words are told from the rest.
STEPS = 16


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 1) -> Column:
    """Rows whose id's text has this remainder by CRC-32; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the text column (binary), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update((x.as_py() or b"").lower().split())
                counts[END.encode()] += 1
                if len(counts) >= HELD:
                    yield _pairs(counts)
                    counts.clear()
        yield _pairs(counts)

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def common_words(counts: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """The words, of at most LONG bytes, above a count that at most ``most`` words reach, by falling count; and the counts.

    The count comes from a histogram of some hundred bins, so no task and no sort meets all words.
    """
    step = F.floor(F.log2("n") * STEPS).cast("int")
    short = counts.where(F.octet_length("word") <= LONG)
    bins = sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)  # 64 * STEPS rows at most
    least, total = None, 0
    for row in bins:
        total += row["words"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return [], np.zeros(0)
    held = short.where(step >= least).toArrow()  # ``most`` rows of LONG bytes at most
    ranked = sorted(zip((-held["n"].to_numpy()).tolist(), held["word"].to_pylist()))
    return [w for _, w in ranked], -np.array([n for n, _ in ranked], float)


def learn(rows: DataFrame, model: Model, names: list[str]) -> None:
    """Truncated backpropagation over all rows (text), data-parallel.

    Each round takes another share of the rows. Every task runs from the same parameters through its rows of
    that share, whole, and Spark averages what the tasks end with, weighted by words; so the work grows with the rows, and
    only the parameters reach the driver.
    """
    spark = rows.sparkSession

    def step(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        mine, values, names = shared.value
        mine.from_vector(values)
        number = {w.encode(): i for i, w in enumerate(names)}
        _, words = mine.learn(_numbers(x.as_py(), number, len(number))[0] for batch in batches for x in batch.column(0))
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([(mine.to_vector() * words).astype(np.float64).tobytes()], pa.binary()), pa.array([words], pa.int64())], names=["sum", "words"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in part["sum"])
        return pa.table([part["salt"][:1], pa.array([total.tobytes()], pa.binary()), pa.array([sum(part["words"].to_pylist())], pa.int64())], names=["salt", "sum", "words"])

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, model.to_vector(), names))  # parameters and MODEL_WORDS words
        share = rows.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).select("text")
        parts = share.mapInArrow(lambda batches, shared=shared: step(batches, shared), "sum binary, words bigint").withColumn("salt", (F.spark_partition_id() % SALTS).cast("int"))
        summed = parts.groupBy("salt").applyInArrow(add, "salt int, sum binary, words bigint").withColumn("salt", F.col("salt") % LAST)
        found = summed.groupBy("salt").applyInArrow(add, "salt int, sum binary, words bigint").collect()  # LAST models at most
        words = sum(r["words"] for r in found)
        if words:
            model.from_vector(sum(np.frombuffer(r["sum"]) for r in found) / words)


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row over its whole text.

    The rows where ``train`` holds are learnt from, all of them and whole: every token of them is counted, and
    a recurrent model of the MODEL_WORDS commonest words, in classes, learns from every one of their tokens (see ``learn``).
    Every other word is in the model's last class, within which its chance follows its corpus count (a word never
    counted has the chance of half an occurrence), so the score is a log probability over all words.

    The counts of at most SHARED_WORDS common words go to every task. The rest of the vocabulary grows with
    the corpus: those words are looked up by a join on the word, which no frequent word takes part in.
    A null text is an empty one, scored by its end alone. Repeated rows are scored each; other columns
    are ignored. Without training tokens the counts are zero and the model is untrained. How rows are dealt to tasks changes the
    averages, and so the score, slightly; the base columns don't depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), train.alias("train"), F.col(text).cast("binary").alias("text"))
    counts = stage(word_counts(rows.where("train").select("text")), "words")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    names, n = common_words(counts, SHARED_WORDS)
    known = min(MODEL_WORDS, len(names))
    model = Model(known, CLASS, WIDTH, seed) if known else None
    if model:
        learn(rows.where("train"), model, names[:known])
    floor = np.log10(size["n"] + 0.5 * (size["v"] + 1))
    rare_floor = np.log10(size["n"] - n[:known].sum() + 0.5 * (size["v"] - known + 1))
    shared = spark.sparkContext.broadcast((model, [w.encode() for w in names], np.log10(n + 0.5), known, floor, rare_floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names, logs, known, floor, rare_floor = shared.value
        number = {w: i for i, w in enumerate(names)}
        for batch in batches:
            yield _score(batch, model, number, logs, known, floor, rare_floor)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base double, own double, words array<string>, times array<int>"
    scored = stage(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")  # written once, so the number holds
    asked = scored.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5) * F.col("times")
    looked = asked.join(counts, "word", "left").groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("hits"))
    more = F.coalesce("log", F.lit(0.0))
    return scored.join(looked, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("hits", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(size["n"]).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"),
    )


def _numbers(text: bytes | None, number: dict[bytes, int], other: int) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of a text and its end, ``other`` for those without one."""
    tokens = (text or b"").lower().split()
    tokens.append(END.encode())
    return np.fromiter(map(number.get, tokens, repeat(other)), np.int64, len(tokens)), tokens


def _score(batch: pa.RecordBatch, model: Model | None, number: dict[bytes, int], logs: np.ndarray, known: int, floor: float, rare_floor: float) -> pa.RecordBatch:
    """Everything of some rows but the counts of words that tasks don't hold; those are listed, with their times."""
    n_tokens, n_known, base, rare, asked, inputs = [], [], [], [], [], []
    for x in batch.column(2):
        ids, tokens = _numbers(x.as_py(), number, len(number))
        held = ids < len(number)
        values = logs[ids[held]]
        unknown = Counter(tokens[i] for i in np.flatnonzero(~held))
        n_tokens.append(len(ids))
        n_known.append(int(held.sum()))
        base.append(values.sum() - len(ids) * floor)
        beyond = ids >= known
        rare.append(logs[ids[held & beyond]].sum() - beyond.sum() * rare_floor)
        asked.append(unknown)
        inputs.append(np.minimum(ids, known))
    own = model.score(inputs) / np.log(10) if model else np.zeros(len(inputs))
    words_ = pa.array([list(u) for u in asked], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
    times = pa.array([list(u.values()) for u in asked], pa.list_(pa.int32()))
    columns = [batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(own + np.array(rare), pa.float64()), words_, times]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "train", "n_tokens", "n_known", "base", "own", "words", "times"])
