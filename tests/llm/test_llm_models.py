from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward, documents

from cohortflow.llm import gru, lm, toxicity


def labelled(n=600):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice([f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(150)], 40).tolist()
        bad = i % 5 == 0
        for _ in range(1 + i % 4 if bad else 0):
            words[rng.integers(40)] = ["nasty", "Awful,", "VILE"][rng.integers(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_chain_finds_toxic_documents_and_leaves_clean_ones(spark):
    rows, labels = labelled()
    train, test = rows[:400], rows[400:]
    chain = toxicity.fit(documents(spark, train), spark.createDataFrame(labels[:400], "doc_id bigint, toxic int"))
    assert {"nasty", "awful", "vile"} <= {w.rstrip("*") for w in chain.words}
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, test), chain).collect()}
    assert [i for i in got if got[i]["toxic"]] == [i for i in got if i % 5 == 0]
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("p_toxic", "p_repeated", "p_severe"))
    many = [got[i]["p_repeated"] for i in got if i % 20 == 15]
    assert min(many) > max(got[i]["p_repeated"] for i in got if i % 5)
    every = toxicity.score(documents(spark, awkward()), chain).collect()
    assert len(every) == len(awkward()) and not any(r["toxic"] for r in every)


def test_chain_feeds_out_of_fold_probabilities_to_later_models():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = np.c_[x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0)].astype(float)
    weights, thresholds = toxicity.fit_chain(x, y, np.arange(400) % 4)
    assert [len(w) for w in weights] == [4, 5] and weights[1][3] > 0 and all(0 < t < 1 for t in thresholds)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)], [(None, 1), (1, None)], [(99, 1), (1, 0)]])
def test_labels_without_both_classes_flag_nothing(spark, labels):
    docs = documents(spark, awkward())
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(documents(spark, []), chain).collect() == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = gru.Model(20, class_size=6, width=5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.p["class"] *= 5
    inputs, words, live, h = rng.integers(0, 22, (7, 3)), rng.integers(0, 20, (7, 3)), rng.random((7, 3)) > 0.2, rng.normal(size=(3, 5))
    loss = lambda: -(m.log_probs(m.forward(inputs, h)[0].astype(np.float64).reshape(-1, 5), words.ravel()) * live.ravel()).sum() / live.sum()
    _, grads, _ = m.gradients(inputs, words, live, h)
    for name, value in m.p.items():
        at = np.unravel_index(np.argmax(np.abs(grads[name])), value.shape)
        old, step = value[at], 1e-2
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert (up - down) / 2 / step == pytest.approx(grads[name][at], rel=0.02, abs=1e-5), name


def test_probabilities_sum_to_one_and_windows_carry_the_state():
    rng = np.random.default_rng(2)
    m = gru.Model(20, class_size=6, width=5)
    assert np.exp(m.log_probs(np.repeat(rng.normal(size=(1, 5)), 21, 0).astype(np.float32), np.arange(21))).sum() == pytest.approx(1, abs=1e-5)
    docs = [rng.integers(0, 21, n) for n in (1, 5, 60, 24, 48, 0, 200)]

    def alone(doc):
        h, before, total = np.zeros((1, 5), np.float32), m.start, 0.0
        for word in doc:
            h = m.forward(np.array([[before]]), h)[0][-1]
            total, before = total + m.log_probs(h, np.array([word]))[0], word
        return total

    assert m.score(docs) == pytest.approx([alone(d) for d in docs], rel=1e-4)


def test_training_learns_order():
    docs = [np.array([0, 1, 2, 3, 4] * 20) for _ in range(40)]
    m = gru.Model(5, class_size=2, width=8)
    before = m.score(docs[:1])[0]
    losses = m.train(docs, passes=6)
    assert losses[-1] < losses[0] / 2 and m.score(docs[:1])[0] > before / 2


def test_scores_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARED_WORDS", 30)  # most words take the join
    monkeypatch.setattr(lm, "MODEL_WORDS", 20)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"W{int(w)}" for w in rng.zipf(1.4, rng.integers(1, 80)))) for i in range(150)] + awkward()
    got = lm.score(documents(spark, rows), ~lm.held_out()).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "]
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n = sum(counts.values())
    floor = math.log10(n + 0.5 * (len(counts) + 1))
    want = [(d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10(counts[w] + 0.5) - floor for w in words(t)), 4)) for d, t in rows]
    assert sorted(((*r[:5], round(r[5], 4)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_the_language_model_is_a_distribution_over_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARED_WORDS", 6)
    monkeypatch.setattr(lm, "MODEL_WORDS", 4)
    train = [(2, "a a a b b c d e f g"), (3, "a b c d e")]
    # the first token of a text: every known word, the end, and a word never seen
    probe = [(1000 + i, w) for i, w in enumerate("abcdefg")] + [(2000, ""), (2001, "zzz")]
    docs = documents(spark, train + probe)
    from pyspark.sql import functions as F

    scored = {r["doc_id"]: r["score"] for r in lm.score(docs, F.col("doc_id") < 1000).collect()}
    end = scored[2000]
    total = 10**end
    for doc, word in probe:
        if word:
            total += 10 ** scored[doc]  # word and end; the end's share after the word is at most one
    assert total <= 1 + 1e-6


def test_a_late_training_text_changes_the_score(spark):
    """All training rows are learnt from: a transition that only one of 1,000 long texts shows, wherever it is, counts."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    plain = [(i, " ".join(rng.choice(words, 60))) for i in range(1000)]
    shown = " ".join(["w3 w7"] * 3000)  # beyond any prefix of 32 KB
    probe = [(5000, "w3 w7 " * 10)]
    scores = []
    for last in (shown, " ".join(sorted(shown.split()))):  # the same words, and so the same base score
        docs = documents(spark, plain + [(1000, last)] + probe)
        scores.append(next(r for r in lm.score(docs, F.col("doc_id") < 5000).collect() if r["doc_id"] == 5000))
    assert scores[0]["base_score"] == pytest.approx(scores[1]["base_score"]) and abs(scores[0]["score"] - scores[1]["score"]) > 0.5


def test_learning_beats_counts_on_held_out_documents(spark):
    rng = np.random.default_rng(10)
    follow = {f"w{i}": [f"w{(i * 7 + j) % 50}" for j in range(3)] for i in range(50)}

    def text():
        word, out = "w0", []
        for _ in range(80):
            out.append(word)
            word = follow[word][rng.integers(3)]
        return " ".join(out)

    got = [r for r in lm.score(documents(spark, [(i, text()) for i in range(1500)]), ~lm.held_out()).collect() if r["held_out"]]
    assert len(got) > 200 and sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_shared_words_end_at_a_count(spark):
    counts = spark.createDataFrame([(f"a{i}", 1000 - i) for i in range(100)] + [(f"b{i}", 5) for i in range(50)] + [("c" * 65, 10**6)], "word string, n bigint")
    for most in (0, 1, 40, 99, 100, 149, 150, 1000):
        names, n = lm.common_words(counts, most)
        assert len(names) <= most and names == [f"a{i}" for i in range(min(len(names), 100))] + sorted(f"b{i}" for i in range(50))[: max(0, len(names) - 100)]
        assert len(names) >= (100 if most >= 100 else 0) and (most < 150 or len(names) == 150) and sorted(n, reverse=True) == list(n)


def test_models_are_averaged_as_vectors():
    a, b = gru.Model(9, class_size=4, width=5, seed=1), gru.Model(9, class_size=4, width=5, seed=2)
    mean = (a.to_vector() + b.to_vector()) / 2
    wanted = {k: (a.p[k] + b.p[k]) / 2 for k in a.p}
    a.from_vector(mean)
    assert all(np.allclose(a.p[k], wanted[k]) for k in wanted) and all(np.allclose(v, 1e-6) for v in a.squares.values())


def test_no_training_rows_and_no_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "a b"), (None, None)])
    got = lm.score(docs, F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (3, 0, 0)] and all(r["score"] == pytest.approx(0) for r in got)
    assert lm.score(documents(spark, []), ~lm.held_out()).collect() == []
