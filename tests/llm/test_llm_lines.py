from __future__ import annotations

import random

import numpy as np
import pytest
from llm_cases import awkward, documents
from pyspark.sql import functions as F

from cohortflow.llm import lines
from cohortflow.llm.mphf import Hash

SPACE = " \t\n\v\f\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=10):
    last = lines.LAST

    def key(line):
        return line.strip(SPACE).translate(UPPER)

    holders: dict[str, set] = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, text in rows:
        own = last if i is None else i
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(holders.get(key(x), ())) > 1 and own != min(holders[key(x)]))]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["row"]["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = [f"a line that comes again {i}" for i in range(40)] + ["short", "", "  ", "0123456789", "012345678", "éééééééééé", "ééééééééé", "İSTANBUL is a city", "A LINE that comes again 3", "\t a line that comes again 4\r"]
    made = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"only here {i} {j}" for j in range(rng.randrange(8)))) for i in range(300)]
    made += [(-5, "a line that comes again 7\na line that comes again 7"), (7, "another text of seven\na line that comes again 1"), (7, "another text of seven"), (None, "no id, own line\nanother text of seven"), (None, "no id, own line")]
    return made + awkward() + [(900, "\n".join(f"long text {i % 977}" for i in range(20_000))), (901, "long text 5 \n" * 2)]


def test_lines_match_brute_force(spark, rows):
    assert found(lines.without_repeated(documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("keys, probes, hot", [(3, 50, 4096), (1 << 16, 1 << 18, 1), (5, 1 << 18, 20)])
def test_shards_and_hot_keys_change_nothing(spark, rows, monkeypatch, keys, probes, hot):
    monkeypatch.setattr(lines, "KEYS", keys)
    monkeypatch.setattr(lines, "PROBES", probes)
    monkeypatch.setattr(lines, "HOT", hot)
    assert found(lines.without_repeated(documents(spark, rows))) == brute(rows)


def test_a_line_of_every_document(spark):
    rows = [(i, f"the same line everywhere\nown line number {i % 50}") for i in range(400)]
    assert found(lines.without_repeated(documents(spark, rows))) == brute(rows)


def test_clashing_columns_and_empty_table(spark):
    docs = documents(spark, [(1, "one and the same line"), (2, "one and the same line")])
    docs = docs.select("*", *[F.lit(f"x{c}").alias(c) for c in ("kept", "doc", "low", "high", "gone", "n_lines", "_doc", "_part")])
    out = lines.without_repeated(docs)
    assert out.select("row.*").columns == docs.columns and {(r["row"]["kept"], r["kept"]) for r in out.collect()} == {("xkept", "one and the same line"), ("xkept", "")}
    assert lines.without_repeated(documents(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    low, high = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    low[: n // 3] = 5  # equal halves
    index = Hash.from_bytes(Hash.build(low, high).to_bytes())
    assert sorted(index.numbers(low, high)) == list(range(n))
    other = index.numbers(high[:100], low[:100])
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert n < 1000 or len(index.to_bytes()) * 8 < 6 * n


def test_key_values(spark):
    """Entries hold what they say: fingerprint, number of documents, smallest document."""
    docs = documents(spark, [(i, "a line of all documents\na line of even ones" if i % 2 == 0 else "a line of all documents") for i in range(600)])
    repeated, probes = lines.repeated_keys(lines._rows(docs, "doc_id", "text"), 10)
    assert probes == 900
    tables = lines.shard_tables(repeated, 1).collect()
    counts = [c for t in tables for c in t["counts"]]
    keepers = [k for t in tables for k in np.frombuffer(t["keepers"], np.int64)]
    assert counts == [255, 255] and keepers == [0, 0]
