from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortflow.llm import trie

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(turns):
    talks: dict[int, list] = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        said = f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()
        return t[0], t[1], hashlib.md5(said).hexdigest()

    said = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in talks.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = said.get(base, [])[:h] + own[h:]
    members: dict[tuple, list] = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children: dict[tuple, list] = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[p] for p in below)
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, turns):
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("node", "t1", "size", "position", "block", "level", "x", "y")])
    return sorted((tuple(r[f] for f in FIELDS) for r in trie.prefix_trie(df).collect()), key=repr)


def conversations(rng, n, length, vocabulary):
    turns = []
    for c in range(n):
        for t in range(rng.randrange(1, length)):
            turns.append((c, t, rng.choice(["user", "assistant"]), rng.choice(vocabulary)))
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("length", [5, 12, 40])
def test_nodes_match_brute_force(spark, length):
    rng = random.Random(length)
    turns = conversations(rng, 250, length, ["yes", "no", "🙂é", ""])
    assert found(spark, turns) == brute(turns)


def test_shared_long_conversations_cross_blocks(spark):
    """Copies of a long conversation that part after 8, 16, 17 and 60 turns, and one that ends at a block's border."""
    turns = []
    for c, cut in enumerate([8, 16, 17, 60, 70, 70, 16]):
        own = [f"turn {t}" if t < cut else f"own {c} {t}" for t in range(16 if c == 6 else 70)]
        turns += [(100 * c, t, "user", x) for t, x in enumerate(own)]
    assert found(spark, turns) == brute(turns)


def test_awkward_turns(spark):
    """Null turns, roles, texts and ids; ties; repeated rows; absent, short and negative bases; conversations that end up turnless."""
    turns = [(1, None, None, None), (1, None, "user", "a"), (1, 2, "user", None), (1, 2, "user", "b"), (1, 2, "user", "b"), (None, 1, "user", "lost"), (-7, 0, "user", "minus"), (-107, 1, "user", "minus"), (-100, 0, "user", "base of minus")]
    turns += [(c, 0, "user", "only") for c in range(205, 260)] + [(300, 0, "user", "short base"), *[(300 + c, t, "user", f"t{t}") for c in range(1, 40) for t in range(7)]]
    want = brute(turns)
    assert found(spark, turns) == want and any(row[1] == 0 and row[7] != hashlib.sha256(b"").hexdigest() for row in want)


def test_roles_and_texts_are_told_apart(spark):
    turns = [(0, 0, "ab", "c"), (100, 0, "a", "bc"), (200, 0, "1:a", "b"), (300, 0, "", "abc"), (400, 0, None, "abc")]
    assert found(spark, turns) == brute(turns)


def test_many_copies_and_member_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    turns = [(c * 100, t, "user", f"t{t}") for c in range(120) for t in range(9)]
    assert found(spark, turns) == brute(turns)


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
