from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash
from llm_cases import awkward, documents

from cohortflow.llm import simhash
from cohortflow.llm.components import components


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{p:016x}", least.get(find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints))), key=repr)


@pytest.mark.parametrize("radius", [1, 2])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    for bits in itertools.combinations(range(64), radius):
        off = sum(1 << b for b in bits)
        assert any(not m & off for m in masks)
    assert all(34 <= m.bit_count() <= 44 for m in masks)


def test_classes_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for doc in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(1, 300))
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):  # ever more changed, so that chains of links arise
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += awkward()
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rows)
    assert any(a != c for a, _, c in map(tuple, got) if a is not None)


def test_links_over_planted_codes_are_exact(spark):
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(30)}
    for code in list(codes):
        for _ in range(20):  # a crowd around each, one to three bits away from others of it
            codes.add(code ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    signed = {c - (1 << 64) if c >> 63 else c: c for c in codes}
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp bigint"))
    assert all((signed[a] ^ signed[b]).bit_count() <= 2 for a, b in links.collect())
    roots = dict(map(tuple, components(links).collect()))
    group = {c: {c} for c in signed}
    for a, b in itertools.combinations(signed, 2):
        if (signed[a] ^ signed[b]).bit_count() <= 2 and group[a] is not group[b]:
            group[a] |= group[b]
            for c in group[b]:
                group[c] = group[a]
    for a, b in itertools.combinations(signed, 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (group[a] is group[b])


def test_components_of_a_long_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, 2000 + i) for i in range(300)] + [(7000, 7000), (None, 3), (1, 0)]
    got = components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    by_root = {}
    for node, root in got:
        by_root.setdefault(root, set()).add(node)
    assert sorted(map(len, by_root.values())) == [301, 501] and len(got) == 802
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
