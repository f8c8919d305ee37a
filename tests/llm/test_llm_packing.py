from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from llm_cases import awkward, documents
from tokenizers import Tokenizer

from cohortflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_curve_visits_every_cell_by_single_steps(monkeypatch):
    monkeypatch.setattr(packing, "DEPTH", 2)
    cells = np.stack(np.meshgrid(*[range(4)] * packing.DIMS, indexing="ij"), axis=-1).reshape(-1, packing.DIMS)
    by_key = {packing.hilbert(c): c for c in cells}
    assert sorted(by_key) == list(range(len(cells)))
    assert all(np.abs(by_key[k] - by_key[k + 1]).sum() == 1 for k in range(len(cells) - 1))


def test_like_documents_get_near_keys():
    matrix, rng = packing.projection(11), np.random.default_rng(0)
    base = rng.integers(0, 50_000, 400)
    near = np.r_[base[:390], rng.integers(0, 50_000, 10)]
    far = [packing.cell(rng.integers(0, 50_000, 400), matrix) for _ in range(50)]
    own = packing.cell(base, matrix)
    assert np.abs(packing.cell(near, matrix) - own).max() < np.median([np.abs(f - own).max() for f in far]) / 3


def test_pieces_hold_every_id_once_without_padding(spark):
    rows = awkward() + [(100 + i, f"text {i} " * (i % 300)) for i in range(200)] + [(900, "x" * 100_000), (901, " " * 200_000 + "y")]
    pieces = packing.pack(documents(spark, rows), PATH).collect()
    library = Tokenizer.from_file(PATH)
    whole = {}
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        whole.setdefault((doc, len(ids)), []).append(ids)
    got = {}
    for p in pieces:
        got.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert set(got) == set(whole)
    for key, parts in got.items():
        assert sum(p["length"] for p in parts) == sum(map(len, whole[key]))
        ids = whole[key][0]
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        if len(whole[key]) == 1:
            at = 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []
