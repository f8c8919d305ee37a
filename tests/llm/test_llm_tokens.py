from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from llm_cases import awkward, documents
from tokenizers import Tokenizer

from cohortflow.llm import bpe, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a", "a  b", "a \n b  ", "don't we'll they're 'S", "x'r 'll' 're", "a <|endoftext|> b<|startoftext|>", "<|endoftext|><|endoftext|>", "ΣΑΣ Σ", "İstanbul ǅ", "école", "a\x1cb \x1d c",
    "x y　z", "日本語テキスト 漢字", "🙂🙂 👍🏽", "a" * 700, "=" * 300, "\t\tfoo\r\n\r\n bar", "1234567 89", "\u0085z", "ab\x00c", "Ⅷ ½ ²", "\n\n\n x", "   ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = "ab c'stlrevmd  \n\t.,1éßΣ"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_and_texts_equal_the_library(texts, path):
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, text
        assert own.decode(own.encode(text)).decode() == library.decode(want, skip_special_tokens=False), text


def test_every_vocabulary_word_encodes_like_the_library():
    library, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    words = [w for w in (library.decode([i]) for i in range(0, 50_000, 37)) if w and "�" not in w]
    assert [own.encode(w).tolist() for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_prefix_counts_are_exact_at_every_prefix(texts):
    library, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    for text in texts[:250]:
        if len(text) < 100:
            assert own.prefix_counts(text).tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text
        assert own.count(text) == len(own.encode(text))


def test_packing_library_gives_the_same_ids(texts):
    own, library = bpe.Encoder(BYTE), bpe.library(BYTE)
    assert all(library.encode(t, allowed_special="all") == own.encode(t).tolist() for t in texts)


def test_operators_on_awkward_tables(spark):
    rows = awkward()
    docs = documents(spark, rows)
    library = Tokenizer.from_file(WORD)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = [(d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for (d, _), i in zip(rows, ids)]
    assert sorted(map(tuple, tokens.round_trip(docs, WORD).collect()), key=repr) == sorted(want, key=repr)
    byte = Tokenizer.from_file(BYTE)
    counts = [(d, len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert sorted(map(tuple, tokens.token_counts(docs, BYTE).collect()), key=repr) == sorted(((*c, c[2] > 1024) for c in counts), key=repr)
    decoded = tokens.decode(tokens.encode(docs, BYTE), BYTE).collect()
    assert sorted(map(tuple, decoded), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    for frame in (tokens.round_trip(documents(spark, []), WORD), tokens.token_counts(documents(spark, []), BYTE), tokens.decode(tokens.encode(documents(spark, []), BYTE), BYTE)):
        assert frame.collect() == []


def test_budget_questions_from_stored_counts(spark):
    rows = [(1, "one two three four five"), (2, "  spaces   and don't"), (3, None), (4, "")]
    counted = tokens.prefix_counts(documents(spark, rows), BYTE)
    library = Tokenizer.from_file(BYTE)
    for budget in (0, 2, 4, 50):
        got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in tokens.within_budget(counted, budget).collect()}
        for doc, text in rows:
            sizes = [len(library.encode((text or "")[:k], add_special_tokens=False).ids) for k in range(len(text or "") + 1)]
            best = max(k for k, n in enumerate(sizes) if n <= budget)
            assert got[doc] == (best, sizes[best])
