"""Exact byte-pair encoding from a tokenizer file: Aho-Corasick matches and a pair-compatibility table.

Everything here runs inside tasks, on one text at a time; the operators deal the texts out. Two file
kinds are read: byte-level vocabularies split by the usual word pattern, and lower-case word
vocabularies with a word-end suffix. Built tables and the encodings of recent pieces are kept per
Python worker, within fixed sizes.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
import tiktoken

#: Entries of a piece cache and of the pair memo of one Python worker, and the longest piece kept.
CACHE = 300_000
PIECE = 48

#: The word patterns of the two file kinds, with white space named by its property.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
SUFFIX_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
LONG_ENDINGS = ("'re", "'ve", "'ll")

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = regex.compile(r"\p{White_Space}+")
#: Counted as white space by str.split but not by the tokenizer files.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """Letter of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Byte strings by number in one buffer with offsets; joins those of many numbers in one gather."""

    def __init__(self, entries: list[bytes]):
        sizes = np.array([len(x) for x in entries], np.int64)
        self.sizes, self.starts, self.data = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.data[shift + np.arange(len(shift))].tobytes()


class Pieces(dict):
    """Encodings of pieces, made when first asked for; emptied when full. Long pieces are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(piece) <= PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = made
        return made


class Unsafe(ValueError):
    """A piece whose white space reaches over its edge, so that it can't be split off alone."""


class Encoder:
    """Encoding, decoding and prefix counts of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.words = regex.compile(SUFFIX_WORDS if self.suffix else BYTE_WORDS)
        self.base = bool(self.suffix) * 256

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            out = [chr(letters[c]) for c in (token.removesuffix(self.suffix) if ends else token)]
            return "".join(out[:-1]) + chr(ord(out[-1]) + self.base * ends)

        size = max(*model["vocab"].values(), *self.special.values()) + 1
        self.size = [0] * size
        self.shorter = [-1] * size
        self.halves = [(i, i) for i in range(size)]
        self.pairs: dict[int, int] = {}
        names, shown = {}, [b""] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            names[symbols(token)] = i
            shown[i] = token.encode() + b" " if spec["decoder"] is None else bytes(map(letters.__getitem__, token))
        for text, i in names.items():
            self.size[i] = len(text)
            self.shorter[i] = next((names[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in names), -1)
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        for left, right in model["merges"]:
            a, b, c = (model["vocab"][t] for t in (left, right, left + right))
            self.pairs[a << 20 | b] = c
            self.halves[c] = (a, b)
        for token, i in self.special.items():
            shown[i] = token.encode() + b" " * (spec["decoder"] is None)
        self.joined = spec["decoder"] is None
        self.shown = Table(shown)
        self.decimal = Table([b"%d " % i for i in range(size)])
        self.memo: dict[int, bool] = {}
        self.heads, self.tails = Pieces(self._piece), Pieces(self._tail)
        self.tokens = Pieces(lambda word: np.array(self.backtrack(self.symbols(word)), "<u4").tobytes())
        self.ends = Pieces(lambda word: self.prefixes(self.symbols(word)))
        self.head_counts, self.tail_counts = Pieces(self._count), Pieces(self._tail_count)

    # One word

    def symbols(self, word: str) -> str:
        out = word.encode().decode("latin-1")
        return out[:-1] + chr(ord(out[-1]) + self.base) if self.base else out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b standing side by side."""
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= CACHE:
                self.memo.clear()
            known = self.memo[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the later merge of the two tokens again and again; an earlier merge over the border breaks them."""
        pairs, halves, limit = self.pairs, self.halves, 1 << 40
        while pairs.get(a << 20 | b, limit) >= limit:
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True
        return False

    def backtrack(self, text: str) -> list[int]:
        """Token ids of a word: the longest match that fits the token before; a dead end steps back once.

        A position found to be a dead end is never entered again, so the steps are linear in the word.
        """
        longest, n = [-1] * len(text), len(text)
        for end, (size, token) in self.automaton.iter(text):
            longest[end - size + 1] = token  # ends only grow, so the last one kept is the longest
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            end = at + self.size[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                back = out.pop()
                at -= self.size[back]
                token = self.shorter[back]
        return out

    def prefixes(self, text: str) -> list[int]:
        """Token count of every prefix of a word, the empty one first.

        The last token of a prefix is the one match ending there that fits the last token of what is before it.
        """
        last, count = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (size, token) in self.automaton.iter(text):
            start = end + 1 - size
            if not count[end + 1] and (start == 0 or self.compatible(last[start], token)):
                last[end + 1], count[end + 1] = token, count[start] + 1
        return count

    # Whole texts

    def _tail(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Unsafe
        return self._piece(" " + piece)

    def _tail_count(self, piece: str) -> int:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Unsafe
        return self._count(" " + piece)

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.words.findall(piece)))

    def _count(self, piece: str) -> int:
        return sum(self.ends[word][-1] for word in self.words.findall(piece))

    def _pieces(self, text: str, heads: Pieces, tails: Pieces) -> Iterator:
        """What the caches hold for the pieces of a text without special strings.

        Byte-level words reach over white space only where two such characters meet, so a text may be
        cut before a space between two others. Words of a suffix vocabulary never hold white space.
        """
        if self.suffix:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return map(heads.__getitem__, _SPACES.split(text) if _SEPARATORS.search(text) else text.split())
        first, *rest = text.split(" ")
        try:
            if first and not first[0].isspace() and not first[-1].isspace():
                return iter([heads[first], *map(tails.__getitem__, rest)])
        except Unsafe:
            pass
        first, *rest = _SAFE_SPACE.split(text)
        return iter([heads[first], *(heads[" " + x] for x in rest)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special strings inside it become their own id."""
        if not self._has_special(text):
            return np.frombuffer(b"".join(self._pieces(text, self.heads, self.tails)), "<u4")
        out = []
        for part in self._parts(text):
            out.append(np.array([self.special[part]], "<u4") if part in self.special else np.frombuffer(b"".join(self._pieces(part, self.heads, self.tails)), "<u4"))
        return np.concatenate(out)

    def count(self, text: str) -> int:
        """Number of ids of a whole text, from the last prefix count of each word."""
        if not self._has_special(text):
            return sum(self._pieces(text, self.head_counts, self.tail_counts))
        return sum(1 if part in self.special else sum(self._pieces(part, self.head_counts, self.tail_counts)) for part in self._parts(text))

    def _has_special(self, text: str) -> bool:
        return any(x in text for x in self.special)

    def _parts(self, text: str) -> list[str]:
        return [x for x in self.specials.split(text) if x]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids, special ones included; ill-formed bytes are replaced as a decoder does."""
        out = self.shown.join(ids)
        return out[:-1] if self.joined else out.decode(errors="replace").encode()

    def prefix_counts(self, text: str) -> np.ndarray:
        """Ids of the first k characters for every k from 0, byte-level vocabularies only.

        A prefix that ends in white space takes its whole run as one word; one that ends inside a long
        contraction has its quote alone; one that ends inside a special string has ordinary text there.
        """
        if self.suffix:
            raise ValueError("prefix counts need a byte-level vocabulary")
        out, base = [np.zeros(1, np.int64)], 0
        before = ""
        for part in self._parts(text):
            if part in self.special:
                start = base - (self.count(before) if before else 0)
                out.append(np.array([*(start + self.count(before + part[:k]) for k in range(1, len(part))), base + 1]))
                base, before = base + 1, ""
                continue
            counts = np.zeros(len(part), np.int64)
            at, total, run, run_total = 0, base, "", base
            for word in self.words.findall(part):
                ends = np.array(self.ends[word])
                counts[at : at + len(word)] = total + ends[np.cumsum([len(c.encode()) for c in word])]
                if word in LONG_ENDINGS:
                    counts[at + 1] = total + 2
                spaces = _SPACES.match(word)
                if spaces and run:  # a prefix that ends here takes the run so far as one word
                    held = np.array(self.ends[run + spaces[0]])
                    sizes = np.cumsum([len(c.encode()) for c in run + spaces[0]])
                    counts[at : at + len(spaces[0])] = run_total + held[sizes[len(run) :]]
                if not spaces or spaces[0] != word:
                    run = ""
                else:
                    run, run_total = run + word, run_total if run else total
                at, total = at + len(word), total + int(ends[-1])
            out.append(counts)
            base, before = total, part
        return np.concatenate(out)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, built once per Python worker."""
    return Encoder(path)


@functools.lru_cache(maxsize=4)
def library(path: str) -> tiktoken.Encoding:
    """The library's encoding of a byte-level tokenizer file: the same ids, for operators that only need them."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    ranks = {bytes(map(letters.__getitem__, token)): i for token, i in spec["model"]["vocab"].items()}
    pattern = BYTE_WORDS.replace(r"[^\p{White_Space}]", r"\S").replace(r"\p{White_Space}", r"\s")
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
