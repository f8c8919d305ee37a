"""Minimal perfect hashing of distinct 128-bit keys, in numpy."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it.
SPARE = 2.0
#: Odd multipliers of the 64-bit mixer.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _places(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key in a level; both halves take part, so different keys part sooner or later."""
    odd = np.uint64((2 * level + 1) * int(MIX[0]) % (1 << 64))
    x = low + (high | np.uint64(1)) * odd + (high >> np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class Hash:
    """Sends n distinct keys (two unsigned 64-bit halves) to 0..n-1, and any other key to some number or to -1.

    A level is a bit array twice as long as the keys that reach it; a key whose place no other key of
    the level shares is settled there, the others go on to the next. A key's number is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]
        self.starts = np.cumsum([0, *[int(bits.sum()) for bits in levels]])

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray) -> Hash:
        levels = []
        while len(low):
            size = max(8, int(SPARE * len(low)))
            at = _places(low, high, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            low, high = low[~alone[at]], high[~alone[at]]
        return cls(levels)

    def numbers(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, left = np.full(len(low), -1, np.int64), np.arange(len(low))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _places(low[left], high[left], level, len(bits))
            settled = bits[at]
            out[left[settled]] = self.starts[level] + ranks[at[settled]]
            left = left[~settled]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Hash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes:
            wide = -(-int(size) // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, wide, at), count=int(size)).astype(bool))
            at += wide
        return cls(levels)
