"""A minimal perfect hash over 128-bit keys, built and probed with NumPy.

Levels of bitmaps: on each level the keys that hit a position alone take it, the others go on to the
next level. A key's slot is the rank of its bit over all levels, so n keys get the slots 0 to n-1.
"""

from __future__ import annotations

import io

import numpy as np

from parquill.llm.arrow import mix

#: Bits a key on each level.
GAMMA = 2.0
_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    def __init__(self, words: np.ndarray, bits: np.ndarray) -> None:
        """words: the levels' bitmaps, one after the other; bits: each level's number of bits."""
        self.words, self.bits = words, bits
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])[:-1]
        self.first = np.concatenate([[0], np.cumsum(bits // 64)])[:-1]

    @staticmethod
    def _base(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return mix(high.view(np.uint64) ^ mix(low.view(np.uint64)))

    @staticmethod
    def _at(base: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(base + np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """high, low: int64 halves of distinct keys."""
        left, words, sizes, level = cls._base(high, low), [], [], 0
        if len(np.unique(left)) != len(left):
            raise ValueError("keys are not distinct")
        while len(left):
            bits = 64 * max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = cls._at(left, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left, level = left[~alone[at]], level + 1
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has it. A foreign key may get any slot."""
        out = np.full(len(high), -1, np.int64)
        base, left = self._base(high, low), np.arange(len(high))
        for level, bits in enumerate(self.bits):
            at = self._at(base[left], level, int(bits))
            word = self.first[level] + (at >> 6)
            shift = (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> shift) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out


def dump(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as held:
        return {k: held[k] for k in held.files}
