"""A minimal perfect hash over pairs of 64-bit words.

Keys are placed level by level: at each level a key goes to the bit that its
hash names, keys alone on their bit stay there, and the others go on to the next
level.  A key's slot is the number of set bits before its own, so ``n`` keys get
the slots 0 to n - 1 at about three bits a key.  A foreign key may find any
slot, so users store a fingerprint beside each slot.
"""

from __future__ import annotations

import struct

import numpy as np

from tessella.llm.common import mix

GAMMA = 1.6
MAX_LEVELS = 200


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base, at = [], 0
        self.before = []
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(np.cumsum(ones) - ones)
            self.base.append(at)
            at += int(ones.sum())
        self.size = at

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        return mix(mix(a ^ seed) ^ b) % np.uint64(bits)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "MinimalPerfectHash":
        """The pairs ``(a[i], b[i])`` have to be distinct."""
        a, b, levels = a.astype(np.uint64), b.astype(np.uint64), []
        while len(a):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys of a minimal perfect hash have to be distinct")
            bits = max(64, -(-int(GAMMA * len(a)) // 64) * 64)
            at = cls._place(a, b, len(levels), bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits)[at] == 1
            flags = np.zeros(bits, np.uint8)
            flags[at[alone]] = 1
            levels.append(np.packbits(flags, bitorder="little").view(np.uint64))
            a, b = a[~alone], b[~alone]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1 where no level has its bit."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(a[left], b[left], level, len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = words[word]
            here = (value >> bit) & np.uint64(1) == 1
            low = value & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.base[level] + self.before[level][word] + np.bitwise_count(low).astype(np.int64)
            out[left[here]] = slot[here]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<I{len(self.levels)}Q", len(self.levels), *map(len, self.levels))
        return head + b"".join(x.astype("<u8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> "MinimalPerfectHash":
        (n,) = struct.unpack_from("<I", data)
        sizes = struct.unpack_from(f"<{n}Q", data, 4)
        at, levels = 4 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels)
