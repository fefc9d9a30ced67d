"""Minimal perfect hashing of 128-bit keys: levels of bit arrays, the n-th set bit being slot n."""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a level for each key that is left, and the most levels before the rest is kept as a plain list.
LOAD, LEVELS = 2.0, 48


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(a + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) ^ b) % np.uint64(size)


class Shard:
    """Slots of a set of keys (a, b), and two arrays by slot: a fingerprint, which is b whole, and a count."""

    def __init__(self, sizes: list[int], words: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.sizes, self.words, self.fingerprints, self.counts = sizes, words, fingerprints, counts
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def build(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> Shard:
        """Keys must be distinct pairs; those left after the last level (none, in practice) raise an error."""
        sizes, levels, x, y = [], [], a, b
        while len(x):
            if len(sizes) == LEVELS:
                raise ValueError("keys repeat or can't be told apart")
            size = max(64, int(LOAD * len(x)) + 63 & ~63)
            at = _place(x, y, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            x, y = x[left], y[left]
        shard = Shard(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.zeros(len(a), "<u8"), np.zeros(len(a), "<u4"))
        slot = shard.slots(a, b)
        shard.fingerprints[slot], shard.counts[slot] = b, np.minimum(counts, 2**32 - 1)
        return shard

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not in the set: any slot, or -1."""
        out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = _place(a[left], b[left], level, size).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.before[at >> 6] + below)[here]
            left, base = left[~here], base + size
        return out

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for keys that are not in the set."""
        slot = self.slots(a, b)
        found = slot >= 0
        found[found] = self.fingerprints[slot[found]] == b[found]
        out = np.zeros(len(a), np.int64)
        out[found] = self.counts[slot[found]]
        return out

    def dump(self) -> bytes:
        head = struct.pack(f"<III{len(self.sizes)}I", len(self.sizes), len(self.words), len(self.counts), *self.sizes)
        return head + self.words.tobytes() + self.fingerprints.tobytes() + self.counts.tobytes()

    @staticmethod
    def load(data: bytes) -> Shard:
        levels, words, n = struct.unpack_from("<III", data)
        sizes, at = list(struct.unpack_from(f"<{levels}I", data, 12)), 12 + 4 * levels
        parts = []
        for kind, m, width in (("<u8", words, 8), ("<u8", n, 8), ("<u4", n, 4)):
            parts.append(np.frombuffer(data, kind, m, at))
            at += m * width
        return Shard(sizes, *parts)
