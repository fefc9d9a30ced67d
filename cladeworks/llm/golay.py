"""The perfect binary Golay code of 23 bits: every word is within 3 bits of one codeword of 2**12."""

from __future__ import annotations

import functools
import itertools

import numpy as np

BITS, CHECK = 23, 11
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


@functools.cache
def _tables():
    """Remainders of single bits, by halves of a word; the error pattern of each remainder."""
    single = [_remainder(1 << i) for i in range(BITS)]
    halves = []
    for at in (0, 12):
        t = np.zeros(1 << min(12, BITS - at), np.int64)
        for i in range(min(12, BITS - at)):
            t[1 << i : 2 << i] = t[: 1 << i] ^ single[at + i]
        halves.append(t)
    errors = np.zeros(1 << CHECK, np.int64)
    for n in (1, 2, 3):
        for bits in itertools.combinations(range(BITS), n):
            r = 0
            for i in bits:
                r ^= single[i]
            errors[r] = sum(1 << i for i in bits)
    return halves, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of each word's nearest codeword."""
    (low, high), errors = _tables()
    return (words ^ errors[low[words & 4095] ^ high[words >> 12]]) >> CHECK


def nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """Indexes of each word and of its neighbours at one of the first ``bits`` bits, a column each; repeats are -1.

    Two words that differ in one bit: each one's own index is among the other's. In two bits: they have a neighbour
    in common, so an index too. A word that is 3 bits off its codeword has six different indexes, any other one.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    out = np.sort(decode(words[:, None] ^ flips), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out
