"""The perfect binary Golay code (23, 12): 23-bit words to the indices of nearby codewords.

Every word is within 3 errors of exactly one codeword. Codewords within 4 errors of a word are its
keys: one key for words at most 2 from their codeword, six for the others. Two words that differ in
at most 2 bits always share a key, since the word halfway between them has a codeword within 3.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011
WIDTH, RADIUS = 23, 4


def _remainder(word: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome: the polynomial's remainder by the generator."""
    word = word.copy()
    for bit in range(WIDTH - 1, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; per syndrome up to six error patterns (nearest first) and their number."""
    one = _remainder(1 << np.arange(WIDTH, dtype=np.int64))
    patterns = [[] for _ in range(2048)]
    for weight in range(RADIUS + 1):
        for bits in combinations(range(WIDTH), weight):
            e = sum(1 << b for b in bits)
            s = 0
            for b in bits:
                s ^= int(one[b])
            patterns[s].append(e)
    table = np.zeros((2048, 6), np.int64)
    for s, p in enumerate(patterns):
        table[s, : len(p)] = p
    return one, table, np.array([len(p) for p in patterns])


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 errors of each word."""
    words = np.asarray(words, np.int64)
    _, table, _ = _tables()
    return (words ^ table[_remainder(words), 0]) >> 11


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within 4 errors: (position in words, index), flattened."""
    words = np.asarray(words, np.int64)
    _, table, count = _tables()
    s = _remainder(words)
    n = count[s]
    row = np.repeat(np.arange(len(words)), n)
    col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (words[row] ^ table[s[row], col]) >> 11
