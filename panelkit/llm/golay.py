"""Fuzzy keys from the perfect binary Golay code (23, 12, 7).

Every 23-bit word lies within distance 3 of exactly one codeword. The words at
distance 1 or less from a given word decode to one codeword, or to six when the
word itself is at distance 3 from its own. Two words at distance 2 or less have
a common neighbour within distance 1 of both, so they share a codeword.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: Generator polynomial of the code (fixed value).
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 12-bit halves, and for each syndrome up to six error patterns and how many there are."""
    unit = [_remainder(1 << b) for b in range(BITS)]
    halves = np.zeros((2, 4096), np.int64)
    for h in range(2):
        for b in range(12):
            if h * 12 + b < BITS:
                halves[h] ^= np.where(np.arange(4096) >> b & 1, unit[h * 12 + b], 0)
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    leader = np.zeros(2048, np.int64)
    for weight in range(5):
        for chosen in combinations(range(BITS), weight):
            syndrome = 0
            for b in chosen:
                syndrome ^= unit[b]
            if weight < 4:
                leader[syndrome] = weight
            elif leader[syndrome] != 3:
                continue
            patterns[syndrome, count[syndrome]] = sum(1 << b for b in chosen)
            count[syndrome] += 1
    return halves, patterns, count


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word its 12-bit codeword indices, six columns, and how many of them hold (1 or 6)."""
    halves, patterns, count = _tables()
    words = words.astype(np.int64)
    syndrome = halves[0][words & 4095] ^ halves[1][words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]
