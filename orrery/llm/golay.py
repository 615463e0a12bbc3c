"""The perfect binary Golay code [23, 12, 7] as numpy tables, built from its generator.

Every 23-bit word lies within distance 3 of exactly one codeword. Two words at
distance 1 or less share an index among those that the ball of radius 1 around one of
them decodes to: 1 index if the word is within 2 of its codeword, else 6.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, length and dimension.
GENERATOR, LENGTH, DIMENSION = 0b110001110101, 23, 12
PARITY = LENGTH - DIMENSION


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits, and the lightest error of each syndrome."""
    high = np.array([_remainder(m << PARITY) for m in range(1 << DIMENSION)], np.int64)
    leader = np.zeros(1 << PARITY, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            leader[high[error >> PARITY] ^ (error & (1 << PARITY) - 1)] = error
    return high, leader


def decode(words: np.ndarray) -> np.ndarray:
    """The index (message bits) of the codeword nearest to each 23-bit word."""
    high, leader = _tables()
    syndrome = high[words >> PARITY] ^ (words & (1 << PARITY) - 1)
    return (words ^ leader[syndrome]) >> PARITY


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for the distinct indices of each word and of the words that differ
    from it in one of its lowest ``bits`` bits."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]
