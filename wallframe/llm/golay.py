"""The binary Golay code [23, 12, 7] as a fuzzy hash.

The code is perfect: every 23-bit word lies within three bits of exactly one of 4096 codewords.
``near_indices`` decodes a word and the words one bit away, which gives one or six codeword
numbers.  Two words that differ in at most two bits have a word in between, one bit from either,
so they share a number.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the cyclic code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the three bytes of a word, and the error of up to three bits of each remainder."""
    single = [_remainder(1 << bit) for bit in range(24)]
    bytewise = np.zeros((3, 256), dtype=np.int64)
    for part in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * part + bit < LENGTH:
                    bytewise[part, value] ^= single[8 * part + bit]
    errors = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << bit for bit in bits)
            errors[_remainder(pattern)] = pattern
    return bytewise, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Numbers (0 to 4095) of the codewords nearest to 23-bit words."""
    bytewise, errors = _tables()
    rest = bytewise[0, words & 255] ^ bytewise[1, words >> 8 & 255] ^ bytewise[2, words >> 16]
    return (words ^ errors[rest]) >> CHECKS


def near_indices(words: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): codeword numbers of each word and of its neighbours in the lowest ``bits`` bits."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    numbers = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(numbers.shape, dtype=bool)
    new[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
    rows, columns = np.nonzero(new)
    return rows, numbers[rows, columns]
