"""The perfect binary Golay code of 23 bits, as a fuzzy hash of bit strings."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, CHECK_BITS = 23, 11
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(value: int) -> int:
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - CHECK_BITS)
    return value


@cache
def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders of each byte of a word, and the error of up to three bits for each remainder."""
    bits = [_remainder(1 << i) for i in range(BITS)]
    bytes_ = []
    for low in (0, 8, 16):
        table = np.zeros(256, np.int32)
        for i in range(min(8, BITS - low)):
            table[(np.arange(256) >> i & 1) == 1] ^= bits[low + i]
        bytes_.append(table)
    errors = np.zeros(1 << CHECK_BITS, np.int32)
    for weight in (1, 2, 3):
        for places in combinations(range(BITS), weight):
            rest = 0
            for place in places:
                rest ^= bits[place]
            errors[rest] = sum(1 << place for place in places)
    return bytes_, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    bytes_, errors = _tables()
    words = words.astype(np.int32)
    rest = bytes_[0][words & 255] ^ bytes_[1][words >> 8 & 255] ^ bytes_[2][words >> 16]
    return (words ^ errors[rest]) >> CHECK_BITS


def nearby(words: np.ndarray, used_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)``: the distinct codeword indices of each word and of all words one bit away.

    Two words that differ in at most two of the ``used_bits`` share an index: that
    of the word between them. A word within two bits of its codeword has one
    index, any other at most six.
    """
    flips = np.concatenate([[0], 1 << np.arange(used_bits)]).astype(np.int32)
    indices = np.sort(decode(words.astype(np.int32)[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(indices.shape, bool)
    fresh[:, 1:] = indices[:, 1:] != indices[:, :-1]
    rows, columns = np.nonzero(fresh)
    return rows, indices[rows, columns]
