"""The binary Golay code of 23 bits, as a fuzzy hash.

The code is perfect: each of the 2^23 words lies within three bits of exactly one of its 4,096 codewords. Two words that
differ in at most two bits have a word between them that is at most one bit from either; what that word decodes to is
among the codewords that the word's own one-bit neighbours decode to. So the indices of those codewords are keys of
which two such words always share one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


#: Syndrome of each single bit; syndromes of words are sums of these.
BIT_SYNDROMES = np.array([_remainder(1 << i) for i in range(BITS)], np.int32)


def _correctable() -> np.ndarray:
    """By syndrome, the error pattern of at most three bits that has it."""
    errors = np.zeros(1 << CHECK, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            errors[np.bitwise_xor.reduce(BIT_SYNDROMES[list(bits)])] = sum(1 << b for b in bits)
    return errors


def _byte_syndromes() -> np.ndarray:
    """Syndromes of each value of each byte of a word, [3, 256]."""
    values = np.arange(256)
    table = np.zeros((3, 256), np.int32)
    for i in range(BITS):
        table[i // 8] ^= np.where(values >> (i % 8) & 1, BIT_SYNDROMES[i], 0).astype(np.int32)
    return table


ERRORS, BYTES = _correctable(), _byte_syndromes()


def syndromes(words: np.ndarray) -> np.ndarray:
    return BYTES[0][words & 255] ^ BYTES[1][words >> 8 & 255] ^ BYTES[2][words >> 16]


def decode(words: np.ndarray) -> np.ndarray:
    """Index, in 0..4095, of the codeword nearest to each word."""
    return (words ^ ERRORS[syndromes(words)]) >> CHECK


def neighbour_indices(words: np.ndarray) -> np.ndarray:
    """[..., 24]: the index of the codeword nearest to each word, then to each of its one-bit neighbours."""
    s = syndromes(words)
    out = np.empty((*words.shape, BITS + 1), np.int32)
    out[..., 0] = (words ^ ERRORS[s]) >> CHECK
    for i in range(BITS):
        out[..., i + 1] = (words ^ (1 << i) ^ ERRORS[s ^ BIT_SYNDROMES[i]]) >> CHECK
    return out
