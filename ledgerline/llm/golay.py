"""The binary Golay code of length 23: every word lies within three bits of exactly one codeword."""

from __future__ import annotations

import itertools

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101
LENGTH = 23


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 12, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


#: The syndrome of a word is the XOR of those of its low 12 and high 11 bits; the code corrects any three errors.
LOW = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.uint32)
HIGH = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.uint32)
ERRORS = np.zeros(1 << 11, dtype=np.uint32)
for _n in range(4):
    for _bits in itertools.combinations(range(LENGTH), _n):
        _e = sum(1 << b for b in _bits)
        ERRORS[_remainder(_e)] = _e


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest codeword of each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ ERRORS[LOW[words & 0xFFF] ^ HIGH[words >> 12]]) >> 11


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, present2, present1), each of shape (n, 6).

    The indices are those of the codewords nearest to the word or to a word one bit from it; a word has one or six. Words
    that differ in at most two bits share one marked in present2, since some word lies within one bit of both.
    present1 marks the word's own index and the smaller ones; words that differ in at most one bit share one of
    these, since the smaller of their own indices is marked on both sides.
    """
    own = decode(words)
    flips = np.concatenate([np.zeros(1, dtype=np.uint32), np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)])
    found = np.sort(decode(words.astype(np.uint32)[:, None] ^ flips[None, :]), axis=1)
    first = np.ones_like(found, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    slot = np.cumsum(first, axis=1) - 1
    n = len(words)
    out = np.zeros((n, 6), dtype=np.uint64)
    here = np.zeros((n, 6), dtype=bool)
    row, col = np.nonzero(first)
    out[row, slot[row, col]] = found[row, col]
    here[row, slot[row, col]] = True
    return out, here, here & (out <= own[:, None])
