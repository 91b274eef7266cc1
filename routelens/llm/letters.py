"""Letter runs of whole texts as code arrays, and hashed n-grams of them."""

from __future__ import annotations

import numpy as np

from .pretokens import LETTER, character_classes

_TABLE: list[np.ndarray] = []
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-case text; each run of other characters is one 0, as are both ends."""
    if not _TABLE:
        _TABLE.append(character_classes() == LETTER)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    code = np.where(_TABLE[0][code], code, 0).astype(np.uint64)
    code = np.concatenate([[0], code, [0]]).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    return code[keep]


def grams(codes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash for each run of n codes, in order."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(size, np.uint64(salt * 0x100000001B3 + n))
    for i in range(n):
        h = (h ^ codes[i:i + size]) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def grams_at(codes: np.ndarray, n: int, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hashes that ``grams`` gives at these places."""
    h = np.full(len(at), np.uint64(salt * 0x100000001B3 + n))
    for i in range(n):
        h = (h ^ codes[at + i]) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def hashed_words(codes: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit hash for each letter run."""
    at = np.flatnonzero((codes[1:] != 0) & (codes[:-1] == 0)) + 1
    if not len(at):
        return np.zeros(0, np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.append(0, at), np.diff(np.concatenate([[0], at, [len(codes)]])))
    h = (codes + np.uint64(salt)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _PRIME
    h ^= h >> np.uint64(31)
    h = np.where(codes != 0, h * _PRIME, 0)
    total = np.add.reduceat(h, at) * _PRIME
    return total ^ (total >> np.uint64(29))
