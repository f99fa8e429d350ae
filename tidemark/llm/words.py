"""Words and word n-grams as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from . import common

_WORD = re.compile(r"\w+")
#: Distinct words that one worker remembers; beyond, it starts anew.
REMEMBERED = 150_000
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


_KNOWN = common.remembered("words", _Hashes())


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower())


def hashes(words: list[str]) -> np.ndarray:
    return np.array([_KNOWN[w] for w in words], "u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words than n, one of all of them; of none, none."""
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.zeros(len(h) - n + 1, "u8")
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _PRIMES[i]
    return mix(total + np.uint64(n))
