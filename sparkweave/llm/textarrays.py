"""Words and character grams of many texts at once, as numpy arrays.

Texts are lower-cased and laid out as one code-point array, so that the cost per
character is a handful of vector operations. A word is a maximal run of letters,
digits, marks and underscores.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        ch = chr(c)
        table[c] = ch.isalnum() or ch == "_" or (c > 0x2FF and unicodedata.category(ch)[0] == "M")
    return table


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a group of texts: ``[start, end)`` in the code points, text number and 64-bit hash."""

    codes: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray

    def gram(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the code points ``[start, end)``, the same wherever they stand."""
        inverse = _powers(len(self.prefix))[1]
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start])


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a space after each, and where each text starts."""
    low = [t.lower() for t in texts]
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in low], out=offsets[1:])
    return np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def words_of(texts: list[str]) -> Words:
    codes, offsets = codes_of(texts)
    edge = np.diff(_word_table()[codes].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(len(codes))[0], out=prefix[1:])
    out = Words(codes, offsets, start, end, np.searchsorted(offsets, start, side="right") - 1, start, prefix)
    out.hash = out.gram(start, end)
    return out


def groups(texts: list[str], chars: int = 500_000):
    """Ranges of texts of about so many characters together; a longer text is a range of its own."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield lo, k
            lo, size = k, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
