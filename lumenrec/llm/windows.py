"""Hashes of words and of word windows, as NumPy arrays, for operators that compare texts in tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_P = 0x9E3779B97F4A7C17
_MASK = (1 << 64) - 1


class _Words(dict):
    """64-bit hashes of words; words met before are looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


_words = _Words()


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; bytes.split() and bytes.lower() know ASCII alone."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing steps that spread every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_sums(w: np.ndarray, size: int, p: int = _P) -> np.ndarray:
    """Polynomial sums of all windows, by doubling: two of one length make one of twice that length."""
    if len(w) < size:
        return w[:0]
    total, have, part, length = None, 0, w, 1
    while size:
        if size & 1:
            if total is None:
                total, have = part, length
            else:
                n = min(len(total), len(part) - have)
                total = total[:n] * np.uint64(pow(p, length, 1 << 64)) + part[have : have + n]
                have += length
        size >>= 1
        if size:
            n = len(part) - length
            part = part[:n] * np.uint64(pow(p, length, 1 << 64)) + part[length : length + n]
            length *= 2
    return total


def window_hashes(w: np.ndarray, size: int, p: int = _P) -> np.ndarray:
    """64-bit hashes of all windows of so many words, by start."""
    return mix(window_sums(w, size, p))
