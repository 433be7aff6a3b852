"""Words of a text, as all operators here see them, and stable 64-bit hashes of words and shingles in numpy."""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash

#: Case, punctuation and kind of spacing never count: what is neither letter, digit nor space goes, case is folded.
_OTHER = re.compile(r"[^\w\s]|_")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[str]:
    """The words of a text: runs without white space, without punctuation and case; words of punctuation only are none."""
    return _OTHER.sub("", text.lower()).split() if text else []


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:  # it is only a memo; memory stays bounded
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_codes = _Codes()


def hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_codes.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words, from the hashes of the words, in order and with repetitions."""
    n = len(h) - q + 1
    if n < 1:
        return h[:0]
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def many(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts in one array, and the number of words of each."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(_codes.__getitem__, itertools.chain.from_iterable(lists)), np.uint64, int(size.sum())), size


def many_shingles(h: np.ndarray, size: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of q words within the texts of many(), and the text of each."""
    n = max(len(h) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    text = np.repeat(np.arange(len(size)), size)
    inside = text[:n] == text[len(h) - n :]
    return mix(mix(out[inside])), text[:n][inside]
