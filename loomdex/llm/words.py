"""Words, and hashes of runs of consecutive words, for a slice of documents at a time."""

from __future__ import annotations

import numpy as np
import regex
import xxhash

from .crosspoly import mix64

#: A word is a longest run of letters and digits of any script in the lower-cased text.
WORD = regex.compile(r"[\p{L}\p{N}]+")


class WordHashes(dict):
    """Word -> 64-bit hash, kept for the words seen lately."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words of all texts as hashes, and the offsets at which each text's words begin and end."""
    lists = [words_of(t) for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((cache[w] for x in lists for w in x), np.uint64, int(offsets[-1]))
    return flat, offsets


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words that lie within one text: (text number, word position, hash)."""
    n = len(flat) - k + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += mix64(flat[j : j + n], j + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(n)
    whole = start + k <= offsets[doc[:n] + 1]
    return doc[:n][whole], (start - offsets[doc[:n]])[whole], mix64(total[whole])


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ordered by text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
