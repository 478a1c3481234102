"""Words of a page and fast 64-bit hashes of word runs, vectorised over a batch of texts."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after removal of invisible characters, NFKC and lower-casing.

    A null or empty text has no words.
    """
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


class _WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it grows too large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value


_HASHES = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Batch:
    """Word hashes of many texts, laid end to end. Texts with fewer than ``least`` words are left out.

    ``rows`` holds the kept texts' positions in the input, ``starts`` where their words begin.
    """

    def __init__(self, texts: list[str | None], least: int):
        rows, counts, flat = [], [], []
        get = _HASHES.__getitem__
        for i, text in enumerate(texts):
            words = words_of(text)
            if len(words) >= least:
                rows.append(i)
                counts.append(len(words))
                flat.extend(map(get, words))
        self.rows = np.array(rows, dtype=np.int64)
        self.counts = np.array(counts, dtype=np.int64)
        self.hashes = np.array(flat, dtype=np.uint64)
        self.starts = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(self.counts, out=self.starts[1:])

    def __len__(self) -> int:
        return len(self.rows)

    def text_keys(self) -> np.ndarray:
        """A 64-bit key of each text's whole word sequence."""
        n = len(self.hashes)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        place = np.arange(n, dtype=np.uint64) - np.repeat(self.starts[:-1], self.counts).astype(np.uint64)
        mixed = mix(self.hashes + (place + np.uint64(1)) * _M1)
        return mix(np.add.reduceat(mixed, self.starts[:-1]) + self.counts.astype(np.uint64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside a text, and where each text's runs begin (one more at the end)."""
        h = self.hashes
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(self) + 1, dtype=np.int64)
        acc = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            acc = mix(acc * _M1 + h[k : k + n] + np.uint64(k + 1))
        last = np.repeat(self.starts[1:], self.counts)[:n]  # the end of the text that each word is of
        keep = np.arange(n) + width <= last
        runs = np.maximum(self.counts - width + 1, 0)
        starts = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(runs, out=starts[1:])
        return acc[keep], starts
