"""Vectorised word splitting and hashing of whole text batches.

A word is a maximal run of bytes other than space and \\x09-\\x0D; as these
separators are ASCII, splitting UTF-8 bytes equals splitting code points.
Hashes are 64-bit polynomial hashes read off prefix sums, so any span of a
text (word, line, n-gram) costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bytes of text handled at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 500_000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.Generator(np.random.PCG64(20_240_607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(log_n: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log_n
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    up, down = _powers(max(16, int(n + 1).bit_length()))
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, for span_hash."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal content gives equal hashes."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def window_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every window of n consecutive entries."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(hashes) - n + 1)
    return span_hash(prefix_sums(hashes), at, at + n)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


@dataclass
class Words:
    """The words of a run of documents, in order.

    ``first``/``last`` are byte positions in ``raw``; words of document i are
    ``bounds[i]:bounds[i + 1]``, its bytes ``text[i]:text[i + 1] - 1``.
    """

    raw: bytes
    bytes_: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    bounds: np.ndarray

    def sums(self) -> np.ndarray:
        return prefix_sums(_BYTE_CODES[self.bytes_])

    def hashes(self) -> np.ndarray:
        return span_hash(self.sums(), self.first, self.last)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_words(texts: list[str | None]) -> Words:
    """Splits documents into words; a null text has none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts) + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    text = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=text[1:])
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[1:] = _IS_SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edges[::2], edges[1::2]
    return Words(raw, data, text, first, last, np.searchsorted(first, text))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES, most: int = 1000) -> Iterator[tuple[int, int]]:
    """Index ranges of documents of about ``limit`` characters, ``most`` texts at most."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "") + 1
        if i > start and (held + size > limit or i - start >= most):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
