"""Texts of an Arrow batch as flat numpy arrays: slices of bounded size, words and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Separators of words: the pattern `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, row past the last, bytes, offsets) for runs of rows of up to `limit` bytes; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, per-document word offsets) of the words of texts that lie one after the other."""
    inside = ~SPACES[data]
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[offsets], last[offsets] = True, True
    before = np.concatenate(([False], inside[:-1])) & ~first[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~last[1:] if len(data) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of many spans of one array of symbols, from one running sum."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, symbols: int = 256):
        self.values = mix(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        with np.errstate(over="ignore"):
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[data] * self.up[:len(data)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.down[starts]
            return mix(h + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int):
    """Hashes of every k consecutive words of each document, with their offsets; fewer words than k give one shingle."""
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.arange(out_offsets[-1]) - out_offsets[doc] + offsets[doc]
    end = offsets[doc + 1]
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + np.where(at + j < end, padded[at + j], np.uint64(0x5851F42D4C957F2D))
    return mix(h), out_offsets


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of runs that follow one another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
