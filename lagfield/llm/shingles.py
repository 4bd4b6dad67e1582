"""Word shingles of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word is a run of characters other than space and ``\\t``-``\\r``; A-Z count as a-z.  Bytes are mapped to random
64-bit numbers and weighted by powers of an odd base, so that the hash of any word is a difference of two running sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
BLOCK = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power 0 .. n-1, modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together and the n+1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: int, size: int = BLOCK):
    """Arrow batches cut so that a column of texts holds about ``size`` bytes in each, one row at least."""
    for batch in batches:
        _, offsets = as_bytes(batch.column(column))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of its first word for each text (n+1 entries)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_BLANK[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] |= inside[cut]
    ends = inside[:-1] & ~inside[1:]
    last = cut[cut > 0] - 1
    ends[last] |= inside[last]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up = _powers(_BASE, len(data))
    down = _powers(_INVERSE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin]), np.searchsorted(begin, offsets)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and the n+1 offsets of the texts.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = as_bytes(texts)
    values, counts = [], []
    first = 0
    while first < len(offsets) - 1:  # a block of whole texts at a time bounds memory
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        got, n = _sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
        values.append(got)
        counts.append(n)
        first = last
    bounds = np.zeros(len(offsets), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=bounds[1:])
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), bounds


def word_counts(texts: pa.Array, cells: int) -> np.ndarray:
    """Number of words of all texts in each of ``cells`` (a power of 2) cells of word hashes."""
    words, _ = _words(*as_bytes(texts))
    return np.bincount((words & np.uint64(cells - 1)).astype(np.int64), minlength=cells)


def shingle_weights(texts: pa.Array, weights: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts, sorted, and for each the sum over its words of the weight of their cell."""
    data, offsets = as_bytes(texts)
    hashes, words, start, left, _, _ = _all(data, offsets, width)
    cell = np.concatenate([weights[(words & np.uint64(len(weights) - 1)).astype(np.int64)], np.zeros(width, weights.dtype)])
    total = np.zeros(len(hashes), np.int64)
    for k in range(width):
        total += np.where(k < left, cell[start + k], 0)
    order = np.argsort(hashes)
    return hashes[order], total[order]


def _all(data, offsets, width):
    """Every shingle in the order of the texts: hashes, word hashes, its first word, words left in its text, text, shingles a text."""
    words, at = _words(data, offsets)
    n_words = np.diff(at)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + at[text]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    left = at[1:][text] - start
    total = np.zeros(len(text), np.uint64)
    for k in range(width):
        part = padded[start + k] * _STEP[k % WIDTH] + np.uint64(k)
        total += np.where(k < left, part, np.uint64(0)) if width > 1 else part
    return mix(total), words, start, left, text, n


def _sets(data, offsets, width):
    hashes, _, _, _, text, n = _all(data, offsets, width)
    for a, b in zip(np.cumsum(n) - n, np.cumsum(n), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(n))
