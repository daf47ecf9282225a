"""Vectorised byte kernels on Arrow string columns: words, word hashes, shingle sets, one-permutation signatures.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, with A-Z lower-cased. Hashes are 64-bit: a polynomial of random byte
values, mixed; they depend on nothing but the bytes, so every executor computes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time (a longer text is one block by itself).
BLOCK = 1 << 18

_SEEDED = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _SEEDED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_Q = [np.uint64(int(x) | 1) for x in _SEEDED.integers(1, 1 << 63, 64, dtype=np.uint64)]
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        made = []
        for p in (_P, _PI):
            x = np.full(size, p, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, off


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data`` (which ``off``, from 0, cuts into rows), and the first word of each row."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(off), dtype=np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at each word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _Q[0]
    for j in range(1, k):
        out += words[j : n + j] * _Q[j]
    return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """One hash of a sequence of any length."""
    x = words * mix(np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(_P) | np.uint64(1))
    return mix(np.array([int(x.sum(dtype=np.uint64)) ^ (len(words) << 32)], dtype=np.uint64))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct ``k``-word shingles; of fewer words, the whole sequence as one; without words, none."""
    data, off = utf8(column)
    for i, j in blocks(off):
        own = off[i : j + 1] - off[i]
        part = data[off[i] : off[j]]
        starts, ends, first = word_spans(part, own)
        words = word_hashes(part, starts, ends)
        runs = shingles(words, k)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield whole(words[a:b])
            else:
                yield np.zeros(0, dtype=np.uint64)


class OnePermutation:
    """One-permutation signatures of ``bins`` equal ranges of hash values; an empty range copies a range drawn by a fixed
    random sequence of its own (optimal densification), so that equal sets agree everywhere and each position agrees with
    the sets' Jaccard similarity as probability."""

    def __init__(self, bins: int, tries: int = 2048):
        self.bins = bins
        rng = np.random.Generator(np.random.PCG64(bins))
        self.edges = np.array([(i << 64) // bins for i in range(bins)], dtype=np.uint64)
        self.tries = rng.integers(0, bins, (bins, tries))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """``values``: sorted, distinct, not empty."""
        at = np.searchsorted(values, self.edges)
        full = np.diff(np.append(at, len(values))) > 0
        sig = values[np.minimum(at, len(values) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            pick = np.full(len(empty), -1)
            for low, high in ((0, 8), (8, 128), (128, self.tries.shape[1])):  # most are met by the first draws
                lost = np.flatnonzero(pick < 0)
                if not len(lost):
                    break
                drawn = self.tries[empty[lost], low:high]
                hit = full[drawn]
                at = hit.argmax(axis=1)
                met = hit[np.arange(len(lost)), at]
                pick[lost[met]] = drawn[np.flatnonzero(met), at[met]]
            lost = pick < 0
            if lost.any():  # no draw met a full range: the next full one, round about
                there = np.flatnonzero(full)
                pick[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
            sig = sig.copy()
            sig[empty] = sig[pick]
        return sig

    def many(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The signatures of several sets at once, a row each; ``values`` holds the sets one after another, repeats allowed."""
        m = len(sizes)
        owner = np.repeat(np.arange(m), sizes)
        cell = owner * self.bins + np.searchsorted(self.edges, values, side="right") - 1
        sig = np.full(m * self.bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(sig, cell, values)
        full = np.zeros(m * self.bins, dtype=bool)
        full[cell] = True
        sig, full = sig.reshape(m, self.bins), full.reshape(m, self.bins)
        row, col = np.nonzero(~full)
        for j in range(16):  # most are met by the first draws
            if not len(row):
                return sig
            drawn = self.tries[col, j]
            hit = full[row, drawn]
            sig[row[hit], col[hit]] = sig[row[hit], drawn[hit]]
            row, col = row[~hit], col[~hit]
        at = np.cumsum(sizes) - sizes
        for r in np.unique(row).tolist():
            sig[r] = self(np.unique(values[at[r] : at[r] + sizes[r]]))
        return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` positions, its number included. ``sig``: one signature or a matrix of them."""
    bands = sig.shape[-1] // rows
    x = sig[..., : bands * rows].reshape(*sig.shape[:-1], bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), x.shape[:-1]).copy()
    for j in range(rows):
        out = mix(out * _Q[j] + x[..., j])
    return out


def tuned_bands(similarity: float, recall: float, bins: int) -> tuple[int, int]:
    """Most rows to a band, and then fewest bands, with which a pair of that similarity meets with that probability."""
    for rows in range(bins, 0, -1):
        for bands in range(1, bins // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding of so few bins has this recall")


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
