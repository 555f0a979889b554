"""Vectorised byte-level tokens of Arrow string columns: no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_BYTE = np.arange(256)
_WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
#: Word bytes (digits, ASCII letters in lower case, all of UTF-8 beyond ASCII); 0 elsewhere.
WORD = np.where(_WORD, np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE), 0).astype(np.uint8)
SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def run_hashes(values: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of runs: keep marks the bytes in runs, starts the first byte of each."""
    at = np.flatnonzero(keep)
    first = np.flatnonzero(starts[at])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.diff(first, append=len(at))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        within = np.arange(len(at)) - np.repeat(first, lengths)
        h = mix(np.add.reduceat((values[at].astype(np.uint64) + np.uint64(1)) * powers[within], first))
    return h, at[first]


def prefix_hashes(values: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first k bytes of the words that begin at `at` and are longer, and which words those are."""
    padded = np.concatenate([values, np.zeros(k + 1, values.dtype)])
    which = np.flatnonzero(_longer(padded, at, k))
    h = np.full(len(which), k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ padded[at[which] + j].astype(np.uint64)) * _BASE
            h ^= h >> np.uint64(29)
    return mix(h), which


def _longer(padded: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    ok = np.ones(len(at), bool)
    for j in range(1, k + 1):
        ok &= padded[at + j] != 0
    return ok


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte position of every word, and each document's first word (with an end)."""
    low = WORD[data]
    keep = low != 0
    starts = keep.copy()
    starts[1:] &= ~keep[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    starts[inner] = keep[inner]
    h, at = run_hashes(low, keep, starts)
    return h, at, np.searchsorted(at, offsets)


def word_sizes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of every word of words()."""
    keep = WORD[data] != 0
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = keep[ends]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = keep[begins]
    return np.flatnonzero(last) + 1 - np.flatnonzero(first)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and each document's first one; a shorter, not empty, document is one run."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    where = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    size = np.minimum(k, np.repeat(counts, n))
    out = np.zeros(len(where), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = size > j
            out[inside] = mix(out[inside] * _BASE + h[where[inside] + j])
    return out, begin


def lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))
