"""Array kernels over whole texts inside a task: words, word hashes, shingle sets and fingerprints.

A text is its UTF-8 bytes. A word is a longest run of bytes other than space and 0x09-0x0D, as in the
pattern ``[^\\x20\\x09-\\x0D]+``. Texts of an Arrow batch are worked on in slices of half a MB, so memory
follows the slice and the longest single text, never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit permutation (the finaliser of the public SplitMix64 generator)."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix((np.arange(n, dtype=np.uint64) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, offs


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0): runs of rows of about ``limit`` bytes."""
    raw, offs = text_bytes(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of the first word (n + 1 numbers)."""
    table = np.ones(256, bool)
    table[list(SEPARATORS)] = False
    inside = table[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    begin[first], finish[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offs)


_BYTE = stream(1, 256)
_STEP = _U(0x9FB21C651E98DF25)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end] of runs in order that do not overlap or touch runs before them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    inner = np.arange(total) - np.repeat(before, lens)
    powers = np.empty(int(lens.max()), np.uint64)
    powers[0], powers[1:] = 1, _STEP
    powers = np.multiply.accumulate(powers)
    value = _BYTE[data[inner + np.repeat(starts, lens)]] * powers[inner]
    return mix(np.add.reduceat(value, before) + lens.astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def shingles(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words; a text with fewer words but one has its whole sequence as one.

    Returns the hashes in order and for each text the number of its first (n + 1 numbers)."""
    counts = np.diff(firsts)
    factor = stream(2, size)
    n = len(words)
    if n >= size:
        rolled = sum(words[j : n - size + 1 + j] * factor[j] for j in range(size))
        rolled = mix(rolled + _U(size))
    else:
        rolled = np.zeros(0, np.uint64)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(int(at[-1]), np.uint64)
    long = np.flatnonzero(counts >= size)
    if len(long):
        lens = made[long]
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(at[long], lens) + inner] = rolled[np.repeat(firsts[long], lens) + inner]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[firsts[d] : firsts[d + 1]]
        out[at[d]] = mix(np.array([(own * factor[: len(own)]).sum(dtype=np.uint64) + _U(len(own))]))[0]
    return out, at


def shingle_sets(column, size: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows; words are compared with A-Z lower-cased."""
    for lo, hi, data, offs in slices(column):
        starts, ends, firsts = word_bounds(data, offs)
        hashed, at = shingles(hash_runs(lower_ascii(data), starts, ends), firsts, size)
        yield lo, [np.unique(hashed[at[i] : at[i + 1]]) for i in range(hi - lo)]


def set_fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set of hashes, as signed numbers."""
    with np.errstate(over="ignore"):
        a = values.sum(dtype=np.uint64)
        b = mix(values ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(values) else _U(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
