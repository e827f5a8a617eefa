"""Code points of whole texts inside a task: lower-cased texts end to end, letter runs and rolling n-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from embedlens.llm import kernels

SLICE_CHARS = 300_000


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


_TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point: is it a letter? Made once per worker."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def code_points(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points of lower-cased texts, offsets); nulls are empty."""
    texts: list[str] = []
    first = total = 0
    for i, value in enumerate(column):
        text = (value.as_py() or "").lower()
        texts.append(text)
        total += len(text)
        if total >= SLICE_CHARS or i + 1 == len(column):
            lens = [len(t) for t in texts]
            data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield first, i + 1, data, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            first, total, texts = i + 1, 0, []


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each longest run of True within a text, and the number of its text."""
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    begin[first], finish[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    before = np.cumsum(lens) - lens
    inner = np.arange(int(lens.sum())) - np.repeat(before, lens)
    powers = np.full(int(lens.max()), kernels._STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    code = data[inner + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)
    return kernels.mix(np.add.reduceat(code * np.uint64(0x9E3779B97F4A7C15) * powers[inner], before) + lens.astype(np.uint64))


_FACTOR = kernels.stream(21, 16) | np.uint64(1)


def rolled(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n code points from each place on; the top bits are the good ones."""
    code = data.astype(np.uint64) + np.uint64(1)
    out = code[: len(code) - n + 1] * _FACTOR[0]
    for j in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR[15] + code[j : len(code) - n + 1 + j] * _FACTOR[j]
    return (out ^ (out >> np.uint64(32))) * _FACTOR[14]
