"""Statistics of whole texts, computed inside tasks on the bytes of a batch.

``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word
that equal an earlier line of the text) and ``n_repeat_words`` (words in some run of five words that occurs twice or
more in the text, the first time included), and more counts for models: characters, upper-case and digit bytes,
punctuation, lines, different words, words that repeat the word before. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import kernels

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars_", "n_upper", "n_digits", "n_punct", "n_lines", "n_distinct", "n_echo", "n_marked", "n_bars"]
ALL = BASE + MORE

_IS = {
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "start": (np.arange(256) & 0xC0) != 0x80,
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "punct": np.isin(np.arange(256), list(b"!\"'(),-./:;?@[\\]^_`{}~")),
    "bar": np.arange(256) == ord("|"),
}


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _doubles(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (text number, hash): has an equal in the same text; has an earlier equal in the same text."""
    own = kernels.mix(key ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    equal = own[order][1:] == own[order][:-1]
    any_, later = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:][equal]] = True
    any_[order[1:][equal]] = True
    any_[order[:-1][equal]] = True
    return any_, later


def slice_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row per text, columns ``ALL``."""
    n = len(offs) - 1
    out = {}
    starts, ends, firsts = kernels.word_bounds(data, offs)
    words = kernels.hash_runs(data, starts, ends)
    counts = np.diff(firsts)
    word_text = np.repeat(np.arange(n), counts)
    out["n_words"] = counts
    begins = np.concatenate([[0], np.cumsum(_IS["start"][data], dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(begins[ends] - begins[starts])])
    out["word_chars"] = chars[firsts[1:]] - chars[firsts[:-1]]
    for name, kind in (("n_symbols", "symbol"), ("n_chars_", "start"), ("n_upper", "upper"), ("n_digits", "digit"), ("n_punct", "punct"), ("n_bars", "bar")):
        out[name] = _per_text(_IS[kind][data], offs)

    # lines: cut at \n; only those with a word count
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    line_text = np.searchsorted(offs, line_starts, "right") - 1
    inside = (line_text < n) & (line_starts < len(data))
    line_starts, line_text = line_starts[inside], line_text[inside]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offs[line_text + 1])
    out["n_lines"] = np.bincount(line_text, minlength=n)
    trim = line_ends - (line_ends > line_starts) * (data[np.maximum(line_ends - 1, 0)] == 10)
    worded = np.searchsorted(starts, trim) > np.searchsorted(starts, line_starts)
    line_text, hashes = line_text[worded], kernels.hash_runs(data, line_starts[worded], trim[worded])
    _, later = _doubles(line_text, hashes)
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=n)

    # runs of five words found twice or more
    window_at = np.flatnonzero(word_text[: max(0, len(words) - WINDOW + 1)] == word_text[WINDOW - 1 :]) if len(words) >= WINDOW else np.zeros(0, np.int64)
    rolled, _ = kernels.shingles(words, np.array([0, len(words)]), WINDOW) if len(words) >= WINDOW else (np.zeros(0, np.uint64), None)
    twice, _ = _doubles(word_text[window_at], rolled[window_at])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, window_at[twice], 1)
    np.add.at(cover, window_at[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(word_text[covered], minlength=n)

    _, seen = _doubles(word_text, words)
    out["n_distinct"] = np.bincount(word_text[~seen], minlength=n)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (word_text[1:] == word_text[:-1])
    out["n_echo"] = np.bincount(word_text[echo], minlength=n)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = _IS["symbol"][last] | (last == ord("!"))
    out["n_marked"] = np.bincount(word_text[marked], minlength=n)
    return np.stack([np.asarray(out[c], np.int64) for c in ALL], axis=1)


def batch_stats(column) -> np.ndarray:
    parts = [slice_stats(data, offs) for _, _, data, offs in kernels.slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(ALL)), np.int64)


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the statistics of ``text``, a long column each."""

    def work(batches):
        for batch in batches:
            stats = batch_stats(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(stats[:, i]) for i in range(len(ALL)))], [*batch.schema.names[1:], *ALL])

    rows = docs.select(F.col("text").cast("string").alias("text_"), *keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + [f"{c} long" for c in ALL]
    return rows.mapInArrow(work, ", ".join(kinds))
