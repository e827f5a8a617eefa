"""Language identification, word first with backoff to character n-grams.

Learned from text: for each language the frequency of words (runs of letters, lower-cased) and of the character n-grams of
words, marked at both ends, for n = 5 to 1. A known word adds its logarithm of frequency under each language. An
unknown word is scored by its known n-grams of the greatest n that has any, by their mean; a word without any says
nothing. The language with the greatest sum wins (ties by name), its score is its share after softmax.

The model is fit on at most ``FIT_DOCS`` documents, the first by hash of doc_id, and holds at most ``KNOWN`` words and as
many n-grams of each n, the most frequent ones (as 64-bit hashes), so it is safe to ship. Scoring covers whole texts. A
text that is null or has no letter gets ``und`` and 0; if its words say nothing, the most frequent language wins. With
nothing to learn from, all get ``und``. Null doc_id is not learned from. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import chars

FIT_DOCS, KNOWN, LONGEST = 5_000, 50_000, 5
SMOOTH = 0.1


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    keys: list[np.ndarray]  # by n, 0: words; sorted hashes
    logs: list[np.ndarray]  # a row per key, a column per language


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words laid end to end with marks at both ends (code points 1 and 2), and their offsets."""
    lens = ends - starts + 2
    offs = np.concatenate([[0], np.cumsum(lens)])
    out = np.empty(int(offs[-1]), np.uint32)
    inner = np.arange(len(out)) - np.repeat(offs[:-1], lens)
    at = np.repeat(starts, lens) + inner - 1
    out[:] = data[np.clip(at, 0, max(len(data) - 1, 0))]
    out[offs[:-1]], out[offs[1:] - 1] = 1, 2
    return out, offs


def grams(codes: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram inside a word, and the number of its word; single characters without the marks."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(codes) - n + 1]
    good = np.arange(len(word)) + n <= offs[word + 1]
    if n == 1:
        good &= codes > 2
    return (chars.rolled(codes, n) + np.uint64(n))[good], word[good]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights, len(unique)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """``lang, n, key, count`` of ``lang, text``: words as n = 0 and character n-grams, summed within slices."""

    def work(batches):
        for batch in batches:
            lang = np.array([x.as_py() for x in batch.column(0)], object)
            for lo, hi, data, offs in chars.code_points(batch.column(1)):
                starts, ends, text = chars.runs(chars.letters()[data], offs)
                hashed = chars.hash_words(data, starts, ends)
                for name in sorted(set(lang[lo:hi])):
                    own = np.flatnonzero(lang[lo + text] == name)
                    keys, first, back = np.unique(hashed[own], return_index=True, return_inverse=True)
                    often = np.bincount(back, minlength=len(keys))
                    found = [(0, keys, often)]
                    codes, at = word_codes(data, starts[own][first], ends[own][first])
                    for n in range(1, LONGEST + 1):
                        gram, word = grams(codes, at, n)
                        found.append((n, *_summed(gram, often[word])))
                    size = sum(len(k) for _, k, _ in found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * size, pa.string()),
                            pa.array(np.concatenate([np.full(len(k), n, np.int32) for n, k, _ in found])),
                            pa.array(np.concatenate([k for _, k, _ in found]).view(np.int64)),
                            pa.array(np.concatenate([c for _, _, c in found]).astype(np.int64)),
                        ],
                        ["lang", "n", "key", "count"],
                    )

    return docs.select("lang", "text").mapInArrow(work, "lang string, n int, key long, count long")


def fit(docs: DataFrame, rows: int = FIT_DOCS, known: int = KNOWN) -> Model:
    """Learn from ``doc_id, lang, text`` rows with a language that are not held out."""
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~chars.held_out())
    order = [F.xxhash64("doc_id"), "doc_id", "lang"]
    chosen = able.select("doc_id", "lang").orderBy(*order).limit(rows).distinct()
    sample = able.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most FIT_DOCS ids
    languages = [r[0] for r in chosen.select(F.col("lang").cast("string")).distinct().collect()]
    languages.sort()
    if not languages:
        return Model([], np.zeros(0), [], [])
    by_language = [F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(F.lit(0))).alias(f"c{i}") for i, x in enumerate(languages)]
    columns = [f"c{i}" for i in range(len(languages))]
    raw = counts(sample.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    total = raw.groupBy("n", "key").agg(F.sum("count").alias("all"), *by_language).persist()
    sums = {r["n"]: np.array([r[c] for c in columns], float) for r in total.groupBy("n").agg(*(F.sum(c).alias(c) for c in columns)).collect()}
    none = np.zeros(len(languages))
    keys, logs = [], []
    for n in range(LONGEST + 1):
        table = total.where(F.col("n") == n).orderBy(F.desc("all"), "key").limit(known).select("key", *columns).toArrow()
        key = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
        count = np.stack([table.column(c).to_numpy() for c in columns], axis=1).astype(float)
        own = sums.get(n, none)
        order = np.argsort(key)
        keys.append(key[order])
        logs.append(np.log((count[order] + SMOOTH) / (own + SMOOTH * max(len(key), 1))))
    total.unpersist()
    prior = sums.get(0, none)
    return Model(languages, np.log((prior + 1) / (prior.sum() + max(len(prior), 1))), keys, logs)


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place in ``keys`` of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def word_scores(model: Model, hashed: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of log frequencies for each different word; zeros if nothing in it is known."""
    out = np.zeros((len(hashed), len(model.languages)))
    at = _found(model.keys[0], hashed)
    out[at >= 0] = model.logs[0][at[at >= 0]]
    open_ = np.flatnonzero(at < 0)
    for n in range(LONGEST, 0, -1):
        if not len(open_):
            break
        gram, word = grams(*word_codes(data, starts[open_], ends[open_]), n)
        at = _found(model.keys[n], gram)
        word, at = word[at >= 0], at[at >= 0]
        seen = np.bincount(word, minlength=len(open_))
        for j in range(out.shape[1]):
            total = np.bincount(word, model.logs[n][at, j], len(open_))
            out[open_[seen > 0], j] = total[seen > 0] / seen[seen > 0]
        open_ = open_[seen == 0]
    return out


def predict_batch(model: Model, column) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for lo, hi, data, offs in chars.code_points(column):
        starts, ends, text = chars.runs(chars.letters()[data], offs)
        n = hi - lo
        worded = np.bincount(text, minlength=n) > 0
        if not model.languages:
            names += ["und"] * n
            scores.append(np.zeros(n))
            continue
        keys, first, back = np.unique(chars.hash_words(data, starts, ends), return_index=True, return_inverse=True)
        by_word = word_scores(model, keys, data, starts[first], ends[first])
        sums = np.stack([np.bincount(text, by_word[back, j], n) for j in range(by_word.shape[1])], axis=1) + model.prior
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        names += [model.languages[b] if w else "und" for b, w in zip(best, worded)]
        scores.append(np.where(worded, share, 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: from the text alone."""
    def work(batches):
        for batch in batches:
            names, scores = predict_batch(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", chars.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(work, kind)
