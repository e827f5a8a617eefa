"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (n = 3 to 5, lower-cased, hashed to ``BINS`` bins) in a text. From labelled
texts each bin gets the ratio r = log of its share among toxic documents over its share among clean ones, both smoothed. Of the
bins with r > 0 in ``LEAST`` documents or more, the ``SELECTED`` with the greatest likelihood ratio of their counts are kept, if it is ``EVIDENCE``
or more (n-grams of clean texts say nothing that an absent bin doesn't); on features scaled by r a
logistic regression with L2 penalty is trained: in each of ``ROUNDS`` rounds tasks improve the weights on their own rows
and the weights are averaged (by number of rows). The score is the regression's probability.

The model is fit on at most ``FIT_ROWS`` labelled rows that are not held out, the first by hash of doc_id; scores cover whole texts, in
slices, so their memory doesn't depend on a document's neighbours. Null and empty texts get the score of no features.
Without labels of both kinds the score is the smoothed share of toxic labels. Several labels of one document count
each. Null doc_id: scored, not learned from. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import chars
from embedlens.session import cut

FIT_ROWS, BINS_LOG2, SIZES = 12_000, 18, (3, 4, 5)
SELECTED, LEAST, EVIDENCE = 512, 4, 8.0
ROUNDS, STEPS, SHARDS, PENALTY = 4, 40, 6, 3e-4
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray  # by bin, most are 0
    bias: float


def slice_features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of the different n-grams of each text, in order; only bins where ``wanted`` is not zero."""
    bins = 1 << BINS_LOG2
    found = []
    for n in SIZES:
        if len(data) < n:
            continue
        bin_ = (chars.rolled(data, n) >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
        at = np.arange(len(bin_)) if wanted is None else np.flatnonzero(wanted[bin_])
        text = np.searchsorted(offs, at, "right") - 1
        good = at + n <= offs[text + 1]
        found.append(text[good] * bins + bin_[at[good]])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // bins, both % bins


def bin_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by label (row) and bin, and by label; from ``toxic, text``. Tasks send sums of a fixed size."""

    def work(batches):
        total, docs = np.zeros((2, 1 << BINS_LOG2), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            docs += np.bincount(label, minlength=2)
            for lo, _, data, offs in chars.code_points(batch.column(1)):
                text, bin_ = slice_features(data, offs)
                total += np.bincount(label[lo + text] * (1 << BINS_LOG2) + bin_, minlength=2 << BINS_LOG2).reshape(2, -1)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(-1, some).astype(np.int32)), *(pa.array(np.append(docs[k], total[k, some])) for k in (0, 1))], ["bin", "clean", "toxic"]
        )

    table = rows.mapInArrow(work, "bin int, clean long, toxic long").groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out, docs = np.zeros((2, 1 << BINS_LOG2)), np.zeros(2)
    bin_ = table.column("bin").to_numpy()
    for k, name in enumerate(("clean", "toxic")):
        values = table.column(name).to_numpy()
        docs[k] = values[bin_ < 0].sum()
        out[k, bin_[bin_ >= 0]] = values[bin_ >= 0]
    return out, docs


def log_count_ratios(counts: np.ndarray, docs: np.ndarray, selected: int = SELECTED) -> np.ndarray:
    """r by bin, 0 where not selected: bins that speak for toxic, by the likelihood ratio of their counts."""
    both, n = counts.sum(axis=0), docs.sum()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)

    ratio = 2 * sum(part(counts[k], both * docs[k] / n) + part(docs[k] - counts[k], (n - both) * docs[k] / n) for k in (0, 1))
    share = (counts + 1) / (docs[:, None] + 2)
    r = np.log(share[1] / share[0])
    strength = np.where((both >= LEAST) & (r > 0), ratio, 0)
    keep = np.argsort(-strength, kind="stable")[:selected]
    keep = keep[strength[keep] >= EVIDENCE]
    out = np.zeros(counts.shape[1])
    out[keep] = r[keep]
    return out


def improve(weights: np.ndarray, label: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, steps: int) -> np.ndarray:
    """Adam on the penalised mean logistic loss of sparse rows; the last weight is the bias."""
    w, m, v = weights.copy(), np.zeros_like(weights), np.zeros_like(weights)
    n = max(len(label), 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[column], len(label)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        g = np.bincount(column, value * error[row], len(w)) / n + PENALTY * w
        g[-1] = error.mean() if len(label) else 0.0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(rows: DataFrame, ratios: np.ndarray) -> Model:
    """Rounds of local improvement and averaging over ``shard, toxic, features`` rows (bins as bytes)."""
    chosen = np.flatnonzero(ratios)
    place = np.full(len(ratios), -1)
    place[chosen] = np.arange(len(chosen))
    scale = ratios[chosen]
    weights = np.zeros(len(chosen) + 1)

    def from_(now: np.ndarray):
        def work(table: pa.Table) -> pa.Table:
            label = table.column("toxic").to_numpy().astype(float)
            parts = [np.frombuffer(b.as_py(), np.int32) for b in table.column("features")]
            column = place[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            w = improve(now, label, row, column, scale[column], STEPS)
            return pa.table({"n": [len(label)], "w": pa.array([w.tobytes()], pa.binary())})

        return work

    for _ in range(ROUNDS):
        got = rows.groupBy("shard").applyInArrow(from_(weights), "n long, w binary").collect()
        total = sum(r["n"] for r in got)
        weights = sum(np.frombuffer(r["w"]) * r["n"] for r in got) / max(total, 1) if total else weights
    out = np.zeros(len(ratios), np.float32)
    out[chosen] = weights[:-1] * scale
    return Model(out, float(weights[-1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn ``labels.toxic`` from the texts of at most ``rows`` labelled documents that are not held out."""
    able = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~chars.held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(able.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))  # at most FIT_ROWS ids
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    counts, n = bin_counts(sample.select("toxic", "text"))
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2) if n.sum() else 0.1
        return Model(np.zeros(1 << BINS_LOG2, np.float32), float(np.log(share / (1 - share))))
    ratios = log_count_ratios(counts, n)
    wanted = ratios != 0

    def features(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offs in chars.code_points(batch.column(2)):
                text, bin_ = slice_features(data, offs, wanted)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                out += [bin_[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["shard", "toxic", "features"])

    dealt = sample.select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARDS)).cast("int").alias("shard"), "toxic", "text")
    return train(cut(dealt.mapInArrow(features, "shard int, toxic int, features binary")), ratios)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted``: a row per row of ``docs``, from the text alone."""

    def work(batches):
        wanted = model.weights != 0
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, offs in chars.code_points(batch.column(2)):
                text, bin_ = slice_features(data, offs, wanted)
                z = np.bincount(text, model.weights[bin_], hi - lo) + model.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select("doc_id", chars.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(work, kind)
