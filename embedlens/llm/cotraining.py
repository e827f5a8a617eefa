"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees statistics of the text (shares of symbols, capitals, repeated and different words and the like),
the metadata view sees ``source``, ``lang`` and ``n_chars`` only; each is a logistic regression. Both start from labelled
rows (1 good, 0 bad). In each of ``ROUNDS`` rounds either view labels the unlabelled rows of which it is surest (probability
``SURE`` or more for a class, at most ``GROW`` per class) for the other view, and both are trained anew. Every fifth labelled
row is held back: on these the views' scores are calibrated (Platt) and then combined by a second logistic regression.
The combined model scores all documents as one column expression over the statistics.

Fit on at most ``FIT_ROWS`` labelled and ``POOL`` unlabelled rows, the first by hash of doc_id. Null text has zero
statistics; null source, lang and n_chars are values of their own. Without labels of both kinds the score is the
smoothed share of good labels. Repeated rows are scored each. Extra columns are ignored by the model and kept by
``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.llm.decision_list import MEASURES, measure
from embedlens.llm.text_stats import with_stats

FIT_ROWS, POOL = 20_000, 20_000
ROUNDS, SURE, GROW = 3, 0.98, 500
SOURCES, LANGS, SIZES = 64, 16, 24
LIMIT, PENALTY, STEPS = 4.0, 1e-3, 25
KEEP_FROM = 0.5

NAMES = list(MEASURES)


def metadata_slots() -> list[Column]:
    """Number of the slot of each metadata field."""
    slot = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    chars = F.col("n_chars").cast("double")
    size = F.when(chars > 0, F.least(F.floor(F.log2(chars)) + 1, F.lit(SIZES - 1))).otherwise(F.when(chars.isNull(), F.lit(SIZES - 1)).otherwise(F.lit(0)))
    return [slot("source", SOURCES), slot("lang", LANGS), size.cast("int")]


SLOTS = (SOURCES, LANGS, SIZES)


@dataclass
class Model:
    """Linear views and their combination; ``centre`` and ``spread`` standardise the measures."""

    centre: np.ndarray
    spread: np.ndarray
    text: np.ndarray  # a weight per measure, then the bias
    meta: np.ndarray  # a weight per slot of each field, then the bias
    calibration: np.ndarray  # slope and offset of each view
    combine: np.ndarray  # weight of each calibrated view, offset


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Newton steps on the mean logistic loss with L2 penalty; last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), sum(SLOTS) + 1))
    out[:, -1] = 1
    at = 0
    for j, n in enumerate(SLOTS):
        out[np.arange(len(slots)), at + slots[:, j]] = 1
        at += n
    return out


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def co_train(measures: np.ndarray, slots: np.ndarray, label: np.ndarray) -> Model:
    """Fit on rows with ``label`` 1, 0 or -1 (unlabelled)."""
    centre, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-9
    text = np.hstack([np.clip((measures - centre) / spread, -LIMIT, LIMIT), np.ones((len(measures), 1))])
    views = [text, _one_hot(slots)]
    known = np.flatnonzero(label >= 0)
    back, used = known[4::5], np.setdiff1d(known, known[4::5])
    given = [label.copy(), label.copy()]
    for g in given:
        g[back] = -1
    weights = [logistic(v[used], label[used]) for v in views]
    open_ = label < 0
    for _ in range(ROUNDS):
        for one, other in ((0, 1), (1, 0)):
            p = _probability(views[one], weights[one])
            for value, sure in ((1, p), (0, 1 - p)):
                able = np.flatnonzero(open_ & (given[other] < 0) & (sure >= SURE))
                given[other][able[np.argsort(-sure[able], kind="stable")][:GROW]] = value
        weights = [logistic(v[g >= 0], g[g >= 0]) for v, g in zip(views, given)]
    raw = [np.clip(v @ w, -30, 30) for v, w in zip(views, weights)]
    calibration = np.zeros((2, 2))
    for i, r in enumerate(raw):
        calibration[i] = logistic(np.column_stack([r[back], np.ones(len(back))]), label[back])
    both = np.column_stack([raw[i] * calibration[i, 0] + calibration[i, 1] for i in (0, 1)] + [np.ones(len(label))])
    return Model(centre, spread, weights[0], weights[1], calibration, logistic(both[back], label[back]))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or the score of every document if labels of only one kind are there."""
    able = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = able.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(FIT_ROWS)
    pool = docs.where("doc_id IS NOT NULL").select("doc_id").join(able.select("doc_id"), "doc_id", "left_anti")
    pool = pool.orderBy(F.xxhash64("doc_id"), "doc_id").limit(POOL).withColumn("quality", F.lit(-1))
    chosen = F.broadcast(known.unionByName(pool))  # at most FIT_ROWS + POOL ids
    fields = docs.select("doc_id", "text", "source", "lang", "n_chars").join(chosen, "doc_id")
    slots = [s.alias(f"s{i}") for i, s in enumerate(metadata_slots())]
    rows = with_stats(fields.select("doc_id", "quality", "text", *slots), "doc_id", "quality", "s0", "s1", "s2")
    table = rows.select("doc_id", "quality", "s0", "s1", "s2", *(measure(n).alias(f"m_{n}") for n in NAMES)).toArrow()
    table = table.sort_by([(c, "ascending") for c in table.column_names])
    label = table.column("quality").to_numpy()
    good, bad = int((label == 1).sum()), int((label == 0).sum())
    if min(good, bad) < 10:
        return (good + 1) / (good + bad + 2) if good + bad else 1.0
    order = np.random.default_rng(0).permutation(table.num_rows)
    column = lambda c: table.column(c).to_numpy()[order]
    measures = np.column_stack([column(f"m_{n}") for n in NAMES])
    return co_train(measures, np.column_stack([column(c) for c in ("s0", "s1", "s2")]), column("quality").astype(int))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scores(model: Model | float, slots: list[Column]) -> list[Column]:
    """Calibrated probability of good: text view, metadata view, both; over the statistics' columns."""
    if isinstance(model, float):
        return [F.lit(model)] * 3
    text = F.lit(float(model.text[-1]))
    for i, name in enumerate(NAMES):
        z = (measure(name) - float(model.centre[i])) / float(model.spread[i])
        text = text + F.greatest(F.least(z, F.lit(LIMIT)), F.lit(-LIMIT)) * float(model.text[i])
    meta, at = F.lit(float(model.meta[-1])), 0
    for slot, n in zip(slots, SLOTS):
        meta = meta + F.element_at(F.array(*(F.lit(float(w)) for w in model.meta[at : at + n])), slot + 1)
        at += n
    clip = lambda z: F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    logit = [clip(z) * float(a) + float(b) for z, (a, b) in zip((text, meta), model.calibration)]
    return [*map(_sigmoid, logit), _sigmoid(logit[0] * float(model.combine[0]) + logit[1] * float(model.combine[1]) + float(model.combine[2]))]


def score_documents(docs: DataFrame, model: Model | float, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``text_score, metadata_score, score, kept``: a row per row of ``docs``."""
    slots = [s.alias(f"s{i}_") for i, s in enumerate(metadata_slots())]
    stats = with_stats(docs.select("text", *slots, F.struct(*(F.col(c) for c in keep)).alias("row_")), "row_", "s0_", "s1_", "s2_")
    text, meta, both = scores(model, [F.col(f"s{i}_") for i in range(3)])
    out = stats.select("row_", text.alias("a_"), meta.alias("b_"), both.alias("c_"))
    return out.select("row_.*", F.col("a_").alias("text_score"), F.col("b_").alias("metadata_score"), F.col("c_").alias("score"), (F.col("c_") >= KEEP_FROM).alias("kept"))


def filter_documents(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns as they were."""
    scored = score_documents(docs.withColumn("whole_", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), model, "whole_")
    return scored.where("kept").select("whole_.*")
