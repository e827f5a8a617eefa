"""Learned decision lists: quality rules by sequential covering.

Rules are conjunctions of thresholds on text statistics (ratios and counts). From labelled rows (1 good, 0 bad) a rule is
grown on two thirds of the rows, always by the condition with the greatest information gain (FOIL), then pruned from its end
on the last third as long as (bad - good) / (bad + good) rises. The rows it covers are taken out and the next rule is
grown, until a rule is right in less than ``PRECISION`` of its pruning rows or covers fewer than ``LEAST`` bad rows. The
list in order becomes one Spark ``CASE WHEN`` expression over the statistics.

The list is fit on at most ``FIT_ROWS`` labelled rows, the first by hash of doc_id; statistics and verdicts cover all
rows. Null text has zero statistics. Without labels of both kinds the list is empty and every document passes. Rows
are judged each by its own text; extra columns are ignored, repeated label rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.llm.text_stats import BASE, with_stats

FIT_ROWS = 20_000
PRECISION, LEAST, MOST_CONDITIONS, MOST_RULES = 0.9, 8, 4, 24

#: name -> (numerator, denominator or None); a ratio with a zero denominator is zero
MEASURES = {
    "n_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "n_chars_"),
    "digits_per_char": ("n_digits", "n_chars_"),
    "punct_per_word": ("n_punct", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "echo_share": ("n_echo", "n_words"),
    "marked_share": ("n_marked", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
}


def measure(name: str) -> Column:
    top, bottom = MEASURES[name]
    value = F.col(top).cast("double")
    return value if bottom is None else F.when(F.col(bottom) > 0, value / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = measure(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, rows: np.ndarray, names: list[str]) -> np.ndarray:
        value = rows[:, names.index(self.name)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for c in rule:
        out &= c.holds(rows, names)
    return out


def _best_condition(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    p, q = int(bad.sum()), int((~bad).sum())
    before = np.log2(p / (p + q)) if p else 0.0
    best, found = 0.0, None
    for i, name in enumerate(names):
        order = np.argsort(rows[:, i], kind="stable")
        value, hit = rows[order, i], bad[order]
        cuts = np.flatnonzero(value[1:] > value[:-1])
        if not len(cuts):
            continue
        low_bad, low_all = np.cumsum(hit)[cuts], cuts + 1
        for above, b, a in ((False, low_bad, low_all), (True, p - low_bad, len(rows) - low_all)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(b > 0, b * (np.log2(b / a) - before), 0.0)
            j = int(gain.argmax())
            if gain[j] > best + 1e-9:
                best, found = float(gain[j]), Condition(name, above, float((value[cuts[j]] + value[cuts[j] + 1]) / 2))
    return best, found


def grow(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS and bad.any() and not bad.all():
        _, condition = _best_condition(rows, bad, names)
        if condition is None:
            break
        rule += (condition,)
        hit = condition.holds(rows, names)
        rows, bad = rows[hit], bad[hit]
    return rule


def prune(rule: Rule, rows: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    def worth(r: Rule) -> float:
        hit = covers(r, rows, names)
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - q) / (p + q) if p + q else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """The ordered rules for bad rows; every third row is kept for pruning."""
    rules: list[Rule] = []
    third = np.arange(len(rows)) % 3 == 2
    while len(rules) < MOST_RULES and (bad & ~third).sum() >= LEAST and not bad.all():
        rule = prune(grow(rows[~third], bad[~third], names), rows[third], bad[third], names)
        hit = covers(rule, rows, names)
        right, of = int((hit & third & bad).sum()), int((hit & third).sum())
        if not rule or (hit & bad).sum() < LEAST or right < PRECISION * max(of, 1):
            break
        rules.append(rule)
        rows, bad, third = rows[~hit], bad[~hit], third[~hit]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    tests = [reduce(lambda a, b: a & b, (c.column() for c in rule)) for rule in rules]
    out = F.when(tests[0], F.lit(1))
    for i, test in enumerate(tests[1:], 2):
        out = out.when(test, F.lit(i))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents, in order of a hash of doc_id."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").withColumn("h", F.xxhash64("doc_id"))
    known = known.orderBy("h", "doc_id", "quality").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "quality")), "doc_id")  # at most FIT_ROWS ids
    names = list(MEASURES)
    stats = with_stats(chosen, "doc_id", "quality").select("doc_id", "quality", *(measure(n).alias(f"m_{n}") for n in names))
    table = stats.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")] + [(f"m_{n}", "ascending") for n in names])
    if not table.num_rows:
        return []
    rng = np.random.default_rng(0).permutation(table.num_rows)
    x = np.stack([table.column(f"m_{n}").to_numpy() for n in names], axis=1)[rng]
    return learn(x, table.column("quality").to_numpy()[rng] == 0, names)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed, rule, kept``: a row per row of ``docs``."""
    stats = with_stats(docs, "doc_id").withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return stats.select("doc_id", *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
