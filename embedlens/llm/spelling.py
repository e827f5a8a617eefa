"""Spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer.

Method. V is the acceptor of the vocabulary, E a transducer that changes, adds or drops exactly one symbol. Words one edit
apart are the pairs that V o E o V accepts. A state of the composition is (state of V, edit done?, state of V). Before the
edit both sides have read the same symbols; the edit stands where they first differ; after it both must read the same
rest. So every pair has one accepting path.

Partitions. An initial part of the run fixes the state reached by the first symbols, and runs that begin in different states
share nothing, so each state is a task's work of its own. A pair of which the shorter word has m symbols agrees either in its first or in
its last h = (m - 1) // 2 symbols. Words go to the states that h symbols lead to, forwards and (mirrored acceptor)
backwards, for m = their length and their length less one. The rests of the words of one state make a minimised acyclic
acceptor, built from the sorted words; pairs come from the composition of that acceptor with itself, or of the
acceptors of two blocks where a state has more than ``block`` words. A pair found forwards is not listed backwards.

Word counts are summed by Spark before and after the shuffle; neither the vocabulary nor the pairs of a state are ever in one place whole.

Null or empty text: no words. Null doc_id: hashed as the empty string. Repeated rows count again. Columns other than doc_id and text
are ignored. A word of any length is handled (nothing here recurses).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm.blocks import blocked, per_group
from embedlens.session import cut

SHORTEST, FEWEST, FACTOR = 7, 2, 10
BLOCK = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- acceptors


class Acceptor:
    """Minimised acyclic acceptor of sorted, distinct words: ``arcs[state]`` maps symbol to state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states of the last word; those beyond the common prefix are finished
        last = ""

        def finish(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                shape = (self.final[state], tuple(sorted(self.arcs[state].items())))
                same = known.setdefault(shape, state)
                if same != state:
                    self.arcs[path[-1]][last[len(path) - 1]] = same

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            finish(shared)
            for symbol in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][symbol] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        finish(0)


class Composition:
    """left o E o right: pairs of words exactly one edit apart, each once. With ``right`` the same acceptor, unordered pairs."""

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right, self.same = left, right, left is right
        self.alive: dict[tuple[int, int], bool] = {}

    def lives(self, p: int, q: int) -> bool:
        """Do the states have a rest in common?"""
        alive, arcs, other = self.alive, self.left.arcs, self.right.arcs
        if (p, q) in alive:
            return alive[p, q]
        todo = [(p, q, iter(arcs[p].items()))]
        while todo:
            a, b, steps = todo[-1]
            found = alive.get((a, b)) or (self.left.final[a] and self.right.final[b])
            deeper = False
            if not found:
                for symbol, to in steps:
                    end = other[b].get(symbol)
                    if end is None:
                        continue
                    known = alive.get((to, end))
                    if known is None:
                        todo.append((to, end, iter(arcs[to].items())))
                        deeper = True
                        break
                    if known:
                        found = True
                        break
            if deeper:
                continue
            alive[a, b] = found
            todo.pop()
            if found and todo:  # what leads here has a rest too
                alive[todo[-1][0], todo[-1][1]] = True
        return alive[p, q]

    def rests(self, p: int, q: int, unlike: str | None = None) -> Iterator[str]:
        """Words that both states accept; the first symbol is not ``unlike``."""
        path: list[str] = []
        todo = [(p, q, 0, "")]
        while todo:
            a, b, depth, symbol = todo.pop()
            del path[max(depth - 1, 0) :]
            if depth:
                path.append(symbol)
            if self.left.final[a] and self.right.final[b]:
                yield "".join(path)
            for step, to in self.left.arcs[a].items():
                end = self.right.arcs[b].get(step)
                if end is not None and not (depth == 0 and step == unlike) and self.lives(to, end):
                    todo.append((to, end, depth + 1, step))

    def pairs(self) -> Iterator[tuple[str, str]]:
        path: list[str] = []
        todo = [(0, 0, 0, "")]
        while todo:
            p, q, depth, symbol = todo.pop()
            del path[max(depth - 1, 0) :]
            if depth:
                path.append(symbol)
            prefix = None
            own, other = self.left.arcs[p], self.right.arcs[q]
            for b, end in other.items():
                for a, to in own.items():  # a symbol changed
                    if (a < b if self.same else a != b) and self.lives(to, end):
                        prefix = "".join(path) if prefix is None else prefix
                        for rest in self.rests(to, end):
                            yield prefix + a + rest, prefix + b + rest
                if self.lives(p, end):  # a symbol added
                    prefix = "".join(path) if prefix is None else prefix
                    for rest in self.rests(p, end, b):
                        yield prefix + rest, prefix + b + rest
            if not self.same:
                for a, to in own.items():  # a symbol dropped
                    if self.lives(to, q):
                        prefix = "".join(path) if prefix is None else prefix
                        for rest in self.rests(to, q, a):
                            yield prefix + a + rest, prefix + rest
            todo += [(to, other[step], depth + 1, step) for step, to in own.items() if step in other]


# ---------------------------------------------------------------- Spark


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: letter runs of at least ``SHORTEST`` code points with at least ``FEWEST`` occurrences."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("doc"), run.alias("run")).select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    dropped = F.concat(F.expr("substring(run, 1, CAST(h % length(run) AS INT))"), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 31 == 0, dropped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEWEST)


def by_state(words: DataFrame) -> DataFrame:
    """``key, word, n``: each word at the states its first and its last symbols lead to."""
    size = F.length("word")
    shorter = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= SHORTEST)).alias("m")
    held = words.select("word", "n", shorter).withColumn("h", F.floor((F.col("m") - 1) / 2).cast("int"))
    forth = F.concat_ws(">", "m", F.substring(F.col("word"), F.lit(1), F.col("h")))
    back = F.concat_ws("<", "m", F.right("word", F.col("h")))
    return held.select(F.explode(F.array(forth, back)).alias("key"), "word", "n")


def state_pairs(key: str, rows: list[tuple[str, int]]) -> Iterator[tuple[str, str]]:
    """Near pairs of one state; ``rows`` of (word, block). With two blocks, pairs across them."""
    sign = ">" if ">" in key else "<"
    m = int(key.split(sign, 1)[0])
    h = (m - 1) // 2
    forth = sign == ">"
    blocks: dict[int, list[str]] = {}
    for word, own in rows:
        blocks.setdefault(own, []).append(word[h:] if forth else word[: len(word) - h][::-1])
    shared = rows[0][0][:h] if forth else rows[0][0][len(rows[0][0]) - h :]
    made = [Acceptor(sorted(words)) for _, words in sorted(blocks.items())]
    for a, b in Composition(made[0], made[-1]).pairs():
        if min(len(a), len(b)) + h != m:
            continue  # both are longer: they meet at another state
        if forth:
            yield shared + a, shared + b
        else:
            a, b = a[::-1] + shared, b[::-1] + shared
            if a[:h] != b[:h]:
                yield a, b


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n``: both directions of every pair one edit apart."""
    rows = blocked(by_state(words).withColumnRenamed("n", "count"), "key", "word", block)

    def work(batches):
        out: list = []

        def whole(table):
            left, right, near = [], [], []
            cols = [table.column(c).to_pylist() for c in ("key", "left", "right", "word", "count", "own")]
            lo = 0
            for hi in range(1, len(cols[0]) + 1):
                if hi < len(cols[0]) and all(c[hi] == c[lo] for c in cols[:3]):
                    continue
                two = cols[1][lo] != cols[2][lo]
                count = dict(zip(cols[3][lo:hi], cols[4][lo:hi]))
                if not two or len(set(cols[5][lo:hi])) == 2:
                    for a, b in state_pairs(cols[0][lo], list(zip(cols[3][lo:hi], cols[5][lo:hi]))):
                        left += (a, b)
                        right += (b, a)
                        near += (count[b], count[a])
                lo = hi
            out.append(pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(near, pa.int64())], ["word", "near", "near_n"]))

        for _ in per_group(batches, ["key", "left", "right"], whole):
            yield out.pop()

    return rows.select("key", "left", "right", "word", "count", "own").mapInArrow(work, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last, twice as far each round. A form is at least ten times
    as frequent as its word, so there are no rings and few rounds."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of the vocabulary."""
    words = cut(vocabulary(docs))
    first = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("near")))
    best = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    form_n = -F.col("best.least")
    is_form = form_n >= factor * F.col("n")
    judged = cut(
        words.join(best, "word", "left").select(
            "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, form_n).alias("form_n")
        )
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    out = judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
