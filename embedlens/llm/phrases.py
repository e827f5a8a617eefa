"""Phrase collocations from a weighted de Bruijn graph of words.

Graph, one per language. A node is two words in a row, an edge the three words by which two nodes overlap; its weight is how often they
follow each other inside a piece of text. A piece ends with the sign ``END``: every word occurrence starts just one edge (word, next or
``END``, next but one or ``END``). So nothing shorter needs to be counted: how often a pair of words occurs is the flow out of its node,
edges to ``END`` included (the piece-end correction), and how often a word occurs is the flow out of the nodes it begins.

On Spark. Edges are combined within slices of a task and dealt by node. The rows of a partition arrive sorted and are summed as they pass: edges and
nodes of at least ``least`` occurrences and partial sums of words are all that leaves. Nodes that hold a large share of a
bounded sample of documents are dealt by edge instead and their flows summed afterwards, and the sample's most frequent words get short
numbers, which take less room in the shuffle; results do not depend on the sample.

A node is unary if all its occurrences come by one edge and leave by one, so both weigh as much as the node. Edges that meet in unary nodes
are compacted into paths: longest word sequences of one weight. They are found by pointer doubling over the frequent edges. Inside a path
every pair occurs as often as the path; only pairs at its ends need their node's flow.

All other words are 64-bit hashes of language and word until the end; hashes are checked against the words themselves and
the count starts anew with another seed should two of them share one. Languages with a NUL character are not told from their beginnings.

Null or empty text: no words. Null language: ``und``. Repeated rows count again. Other columns are ignored. Texts and pieces of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlens.llm import kernels
from embedlens.session import cut

LEAST, COVER, FIRST = 10, 50, 2000
SLICE_BYTES = 8_000_000  # text whose edges are combined at a time
SAMPLE_ROWS, HOT_SHARE, SALTS = 2000, 0.002, 64
END = 0
CODES = 1 << 16  # numbers below are kept for the most frequent words of the sample
_ENDS = b".,;:!?\n\x0b\x0c\r"
_GAPS = b" \t"


# ---------------------------------------------------------------- edges of texts


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, the number of its text and the number of its piece."""
    kind = np.zeros(256, np.uint8)
    kind[list(_GAPS)], kind[list(_ENDS)] = 1, 2
    sort = kind[data]
    inside = sort == 0
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    begin[first], finish[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    text = np.searchsorted(offs, starts, "right") - 1
    stops = np.concatenate([[0], np.cumsum(sort == 2)])
    return starts, ends, text, stops[starts] + text


def edges(words: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, second and third word of the edge that each word starts; ``END`` beyond its piece."""
    second, third = np.zeros_like(words), np.zeros_like(words)
    second[:-1] = np.where(piece[1:] == piece[:-1], words[1:], END)
    third[:-2] = np.where(piece[2:] == piece[:-2], words[2:], END)
    return words, second, third


def combined(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray | None = None):
    """Distinct rows, sorted, with their sums."""
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    if n is None:
        total = np.diff(np.append(at, len(a)))
    else:
        total = np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return a[at], b[at], c[at], total.astype(np.int64), order[at]


def _hashes(data, starts, ends, text, langs, seed) -> np.ndarray:
    salt = kernels.mix(langs[text] + np.uint64(seed))
    words = kernels.mix(kernels.hash_runs(data, starts, ends) ^ salt)
    words[words < CODES] += np.uint64(1 << 63)
    return words


def _names(langs: pa.Array, words: pa.Array) -> pa.Array:
    """Language and word in one text; languages hold no NUL before a word."""
    return pc.binary_join_element_wise(langs.cast(pa.string()), words.cast(pa.string()), "\0")


def _edge_rows(docs: DataFrame, seed: int, common: np.ndarray, hot: np.ndarray) -> DataFrame:
    """``a, b, c, n, salt, name``: combined edges of slices; each word's name once a task, with n 0.

    ``common``: hashes of words that get short numbers, their places here. ``hot``: nodes dealt by edge. The empty word of a language
    stands for all its words: n words."""
    held = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    rows = held.select("lang", "text", F.xxhash64("lang").alias("code")).where("text IS NOT NULL")
    order = np.argsort(common)
    known = common[order]

    def numbered(words):
        if not len(known):
            return words
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return np.where(known[at] == words, (order[at] + 1).astype(np.uint64), words)

    hot_a, hot_b = (numbered(hot[:, i].view(np.uint64)).view(np.int64) for i in (0, 1))

    def work(batches):
        seen = np.zeros(0, np.uint64)  # names this task has sent
        for batch in batches:
            for lo, hi, data, offs in kernels.slices(batch.column(1), SLICE_BYTES):
                data = kernels.lower_ascii(data)
                starts, ends, text, piece = pieces(data, offs)
                if not len(starts):
                    continue
                langs = batch.column(2).slice(lo, hi - lo).to_numpy().view(np.uint64)
                hashed = _hashes(data, starts, ends, text, langs, seed)
                words = numbered(hashed).view(np.int64)
                a, b, c, n, _ = combined(*edges(words, piece))
                salt = np.zeros(len(a), np.int32)
                for x, y in zip(hot_a, hot_b):
                    own = slice(*np.searchsorted(a, [x, x + 1]))
                    salt[own] = np.where(b[own] == y, 1 + (c[own] & (SALTS - 1)), salt[own])
                yield _edge_batch(a, b, c, n, salt, pa.nulls(len(a), pa.string()))
                # words new to this task, and words of one hash told apart by another
                second = kernels.hash_runs(data ^ np.uint8(0x5A), starts, ends)
                both = kernels.mix(hashed + second)
                _, at = np.unique(both, return_index=True)
                at = at[~np.isin(both[at], seen)]
                seen = np.union1d(seen, both[at])
                raw = data.tobytes()
                texts = pa.array([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], pa.binary())
                own = batch.column(0).slice(lo, hi - lo)
                zero = np.zeros(len(at), np.int64)
                yield _edge_batch(words[at], zero, zero, zero, zero.astype(np.int32), _names(own.take(pa.array(text[at])), texts))
                first, count = np.unique(langs[text], return_counts=True)
                at = np.array([int(np.flatnonzero(langs == x)[0]) for x in first])
                zero = np.zeros(len(at), np.int64)
                empty = pa.array([b""] * len(at), pa.binary())
                whole = kernels.mix(first ^ np.uint64(0xA5A5A5A5)) | np.uint64(1 << 63)
                yield _edge_batch(whole.view(np.int64), zero, zero, count.astype(np.int64), zero.astype(np.int32), _names(own.take(pa.array(at)), empty))

    return rows.mapInArrow(work, "a long, b long, c long, n long, salt int, name string")


_EDGE = ["a", "b", "c", "n", "salt", "name"]


def _edge_batch(a, b, c, n, salt, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a, b, c, n, salt)), names], _EDGE)


def _sampled(docs: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, and the nodes that hold more than ``HOT_SHARE`` of the edges, in about ``SAMPLE_ROWS`` documents chosen by hash.

    Results do not depend on them: words get shorter numbers and nodes are added up elsewhere."""
    none = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(max(1, n // SAMPLE_ROWS))) == 0)
    rows = cut(_edge_rows(some, seed, *none).where("n > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("n")))
    total = rows.agg(F.sum("edges")).first()[0] or 0
    hot = rows.where((F.col("b") != END) & (F.col("edges") > HOT_SHARE * total)).select("a", "b").collect()  # at most 1 / HOT_SHARE
    common = rows.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "a").limit(CODES - 1).toArrow()
    return common["a"].to_numpy().view(np.uint64), np.array([(r.a, r.b) for r in hot], np.int64).reshape(-1, 2)


# ---------------------------------------------------------------- flows


def flows(docs: DataFrame, least: int = LEAST, seed: int = 0) -> DataFrame:
    """``a, b, c, n, name, shared``: edges (c set), nodes (b set, c null) and words (b null) of at least ``least`` occurrences, and each
    language's empty word with the number of all its words. ``shared``: more than one word has this number."""
    dealt = _edge_rows(docs, seed, *_sampled(docs, seed)).repartition("a", "b", "salt").sortWithinPartitions("a", "b", "salt", "c")

    def sums(a, b, c, n, salt):
        """Rows that leave, from the rows of whole nodes."""
        node = np.ones(len(a), bool)
        node[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (salt[1:] != salt[:-1])
        edge, one = node.copy(), np.ones(len(a), bool)
        edge[1:] |= c[1:] != c[:-1]
        one[1:] = a[1:] != a[:-1]
        at, total = _runs(edge, n)
        big = (total >= least) & (b[at] != END) & (c[at] != END)
        yield _flow_rows(a[at[big]], b[at[big]], c[at[big]], total[big])
        at, total = _runs(node, n)
        big = ((total >= least) | (salt[at] > 0)) & (b[at] != END)
        yield _flow_rows(a[at[big]], b[at[big]], None, total[big])
        at, total = _runs(one, n)
        yield _flow_rows(a[at], None, None, total)

    def work(batches):
        rest = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            if not batch.num_rows:
                continue
            named = pa.Table.from_batches([batch]).filter(batch.column(5).is_valid())
            if named.num_rows:
                names = named.group_by(["a", "name"]).aggregate([])
                yield _flow_rows(names["a"].to_numpy(), None, None, np.zeros(len(names), np.int64), names["name"].combine_chunks())
            cols = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            # the last node may go on in the next batch: its edges are summed and kept back
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[4] == cols[4][-1])
            stop = len(last) - int(last.sum())
            if stop:
                yield from sums(*(x[:stop] for x in cols))
            *rest, at = combined(*(x[stop:] for x in cols[:4]))
            rest.append(cols[4][stop:][at])
        if len(rest[0]):
            yield from sums(*rest)

    parts = dealt.mapInArrow(work, "a long, b long, c long, n long, name string")
    whole = parts.groupBy("a", "b", "c").agg(F.sum("n").alias("n"), F.min("name").alias("name"), F.max("name").alias("other"))
    whole = whole.select("a", "b", "c", "n", "name", F.coalesce(F.col("name") != F.col("other"), F.lit(False)).alias("shared"))
    return whole.where((F.col("n") >= least) | F.col("name").endswith("\0"))


def _runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(first)
    return at, np.add.reduceat(n, at)


def _flow_rows(a, b, c, n, names: pa.Array | None = None) -> pa.RecordBatch:
    size = len(a)
    ids = [pa.array(a), *(pa.nulls(size, pa.int64()) if x is None else pa.array(x) for x in (b, c)), pa.array(n)]
    return pa.RecordBatch.from_arrays([*ids, pa.nulls(size, pa.string()) if names is None else names], ["a", "b", "c", "n", "name"])


def graph(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges ``a, b, c, n``; nodes ``a, b, f``; words ``a, f, lang, word``, each of at least ``least`` occurrences, and the empty words."""
    for seed in range(64):
        all_ = cut(flows(docs, least, seed))
        if all_.where("shared").isEmpty():
            break
    words = all_.where("b IS NULL").select("a", F.col("n").alias("f"), F.substring_index("name", "\0", 1).alias("lang"), F.expr("substring(name, locate('\\0', name) + 1)").alias("word"))
    return all_.where("c IS NOT NULL").select("a", "b", "c", "n"), all_.where("b IS NOT NULL AND c IS NULL").select("a", "b", F.col("n").alias("f")), words


# ---------------------------------------------------------------- paths


def paths(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, words, n``: edges compacted at unary nodes; ``words`` are hashes in order."""
    rows = cut(edges_.withColumn("e", F.monotonically_increasing_id()))
    into = rows.join(nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), "f"), ["b", "c"]).where("n = f")
    out = rows.join(nodes, ["a", "b"]).where("n = f").select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("e").alias("after"))
    joints = into.select("b", "c", F.col("e").alias("before")).join(out, ["b", "c"]).select(F.col("after").alias("e"), F.col("before").alias("head"))
    now = cut(joints.withColumn("d", F.lit(1).cast("long")))
    while True:  # each round looks twice as far back; a path is part of one piece of text, so rounds are few
        far = now.select(F.col("e").alias("head"), F.col("head").alias("next"), F.col("d").alias("more"))
        step = now.join(far, "head", "left")
        now = cut(step.select("e", F.coalesce("next", "head").alias("head"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    placed = rows.join(now.drop("moved"), "e", "left").select(F.coalesce("head", "e").alias("path"), F.coalesce("d", F.lit(0)).alias("d"), "a", "b", "c", "n")
    steps = F.array_sort(F.collect_list(F.struct("d", "a", "b", "c"))).alias("steps")
    whole = placed.groupBy("path").agg(steps, F.first("n").alias("n"))
    words = F.concat(F.array(F.col("steps")[0]["a"], F.col("steps")[0]["b"]), F.transform("steps", lambda s: s["c"]))
    return cut(whole.select("path", words.alias("words"), "n"))


# ---------------------------------------------------------------- phrases


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits (counts below 10^16)."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases of two and three words."""
    edges_, nodes, words = graph(docs, least)
    strings = paths(edges_, nodes)
    size = F.size("words")
    ends = strings.select(
        "path", "n", F.col("words")[0].alias("a1"), F.col("words")[1].alias("b1"), F.element_at("words", -2).alias("a2"), F.element_at("words", -1).alias("b2")
    )
    # pairs within a path occur as often as it does, so the path covers them: only pairs at ends of paths can stay
    within = strings.where(size > 3).select(F.explode(F.expr("transform(sequence(1, size(words) - 3), i -> struct(words[i] AS a, words[i + 1] AS b))")).alias("w")).select("w.a", "w.b")
    over = ends.select(F.explode(F.array(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")))).alias("w"), "n")
    over = over.groupBy("w.a", "w.b").agg(F.max("n").alias("over"))
    pairs = nodes.join(within, ["a", "b"], "left_anti").join(over, ["a", "b"], "left").where(F.coalesce(100 * F.col("over") < cover * F.col("f"), F.lit(True)))

    def named(rows: DataFrame, key: str, f: str, word: str, lang: bool = False) -> DataFrame:
        held = words.select(F.col("a").alias(key), F.col("f").alias(f), F.col("word").alias(word), *([F.col("lang")] if lang else []))
        return rows.join(held, key)

    two = named(named(pairs.select(F.col("a").alias("w1"), F.col("b").alias("w2"), F.col("f").alias("a")), "w1", "l", "t1", True), "w2", "r", "t2")
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    flow = ends.join(nodes.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("f").alias("f1")), ["a1", "b1"])
    flow = flow.join(nodes.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("f").alias("f2")), ["a2", "b2"]).select("path", "f1", "f2")
    each = strings.join(flow, "path").select(
        "n", "f1", "f2", size.alias("size"), F.posexplode(F.expr("transform(sequence(0, size(words) - 3), i -> struct(words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3))")).alias("i", "w")
    )
    three = each.select(
        "w.*", F.col("n").alias("a"), F.when(F.col("i") == 0, F.col("f1")).otherwise(F.col("n")).alias("left2"),
        F.when(F.col("i") == F.col("size") - 3, F.col("f2")).otherwise(F.col("n")).alias("right2"),
    )
    three = named(named(named(three, "w1", "fa", "t1", True), "w2", "fb", "t2"), "w3", "fc", "t3")
    one, other = _score(F.col("a"), F.col("fa"), F.col("right2")), _score(F.col("a"), F.col("left2"), F.col("fc"))
    three = three.withColumn("s1", one).withColumn("s2", other)
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(early, F.col("fa")).otherwise(F.col("left2")).alias("l"),
        F.when(early, F.col("right2")).otherwise(F.col("fc")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))
    best = two.unionByName(three).withColumn("rank", some).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = words.where("word = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
