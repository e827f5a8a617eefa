"""Near-duplicate documents by MinHash and a multi-index Hamming join.

Method. A document is the set of its distinct word shingles. Documents with equal sets form a class, and only classes
are compared. A class has a signature of ``SYMBOLS`` b-bit symbols (b = 16), each from one MinHash function. Two
signatures differ in a number of symbols, their Hamming distance; at similarity s it is Binomial(32, 1 - s), so a pair at
0.85 exceeds ``DISTANCE`` = 15 with probability 3e-6. Signatures are split into ``CHUNKS`` = 8 chunks of four symbols. By
pigeonhole two signatures within distance 15 agree in some chunk up to floor(15 / 8) = 1 symbol. The allowed error is
enumerated: a chunk gives one key per symbol left out. So every pair within the distance shares a key.

Per shared key a task keeps a spanning forest of the pairs within the distance (never the pairs), the forests' components
are candidate groups, and inside a group each pair within the distance and not connected yet is confirmed on the full
sets, one set against all others at a time. Groups and keys above ``BLOCK`` members are cut into blocks; each pair
of blocks is a task. Links and groups stay in DataFrames.

Null or blank text: empty set, linked with nothing. Null doc_id: never linked, kept. Rows with equal doc_id and equal text give
equal results; rows of one doc_id with other texts are linked by their own texts. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import kernels
from embedlens.llm.blocks import blocked, per_group
from embedlens.operators.components import components
from embedlens.session import cut

SYMBOLS, CHUNKS, DISTANCE = 32, 8, 15
BLOCK = 4096

_XOR = kernels.stream(11, SYMBOLS)
_ODD = kernels.stream(12, SYMBOLS) | np.uint64(1)


def signature(values: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` symbols of 16 bits of a set of 64-bit hashes."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 8192):
        np.minimum(low, ((values[at : at + 8192, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    return (kernels.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, text_hash, n_shingles, high, low, signature``: set size, 128-bit set fingerprint, symbols as bytes."""

    def work(batches):
        for batch in batches:
            n, high, low, sig = [], [], [], []
            for _, sets in kernels.shingle_sets(batch.column(1), size):
                for s in sets:
                    a, b = kernels.set_fingerprint(s)
                    n.append(len(s)), high.append(a), low.append(b)
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "high", "low", "signature"],
            )

    return _rows(docs).mapInArrow(work, "doc_id long, text_hash long, n_shingles long, high long, low long, signature binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: chunk, left-out symbol and the other symbols of the chunk, hashed."""
    width = SYMBOLS // CHUNKS
    parts = sig.reshape(len(sig), CHUNKS, width).astype(np.uint64)
    keys = np.empty((len(sig), CHUNKS, width), np.uint64)
    for out in range(width):
        packed = np.zeros(parts.shape[:2], np.uint64)
        for j in range(width):
            if j != out:
                packed = (packed << np.uint64(16)) | parts[:, :, j]
        salt = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(width) + np.uint64(out)) << np.uint64(48)
        keys[:, :, out] = kernels.mix(packed | salt[None, :])
    return keys.reshape(len(sig), -1)


def _matrix(column) -> np.ndarray:
    raw, offs = kernels.text_bytes(column)
    return raw[offs[0] : offs[-1]].view(np.uint16).reshape(-1, SYMBOLS)


def keyed(classes: DataFrame) -> DataFrame:
    """``key, node, signature``: a row per class and key."""

    def work(batches):
        for batch in batches:
            keys = chunk_keys(_matrix(batch.column(1)))
            per = keys.shape[1]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), per))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(rows)], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(work, "key long, node long")


def _near(sig: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    return others[(sig[others] != sig[one]).sum(axis=1) <= DISTANCE]


def forest(sig: np.ndarray, own: np.ndarray, left: int, right: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the distance of one group, breadth first.

    With left <> right only pairs across the two blocks count."""
    rest, links = np.arange(len(sig)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            open_ = rest if left == right else rest[own[rest] != own[one]]
            got = _near(sig, one, open_)
            if len(got):
                links += [(one, int(g)) for g in got]
                front += [int(g) for g in got]
                rest = rest[~np.isin(rest, got)]
    return links


def _groups(table: pa.Table, keys: list[str]):
    cols = [table.column(k).to_numpy() for k in keys]
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return cols, list(zip(starts, np.append(starts[1:], table.num_rows)))


_PAIR = "a long, b long"


def _pairs(ids: np.ndarray, links: list[tuple[int, int]]):
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]], pa.int64()), pa.array(ids[at[:, 1]], pa.int64())], ["a", "b"])


def candidate_links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: for every key a spanning forest of its pairs of classes within the distance."""
    rows = blocked(keyed(classes), "key", "node", block, classes.select("node", "signature"))

    def work(batches):
        out: list = []

        def whole(table):
            (_, left, right), runs = _groups(table, ["key", "left", "right"])
            ids, own = table.column("node").to_numpy(), table.column("own").to_numpy()
            sig = _matrix(table.column("signature"))
            links = []
            for lo, hi in runs:
                links += [(lo + a, lo + b) for a, b in forest(sig[lo:hi], own[lo:hi], int(left[lo]), int(right[lo]))]
            out.append(_pairs(ids, links))

        for _ in per_group(batches, ["key", "left", "right"], whole):
            yield out.pop()

    return rows.mapInArrow(work, _PAIR).distinct()


def confirm(sets: list[np.ndarray], sig: np.ndarray, own: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links of one group on full sets; pairs that links found before already connect are left out."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = np.arange(n)
    links = []
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[root[others] != root[i]]
        if across:
            others = others[own[others] != own[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = _near(sig, i, others[100 * small >= percent * large])
        if not len(others):
            continue
        joined = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
        hits = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        for j in others[100 * hits >= percent * (sizes[others] + sizes[i] - hits)]:
            links.append((i, int(j)))
            root[root == root[j]] = root[i]
    return links


def confirmed_links(members: DataFrame, percent: int = 85, size: int = 5, block: int = BLOCK) -> DataFrame:
    """``a, b`` from ``node, group, signature, text``: enough links, each with 100 * intersection >= percent * union."""
    rows = blocked(members, "group", "node", block)

    def work(batches):
        out: list = []

        def whole(table):
            (_, left, right), runs = _groups(table, ["group", "left", "right"])
            ids, own = table.column("node").to_numpy(), table.column("own").to_numpy()
            sig = _matrix(table.column("signature"))
            links, text = [], table.column("text")
            for lo, hi in runs:
                sets = [s for _, part in kernels.shingle_sets(text.slice(lo, hi - lo), size) for s in part]
                got = confirm(sets, sig[lo:hi], own[lo:hi], left[lo] != right[lo], percent)
                links += [(lo + a, lo + b) for a, b in got]
            out.append(_pairs(ids, links))

        for _ in per_group(batches, ["group", "left", "right"], whole):
            yield out.pop()

    return rows.mapInArrow(work, _PAIR).distinct()


def _texts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``node, group, signature, text`` of the first document of each class; a row that is repeated counts once."""
    once = [F.first(c).alias(c) for c in ("node", "group", "signature", "text")]
    return _rows(docs).join(groups, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(*once).drop("doc_id", "text_hash")


def _judged(docs: DataFrame, percent: int, size: int, block: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept``: one row per row of ``docs``."""
    signed = cut(signatures(docs, size))
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = cut(
        signed.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("high", "low")
        .agg(first.alias("first"), F.first("signature").alias("signature"))
        .select(F.xxhash64("high", "low").alias("node"), "high", "low", "first.doc_id", "first.text_hash", "signature")
    )
    groups = components(candidate_links(classes, block)).select(F.col("id").alias("node"), F.col("component").alias("group"))
    groups = groups.join(classes, "node").select("node", "group", "signature", "doc_id", "text_hash")
    texts = _texts(docs, groups)
    linked = components(confirmed_links(texts, percent, size, block)).withColumnRenamed("id", "node")
    linked = cut(linked.join(classes.select("node", "doc_id"), "node"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "component").select("node", "component_id")
    members = classes.join(linked, "node", "left").select("high", "low", F.coalesce("component_id", "doc_id").alias("component_id"))
    return (
        signed.join(members, ["high", "low"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "text_hash", "n_shingles", "component_id", "kept")
    )


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``; component = smallest linked doc_id."""
    return _judged(docs, percent, size, block).drop("text_hash")


def remove_near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they were; of repeated rows with one doc_id and text the first stays."""
    judged = cut(_judged(docs, percent, size, block).where("doc_id IS NOT NULL"))
    key = [F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.col("text").cast("string")).alias("hash_")]
    rows = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    out = judged.where("NOT kept").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    rows = rows.join(out, ["id_", "hash_"], "left_anti")
    again = judged.where("kept").groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():
        once = rows.join(again, ["id_", "hash_"], "left_semi").groupBy("id_", "hash_").agg(F.first("row_").alias("row_"))
        rows = rows.join(again, ["id_", "hash_"], "left_anti").unionByName(once)
    return rows.select("row_.*")
