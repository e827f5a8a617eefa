"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document's length is its number of words; one longer than a bin is cut into pieces of a bin's size and a rest, so no
text is dropped or shortened. In a bin there are at most ``PER_SOURCE`` pieces of one source, and one piece of a
duplicate cluster (by default, equal texts).

Items are dealt evenly to shards of about ``SHARD`` pieces by a hash of doc_id, source, text and the number of the copy among
equal rows, so where a piece goes depends on the rows alone and not on their partitions; a task packs a shard, longest piece
first, ties by that hash. Open bins are kept by residual: a bit set of residuals in use gives the successor of a
length, and the search goes on through successors until the tightest compatible bin is found; among equal
residuals the oldest bin wins. Each bin carries bitmaps of sources (one for each allowed repetition) and clusters
of 256 hashed bits; a bit that is not set proves that there is no conflict, one that is set is settled on the bin's
own pieces. Bins are kept apart by which of the shard's hot sources and clusters (an eighth of the items or more) they are closed
to, so a hot key never makes the search walk over the bins that it fills. A shard leaves at most a few bins part-filled
for want of items.

Null or blank text has length 0 and goes into a bin like any other; a null source or doc_id is a value of its own.
Repeated rows are packed each, and conflict as copies; which of them gets which place is the same to the result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import kernels
from embedlens.session import cut

CAPACITY, PER_SOURCE, SHARD = 2048, 2, 50_000
HOT_SHARE = 8
COPIES = 1 << 16


def word_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs``' columns ``keep`` and ``n_words``, of whole texts."""

    def work(batches):
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(kernels.word_bounds(d, o)[2]) for _, _, d, o in kernels.slices(batch.column(0)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n)], [*batch.schema.names[1:], "n_words"])

    rows = docs.select(F.col("text").cast("string").alias("text"), *keep)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(work, f"{kinds}, n_words long")


class _Bins:
    """The open bins of one closed-to set, by residual."""

    def __init__(self):
        self.used, self.at = 0, defaultdict(list)

    def add(self, residual: int, bin_: int) -> None:
        insort(self.at[residual], bin_)
        self.used |= 1 << residual

    def remove(self, residual: int, bin_: int) -> None:
        own = self.at[residual]
        del own[bisect_left(own, bin_)]
        if not own:
            self.used &= ~(1 << residual)

    def successor(self, residual: int) -> int:
        """The least residual in use of at least this one, or -1."""
        above = self.used >> residual
        return residual + (above & -above).bit_length() - 1 if above else -1


def pack(items: Iterable[tuple[int, int, int]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, position) of each item (length, source, cluster) in order; numbers of bins are in order of opening."""
    items = list(items)
    hot = {}
    for kind in (1, 2):
        for key, n in Counter(i[kind] for i in items).items():
            if n * HOT_SHARE >= len(items) and n > 1:
                hot[kind, key] = 1 << len(hot)
    closed = defaultdict(_Bins)
    residual: list[int] = []
    inside: list[list[tuple[int, int]]] = []
    sources: list[list[int]] = []
    clusters: list[int] = []
    shut: list[int] = []
    placed = []

    def conflict(bin_: int, source: int, cluster: int) -> bool:
        if clusters[bin_] >> (cluster & 255) & 1 and any(c == cluster for _, c in inside[bin_]):
            return True
        full = all(bits >> (source & 255) & 1 for bits in sources[bin_])
        return full and sum(s == source for s, _ in inside[bin_]) >= per_source

    for length, source, cluster in items:
        bars = hot.get((1, source), 0) | hot.get((2, cluster), 0)
        best, fit = -1, capacity + 1
        for shut_to, bins in closed.items():
            if shut_to & bars:
                continue
            at = bins.successor(length)
            while -1 < at <= fit:
                own = next((b for b in bins.at[at] if not conflict(b, source, cluster)), -1)
                if own >= 0:
                    if at < fit or own < best:
                        best, fit = own, at
                    break
                at = bins.successor(at + 1)
        if best < 0:
            best, fit = len(residual), capacity
            residual.append(capacity), inside.append([]), sources.append([0] * per_source), clusters.append(0), shut.append(0)
        else:
            closed[shut[best]].remove(fit, best)
        placed.append((best, len(inside[best])))
        inside[best].append((source, cluster))
        clusters[best] |= 1 << (cluster & 255)
        bit = 1 << (source & 255)
        for level, bits in enumerate(sources[best]):
            if not bits & bit:
                sources[best][level] = bits | bit
                break
        if sum(s == source for s, _ in inside[best]) >= per_source:
            shut[best] |= hot.get((1, source), 0)
        shut[best] |= hot.get((2, cluster), 0)
        residual[best] = fit - length
        closed[shut[best]].add(residual[best], best)
    return placed


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, clusters: DataFrame | None = None
) -> DataFrame:
    """``doc_id, piece, first_word, n_words, shard, bin, position``: a row per piece of each row of ``docs``.

    ``clusters``: ``doc_id, cluster`` (long) of near duplicates, in place of equal texts."""
    rows = docs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    if clusters is None:
        rows = rows.withColumn("cluster_", F.xxhash64(text))
    else:
        given = clusters.groupBy("doc_id").agg(F.min("cluster").alias("cluster_"))
        rows = rows.drop("cluster_").join(given, "doc_id", "left").withColumn("cluster_", F.coalesce("cluster_", F.xxhash64("doc_id", text)))
    rows = rows.select("doc_id", "text", F.xxhash64(source).alias("source_"), "cluster_", *(F.xxhash64(F.lit(k), "doc_id", source, text).alias(f"row{k}") for k in (1, 2)))
    keys = ["doc_id", "source_", "cluster_", "row1", "row2"]
    counted = cut(word_counts(rows, *keys).groupBy(*keys, "n_words").agg(F.count(F.lit(1)).alias("copies")))
    pieces = F.greatest(F.ceil(F.col("n_words") / capacity), F.lit(1)).cast("int")
    cut_up = (
        counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
        .withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("copies")) - 1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("first_word", F.col("piece").cast("long") * capacity)
        .withColumn("length", F.least(F.lit(capacity), F.col("n_words") - F.col("first_word")).cast("long"))
    )
    n = counted.agg(F.sum(pieces * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-n // shard))
    dealt = cut_up.withColumn("shard", F.pmod(F.xxhash64("row1", "row2", "copy", "piece"), F.lit(shards)).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("piece", "copy", "row2", "row1")] + [-table.column("length").to_numpy()])
        table = table.take(pa.array(order))
        items = zip(*(table.column(c).to_pylist() for c in ("length", "source_", "cluster_")))
        placed = np.array(pack(items, capacity, per_source), np.int64).reshape(-1, 2)
        out = {c: table.column(c) for c in ("doc_id", "piece", "first_word")}
        return pa.table(out | {"n_words": table.column("length"), "shard": table.column("shard"), "bin": placed[:, 0], "position": placed[:, 1]})

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, first_word long, n_words long, shard int, bin long, position long"
    return dealt.select("doc_id", "row1", "row2", "copy", "piece", "first_word", "length", "source_", "cluster_", "shard").groupBy("shard").applyInArrow(work, kind)
