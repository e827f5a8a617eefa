"""Nearest neighbours by vantage-point trees, one per shard.

Shards are cut by a hash of the row, so they are of about equal size whatever the data. A shard's tree splits its rows again
and again at the median distance from a vantage point. Each side keeps the least and the greatest distance of its rows
to that point. With d the query's distance to it, no row of the side is nearer than d - greatest or least - d (triangle inequality); a
leaf's bound is the greatest of the bounds on its way from the root. A leaf is left out if its bound exceeds ``factor`` times the
query's kth distance so far. Factor 1 gives exact results; a smaller one leaves out leaves that may still hold a neighbour.

Two passes. About the square root of the number of shards are searched first and give each query a kth distance; the others
start from it, so their trees prune at once and only rows within it are returned. A task holds the rows of one shard
(``SHARD`` at most on average) and streams the queries; nothing is broadcast and queries are never collected.

Copies of a vector within a shard stand in the tree once; of their ids only the k smallest of each side of a query's own id
can be listed. Ties go to the smaller id. Vectors null, zero or with null or non-finite components and rows with null id take no
part. Widths: only vectors of the query's width are candidates. Rows that repeat id and vector count once; an id with several
vectors counts as the nearest of them, as query and as candidate. Rows with the query's own id are never candidates. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlens.session import cut

SHARD, LEAST_SHARD, SHARDS = 131_072, 512, 64
LEAF = 128
QUERIES = 256  # of one step in a task
_ROUND = 1e-9  # bounds are widened by this share against rounding


# ---------------------------------------------------------------- one shard


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``a`` to the rows of ``b`` beside them, components added from first to last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


class Tree:
    """Vantage-point tree of distinct rows: vantage points, their sides' distance ranges, and leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.points_at: list[int] = []  # row of each vantage point
        self.leaves: list[np.ndarray] = []
        self.ways: list[list[tuple[int, float, float]]] = []  # of each leaf: (vantage point, least, greatest)
        todo: list[tuple[np.ndarray, list]] = [(np.arange(len(points)), [])]
        while todo:
            rows, way = todo.pop()
            if len(rows) <= leaf:
                if len(rows):
                    self.leaves.append(rows)
                    self.ways.append(way)
                continue
            # the row farthest from the first one lies at the rim: distances from there differ most
            vantage = rows[np.argmax(_squared(points[rows[:1]], points[rows])[0])]
            dist = distances(points[rows], np.broadcast_to(points[vantage], (len(rows), points.shape[1])))
            order = np.argsort(dist, kind="stable")
            number = len(self.points_at)
            self.points_at.append(int(vantage))
            half = len(rows) // 2
            for side in (order[:half], order[half:]):
                todo.append((rows[side], [*way, (number, float(dist[side[0]]), float(dist[side[-1]]))]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to the rows of each leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not self.points_at:
            return out
        to = np.sqrt(_squared(queries, self.points[self.points_at]))
        for leaf, way in enumerate(self.ways):
            for number, least, greatest in way:
                d = to[:, number]
                out[:, leaf] = np.fmax(out[:, leaf], np.fmax(d - greatest, least - d))
        return out


class Shard:
    """Rows of a shard with their tree. ``ids`` of equal vectors are kept together, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        points, group = np.unique(vectors, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([group.reshape(-1).astype(np.int64), ids.astype(np.int64)], axis=1), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(points) + 1))
        self.ids = pairs[:, 1]
        self.several = len(np.unique(self.ids)) < len(self.ids)  # an id with several vectors
        self.tree = Tree(points, leaf)
        self.seen = 0  # rows compared with a query, for measuring

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and distance of the k nearest rows within ``limit``, ties to the smaller id."""
        tree = self.tree
        bounds = tree.bounds(queries)
        kth = limit.copy()
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        home = bounds.argmin(axis=1)
        for own in (True, False):  # each query's nearest leaf first: it gives a kth distance to prune by
            for leaf in np.argsort(bounds.min(axis=0), kind="stable"):
                allowed = factor * kth * (1 + _ROUND) + _ROUND
                ask = np.flatnonzero(((home == leaf) == own) & (bounds[:, leaf] <= allowed))
                if len(ask):
                    found = self._leaf(tree.leaves[leaf], ask, query_ids, queries, k, kth)
                    best, kth = _merge(best, found, k, kth)
        return best

    def _leaf(self, rows, ask, query_ids, queries, k, kth):
        points = self.tree.points[rows]
        self.seen += len(ask) * len(rows)
        fast = _squared(queries[ask], points)
        size = (queries[ask] ** 2).sum(1)[:, None] + (points * points).sum(1).max()
        near = fast <= (kth[ask] ** 2)[:, None] * (1 + _ROUND) + 1e-12 * size
        if len(rows) > k + 1 and not self.several:  # one of them may be the query itself
            cut_at = np.partition(fast, k, axis=1)[:, k][:, None]
            near &= fast <= cut_at + 1e-12 * size
        near |= ~np.isfinite(fast)  # squares beyond the range of doubles
        i, j = np.nonzero(near)
        if not len(i):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        dist = distances(queries[ask[i]], points[j])
        # of equal vectors, the k + 1 smallest ids: one may be the query's own
        lo = self.first[rows[j]]
        many = np.minimum(self.first[rows[j] + 1] - lo, k + 1)
        at = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        query, dist, ids = np.repeat(ask[i], many), np.repeat(dist, many), self.ids[at]
        other = (ids != query_ids[query]) & (dist <= kth[query])
        return query[other], ids[other], dist[other]


def _merge(best, found, k, kth):
    query, ids, dist = (np.concatenate([a, b]) for a, b in zip(best, found))
    order = np.lexsort((ids, dist, query))
    query, ids, dist = query[order], ids[order], dist[order]
    # an id with several vectors is listed once, for the nearest: entries of one query and id, the first of them kept
    by_id = np.lexsort((np.arange(len(query)), ids, query))
    again = np.zeros(len(query), bool)
    again[by_id[1:]] = (query[by_id[1:]] == query[by_id[:-1]]) & (ids[by_id[1:]] == ids[by_id[:-1]])
    query, ids, dist = query[~again], ids[~again], dist[~again]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    full = np.flatnonzero(place == k - 1)
    kth = kth.copy()
    kth[query[full]] = np.minimum(kth[query[full]], dist[full])
    return (query[keep], ids[keep], dist[keep]), kth


# ---------------------------------------------------------------- Spark


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite components."""
    far = F.lit(float("inf"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < far))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


_OUT = "query_id long, vec_id long, score double"


def _searched(rows: DataFrame, queries: DataFrame, shards: Column, k: int, factor: float, leaf: int) -> DataFrame:
    """The k nearest rows of each query in each shard. ``rows``: id, vector, width, shard; ``queries``: id, vector, width, limit."""
    held = rows.select("width", "shard", F.lit(0).alias("kind"), "id", "vector", F.lit(0.0).alias("limit"))
    asked = queries.select("width", F.explode(shards).alias("shard"), F.lit(1).alias("kind"), "id", "vector", "limit")
    dealt = held.unionByName(asked).repartition("width", "shard").sortWithinPartitions("width", "shard", "kind")

    def work(batches):
        np.seterr(over="ignore", invalid="ignore")  # squares beyond the range of doubles are looked at singly
        shard, name, ids, vectors = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            steps = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *steps], [*steps, len(keys)]):
                width, number, kind = (int(x) for x in keys[lo])
                if (width, number) != name:
                    shard, name, ids, vectors = None, (width, number), [], []
                part = batch.slice(lo, hi - lo)
                own = part.column(3).to_numpy()
                flat = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                if kind == 0:
                    ids.append(own), vectors.append(flat)
                    continue
                if shard is None and ids:
                    shard, ids, vectors = Shard(np.concatenate(ids), np.concatenate(vectors), leaf), [], []
                if shard is None:
                    continue
                limit = part.column(5).to_numpy()
                for at in range(0, len(own), QUERIES):
                    q = slice(at, at + QUERIES)
                    query, found, dist = shard.search(own[q], flat[q], k, limit[q], factor)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q][query]), pa.array(found), pa.array(dist)], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(work, _OUT)


def nearest(
    rows: DataFrame, queries: Column, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD, leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of each row for which ``queries`` (a condition on ``vec_id``) holds.

    ``shard_rows`` bounds the mean number of rows of a shard; smaller tables are cut into up to ``SHARDS`` shards for parallel work."""
    vector = F.col(vector_col)
    good = rows.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    hashed = F.xxhash64("vec_id", "vector")
    n = good.count()
    shards = max(-(-n // shard_rows), min(SHARDS, -(-n // LEAST_SHARD)), 1)
    first = math.isqrt(shards - 1) + 1
    held = good.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).select(
        F.size("vector").alias("width"), "shard", F.col("vec_id").alias("id"), "vector", queries.alias("asked")
    )
    asked = held.where("asked").select("width", "id", "vector").distinct()

    def best(found: DataFrame) -> DataFrame:
        each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return each.withColumn("rank", place).where(F.col("rank") <= k)

    def part(lo: int, hi: int, limited: DataFrame) -> DataFrame:
        return _searched(held.where(F.col("shard").between(lo, hi - 1)), limited, F.sequence(F.lit(lo), F.lit(hi - 1)), k, factor, leaf)

    near = best(part(0, first, asked.withColumn("limit", F.lit(float("inf")))))
    if first < shards:
        near = cut(near)
        kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
        limited = asked.join(kth, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        near = best(near.drop("rank").unionByName(part(first, shards, limited)))
    return near.select("query_id", "rank", "vec_id", "score")
