"""Epochs of a layout, run by tasks that hold a block of points each.

Points are numbered along their first axis and cut into blocks of consecutive numbers. A round is one Spark job: a task gets the points of its
block, their links and the positions of the links' other ends (its halo), and runs several epochs; what it emits are its points, a halo for every
block that its points are linked to, and a few of them as a pool. Up to ``ONE_BLOCK`` points (or ``one_block``) make one block and all epochs one round, in step.
Beyond that, ends in other blocks and sums over all points are those of the round's start, at most ``stale`` epochs old. Every epoch
is run for every point, and results depend on the rows alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.operators.farfield import AXES, Pyramid, pyramid
from embedlens.operators.ordering import with_ordinal
from embedlens.session import cut

ONE_BLOCK, BLOCKS, MOST_ROWS = 4096, 24, 65_536  # rows of a block at least, blocks of all rows while blocks have at most so many rows
POOL_ROWS = 512
HELD, OWN, HALO, POOL = range(4)  # kinds of rows
ROW = "block int, side int, o bigint, nb array<bigint>, w array<float>, p array<double>, v array<double>, q double"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def blocks_of(n: int, one_block: int | None = None) -> int:
    return 1 if n <= (one_block or ONE_BLOCK) else max(-(-n // MOST_ROWS), min(BLOCKS, -(-n // ONE_BLOCK)))


def mixed(o: np.ndarray, salt: int) -> np.ndarray:
    """A hash of point numbers."""
    h = o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """A block's points: numbers, positions, speeds; links from ``u`` to places ``to`` of own points and halo."""

    n: int
    o: np.ndarray
    at: np.ndarray
    speed: np.ndarray
    u: np.ndarray
    nb: np.ndarray
    w: np.ndarray
    halo: np.ndarray
    far: np.ndarray  # positions of the halo
    pool: np.ndarray
    pooled: np.ndarray  # positions of the pool
    alone: bool
    q: np.ndarray = field(init=False)
    to: np.ndarray = field(init=False)

    def __post_init__(self):
        self.q, own = np.zeros(len(self.o)), self.nb - self.o[0]
        inside = (own >= 0) & (own < len(self.o))
        self.to = np.where(inside, own, len(self.o) + np.searchsorted(self.halo, self.nb))

    def differences(self, links=slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point, difference of ends and squared distance of links."""
        u = self.u[links]
        d = self.at[u] - np.concatenate([self.at, self.far])[self.to[links]]
        return u, d, np.maximum((d * d).sum(1), 1e-10)

    def sums(self, u: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(u, values[:, c], len(self.o)) for c in range(3)], axis=1)


def _lists(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _array(lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32")), pa.array(flat))


def _emitted(side: int, blocks, **columns) -> pa.RecordBatch:
    n = len(blocks)
    kinds = {"o": pa.int64(), "nb": pa.list_(pa.int64()), "w": pa.list_(pa.float32()), "p": pa.list_(pa.float64()), "v": pa.list_(pa.float64()), "q": pa.float64()}
    arrays = [pa.array(np.asarray(blocks, "int32")), pa.array(np.full(n, side, "int32"))]
    return pa.RecordBatch.from_arrays(arrays + [columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()], NAMES)


def _round(n: int, size: int, count: int, number: int, pool_rows: int, advance: Callable[[Block], None]):
    def work(batches):
        parts: dict[int, list] = {HELD: [], OWN: [], HALO: [], POOL: []}
        name = None
        for batch in batches:
            side = batch.column(1).to_numpy()
            if (batch.column(0).to_numpy() != (name if name is not None else batch.column(0)[0].as_py())).any():
                raise ValueError("two blocks in one partition")
            for kind in np.unique(side):  # rows come in the order of sides
                name = batch.column(0)[0].as_py() if name is None else name
                own = np.flatnonzero(side == kind)
                parts[int(kind)].append(batch.slice(own[0], len(own)))
        if name is None:
            return
        held, own = (pa.Table.from_batches(parts[kind]) for kind in (HELD, OWN))
        ends, points = {}, {}
        for kind in (HALO, POOL):
            rows = pa.Table.from_batches(parts[kind]) if parts[kind] else None
            o = _lists(rows, "nb") if rows else np.zeros(0, np.int64)
            order = np.argsort(o)
            ends[kind], points[kind] = o[order], (_lists(rows, "p").reshape(-1, 3) if rows else np.zeros((0, 3)))[order]
        lengths = np.diff(held["nb"].combine_chunks().offsets.to_numpy())
        nb, w = _lists(held, "nb"), _lists(held, "w").astype(float)
        block = Block(
            n, own["o"].to_numpy(), _lists(own, "p").reshape(-1, 3).copy(), _lists(own, "v").reshape(-1, 3).copy(), np.repeat(np.arange(len(held)), lengths), nb, w,
            ends[HALO], points[HALO], ends[POOL], points[POOL], count == 1,
        )
        advance(block)
        m = len(block.o)
        three = np.full(m, 3)
        for lo in range(0, m, 8192):
            hi = min(m, lo + 8192)
            yield _emitted(
                OWN, [name] * (hi - lo), o=pa.array(block.o[lo:hi]), p=_array(three[lo:hi], block.at[lo:hi].ravel()),
                v=_array(three[lo:hi], block.speed[lo:hi].ravel()), q=pa.array(block.q[lo:hi]),
            )
        if count == 1:
            return
        picked = np.flatnonzero(mixed(block.o, -1 - number) % np.uint64(n) < np.uint64(pool_rows))
        target = nb // size
        for other in range(count):
            shown = np.unique(block.u[target == other]) if other != name else np.zeros(0, int)
            for kind, rows in ((HALO, shown), (POOL, picked)):
                if len(rows):
                    yield _emitted(kind, [other], nb=_array([len(rows)], block.o[rows]), p=_array([3 * len(rows)], block.at[rows].ravel()))

    return work


def run(coords: DataFrame, graph: DataFrame, n: int, epochs: int, stale: int, step: Callable, far: bool, one_block: int | None = None) -> DataFrame:
    """``(id, x, y, z)`` after all epochs. ``graph``: links ``a, b, weight``, each pair once. ``step(tree, low, mean_q, first, last)`` makes the function that
    carries a block over the epochs from ``first`` to before ``last``; with ``far`` it gets a tree of cell sums of all points and their mean q."""
    spark, count = coords.sparkSession, blocks_of(n, one_block)
    size = -(-n // count)
    numbered = cut(with_ordinal(coords.select("id", *AXES), "x", "id", name="o").select("id", "o", *AXES))
    names = numbered.select("id", "o")
    ends = graph.join(names.select(F.col("id").alias("a"), F.col("o").alias("u")), "a").join(names.select(F.col("id").alias("b"), F.col("o").alias("v")), "b")
    weight = F.col("weight").cast("float").alias("weight")
    both = ends.select("u", "v", weight).unionAll(ends.select(F.col("v").alias("u"), F.col("u").alias("v"), weight))
    lists = both.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "weight"))).alias("n"))
    block = F.expr(f"cast(o div {size} as int)").alias("block")
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (field.split(" ") for field in ROW.split(", "))}
    nb, w = (F.coalesce(F.transform("n", lambda e: e[c]), F.array().cast(t)).alias(a) for a, c, t in (("nb", "v", "array<bigint>"), ("w", "weight", "array<float>")))
    held = names.select("o").join(lists, F.col("o") == F.col("u"), "left").select(block, F.lit(HELD).alias("side"), "o", nb, w, *[empty[c] for c in "pvq"])
    if count > 1:  # one block reads them once
        held = cut(held)
    zero = F.lit(0.0)
    own = numbered.select(block, F.lit(OWN).alias("side"), "o", empty["nb"], empty["w"], F.array(*AXES).alias("p"), F.array(zero, zero, zero).alias("v"), zero.alias("q"))
    # one number per block that the hash partitioning sends to a partition of its own
    dealt = spark.range(64 * count).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("at")).agg(F.min("id").alias("deal")).collect()
    deal = F.element_at(F.array(*[F.lit(r["deal"]).cast("bigint") for r in sorted(dealt, key=lambda r: r["at"])]), F.col("block") + 1)

    def advanced(rows, number, advance):
        work = _round(n, size, count, number, POOL_ROWS * stale, advance)
        placed = held.unionByName(rows).withColumn("deal", deal).repartition(count, "deal").sortWithinPartitions("side", "o").drop("deal")
        return cut(placed.mapInArrow(work, ROW))

    def points(rows):
        return rows.where(F.col("side") == OWN).select("o", *[F.col("p")[i].alias(c) for i, c in enumerate(AXES)], "q")

    def sums(rows):
        if not far or count == 1:
            return None, None, 0.0
        return *pyramid(points(rows)), points(rows).agg(F.avg("q")).first()[0]

    now = own
    if count == 1:
        now = advanced(now, 0, step(None, None, 0.0, 0, epochs))
    else:
        now = advanced(now, -1, lambda block: None)  # halos and pools of the start
        if far:  # and the mean of q there
            tree, low, _ = sums(now)
            now = advanced(now, -1, step(tree, low, 0.0, 0, 0))
        for number, first in enumerate(range(0, epochs, stale)):
            now = advanced(now, number, step(*sums(now), first, min(epochs, first + stale)))
    return names.join(points(now), "o").select("id", *AXES)


# ---------------------------------------------------------------- forces inside a block

CHUNK, TILE = 1024, 256  # points of one step


def push_of_pool(at: np.ndarray, others: np.ndarray, push: Callable) -> np.ndarray:
    """Summed ``push(squared distance) * difference`` from ``others``, each at most 4 along an axis."""
    out = np.zeros(at.shape)
    for lo in range(0, len(at), CHUNK):
        diff = [at[lo : lo + CHUNK, c, None] - others[None, :, c] for c in range(3)]
        strength = push(diff[0] ** 2 + diff[1] ** 2 + diff[2] ** 2)
        for c in range(3):
            diff[c] *= strength
            out[lo : lo + CHUNK, c] = np.clip(diff[c], -4.0, 4.0, out=diff[c]).sum(1)
    return out


def mean_push(block: Block, epoch: int, first: int, last: int, push: Callable) -> np.ndarray:
    """Mean push of each point's pool: hash groups of the block if there is no other, else a part of the round's pool."""
    if block.alone:
        out = np.zeros(block.at.shape)
        order = np.argsort(mixed(block.o, epoch))
        for rows in np.array_split(order, max(1, -(-len(order) // POOL_ROWS))):
            out[rows] = push_of_pool(block.at[rows], block.at[rows], push) / max(len(rows) - 1, 1)
        return out
    part = np.flatnonzero(mixed(block.pool, epoch) % np.uint64(last - first) == np.uint64(epoch - first))
    part = part if len(part) > 1 else np.arange(len(block.pool))
    names, places = block.pool[part], block.pooled[part]
    total, others = push_of_pool(block.at, places, push), np.full(len(block.o), float(len(part)))
    mine = np.flatnonzero((names >= block.o[0]) & (names <= block.o[-1]))  # a point is no neighbour of itself
    rows = names[mine] - block.o[0]
    diff = block.at[rows] - places[mine]
    total[rows] -= np.clip(push((diff * diff).sum(1))[:, None] * diff, -4.0, 4.0)
    others[rows] -= 1
    return total / np.maximum(others, 1.0)[:, None]


def all_pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed ``difference / (1 + d^2)^2`` and ``1 / (1 + d^2)`` from all other points of a block; a pair of tiles serves both its sides."""
    at = at - at.mean(0)
    one = np.ones((len(at), 1))
    norm = (at * at).sum(1)[:, None]
    left, right = np.concatenate([-2.0 * at, norm + 1.0, one], axis=1), np.concatenate([at, one, norm], axis=1)  # their product is 1 + d^2
    mass, near, sums = np.concatenate([one, at], axis=1), np.full(len(at), -1.0), np.zeros((len(at), 4))
    for lo in range(0, len(at), TILE):
        rows = slice(lo, lo + TILE)
        for start in range(lo, len(at), TILE):
            cols = slice(start, start + TILE)
            q = left[rows] @ right[cols].T
            np.divide(1.0, np.maximum(q, 1.0, out=q), out=q)
            near[rows] += q.sum(1)
            if start > lo:
                near[cols] += q.sum(0)
            q *= q
            sums[rows] += q @ mass[cols]
            if start > lo:
                sums[cols] += q.T @ mass[rows]
    return at * sums[:, :1] - sums[:, 1:], near


def far_sums(block: Block, tree: Pyramid, low: np.ndarray, push: Callable, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from all other points, those of other cells as cells; ``home``: where the block's points were when cells were summed."""
    return tree.forces(block.at, tree.leaf_of(home, low), push, home=home)
