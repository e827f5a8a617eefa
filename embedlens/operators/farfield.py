"""Repulsion of all points by all others from a tree of cell sums, with an opening angle.

Points are counted and summed by the cells of a grid over their box, as fine as leaves at most ``CELLS`` occupied cells; partial sums
are made before the shuffle. The cells and their parents up to the box itself form a pyramid of (count, centre), small enough for every
task. A group of near points takes a cell as one body if the cell's side is less than ``ANGLE`` times its distance, else the cell's children.
Cells of the finest grid are never opened: with few points they hold one each, with many they are small beside the reach of the
force (forces must be smooth at zero).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CELLS = 65_536
DEEPEST = 14
ANGLE = 0.5
CHUNK = 2048  # points of one step
GROUP = 128  # points that open cells together


def _box(coords: DataFrame) -> tuple[np.ndarray, float]:
    row = coords.agg(*[f(a).alias(f"{a}{i}") for a in AXES for i, f in enumerate((F.min, F.max))]).first()
    low = np.array([row[f"{a}0"] or 0.0 for a in AXES])
    return low, max(max((row[f"{a}1"] or 0.0) - lo for a, lo in zip(AXES, low)), 1e-12) * (1 + 1e-9)


class Pyramid:
    """Levels of cells from the finest grid to the whole box; ``levels[d]``: first child, count and sums of each cell of depth d."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, sums: np.ndarray, side: float, depth: int):
        self.side, self.depth = side, depth
        mask = (1 << DEEPEST) - 1
        place = np.stack([keys >> (2 * DEEPEST), (keys >> DEEPEST) & mask, keys & mask], axis=1)
        self.count, self.sums, self.children = [None] * (depth + 1), [None] * (depth + 1), [None] * depth
        # in the order of interleaved bits the children of a cell stand together
        order = np.argsort(self._interleaved(place), kind="stable")
        code, self.count[depth], self.sums[depth] = self._interleaved(place)[order], n[order].astype(float), sums[order]
        self.codes = code
        for d in range(depth - 1, -1, -1):
            parent = code >> 3
            first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            self.children[d] = np.append(first, len(code))
            self.count[d] = np.add.reduceat(self.count[d + 1], first)
            self.sums[d] = np.add.reduceat(self.sums[d + 1], first)
            code = parent[first]

    @staticmethod
    def _interleaved(place: np.ndarray) -> np.ndarray:
        code = np.zeros(len(place), np.int64)
        for bit in range(DEEPEST):
            for i in range(3):
                code |= ((place[:, i] >> bit) & 1) << (3 * bit + i)
        return code

    def leaf_of(self, p: np.ndarray, low: np.ndarray) -> np.ndarray:
        cells = 1 << self.depth
        place = np.clip(np.floor((p - low) / self.side * cells).astype(np.int64), 0, cells - 1)
        return np.searchsorted(self.codes, self._interleaved(place))

    def forces(self, p: np.ndarray, leaf: np.ndarray, push: Callable, angle: float = ANGLE, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Summed ``push(d^2) * difference`` and 1 / (1 + d^2) of all other points, for each of ``p``; ``leaf`` and ``home``: where they were summed.

        Points that stand together in the order of cells form groups of ``GROUP``, which open cells together by the nearest side of their box."""
        total, near, home = np.zeros(p.shape), np.zeros(len(p)), p if home is None else home
        if not len(p):
            return total, near
        order = np.argsort(leaf, kind="stable")
        q, starts = p[order], np.arange(0, len(p), GROUP)
        low, high = np.minimum.reduceat(q, starts, axis=0), np.maximum.reduceat(q, starts, axis=0)
        of, taken = [], []
        group, cell, before = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
        centres = [s / n[:, None] for s, n in zip(self.sums, self.count)]
        for d in range(self.depth + 1):
            at = centres[d][cell]
            gap = np.maximum(np.maximum(low[group] - at, at - high[group]), 0.0)
            take = np.ones(len(group), bool) if d == self.depth else (self.side / (1 << d)) ** 2 < angle**2 * (gap * gap).sum(1)
            of.append(group[take])
            taken.append(cell[take] + before)
            before += len(self.count[d])
            if d == self.depth:
                break
            group, cell = group[~take], cell[~take]
            first, stop = self.children[d][cell], self.children[d][cell + 1]
            size = stop - first
            group = np.repeat(group, size)
            cell = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        of, taken = np.concatenate(of), np.concatenate(taken)
        by = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(starts)))
        bodies, weights = np.concatenate(centres), np.concatenate(self.count)
        for i, start in enumerate(starts):
            own = taken[by[ends[i - 1] if i else 0 : ends[i]]]
            here = q[start : start + GROUP]
            middle = here.mean(0)
            here, body, n = here - middle, bodies[own] - middle, weights[own]
            sq = here @ (-2.0 * body.T)
            sq += (body * body).sum(1)[None, :]
            sq += (here * here).sum(1)[:, None]
            np.maximum(sq, 0.0, out=sq)
            s = push(sq) @ np.concatenate([n[:, None], n[:, None] * body], axis=1)
            rows = order[start : start + GROUP]
            total[rows] = here * s[:, :1] - s[:, 1:]
            sq += 1.0
            near[rows] = np.divide(1.0, sq, out=sq) @ n
        # a point is no neighbour of itself: its finest cell, never taken as part of a larger one, counts without it
        n, sums = self.count[-1][leaf], self.sums[-1][leaf]
        for sign, m, at in ((-1.0, n, sums / n[:, None]), (1.0, n - 1, (sums - home) / np.maximum(n - 1, 1)[:, None])):
            diff = p - at
            sq = (diff * diff).sum(1)
            total += (sign * m * push(sq))[:, None] * diff
            near += sign * m / (1.0 + sq)
        return total, near


def _places(batch: pa.RecordBatch, low: np.ndarray, side: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of a batch and their three grid coordinates."""
    p = np.stack([batch[a].to_numpy() for a in AXES], axis=1)
    return p, np.clip(np.floor((p - low) / side * (1 << depth)).astype(np.int64), 0, (1 << depth) - 1)


def pyramid(coords: DataFrame, cells: int = CELLS) -> tuple[Pyramid, np.ndarray]:
    low, side = _box(coords)
    points = coords.select(*AXES)

    def finest(batches):
        for batch in batches:
            if batch.num_rows:
                code = Pyramid._interleaved(_places(batch, low, side, DEEPEST)[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(code))], ["code"])

    by_depth = points.mapInArrow(finest, "code bigint").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(DEEPEST))))
    code = F.expr(f"shiftright(code, 3 * ({DEEPEST} - d))")
    seen = {r.d: r.n for r in by_depth.groupBy("d").agg(F.approx_count_distinct(code, 0.02).alias("n")).collect()}
    depth = max([d for d, n in seen.items() if n <= cells], default=1)
    while depth < DEEPEST and depth > 1 and seen[depth] == seen[depth - 1]:
        depth -= 1  # finer cells would part nothing more

    def summed(batches):
        for batch in batches:
            if batch.num_rows:
                p, place = _places(batch, low, side, depth)
                key, of, n = np.unique((place[:, 0] << (2 * DEEPEST)) + (place[:, 1] << DEEPEST) + place[:, 2], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), *(pa.array(np.bincount(of, p[:, i], len(n))) for i in range(3))], ["key", "n", *AXES])

    parts = points.mapInArrow(summed, "key bigint, n bigint, x double, y double, z double")
    sums = parts.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(a).alias(a) for a in AXES]).toArrow()
    at = np.stack([sums[a].to_numpy() for a in AXES], axis=1) if len(sums) else np.zeros((0, 3))
    return Pyramid(sums["key"].to_numpy(), sums["n"].to_numpy(), at, side, depth), low


def repulsion(coords: DataFrame, push: Callable, n: int, angle: float = ANGLE, cells: int = CELLS) -> DataFrame:
    """Adds ``px, py, pz`` (mean push of the other points) and ``q`` (mean of 1 / (1 + d^2)) to each of ``n`` points."""
    names = coords.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in coords.dtypes) + ", px double, py double, pz double, q double"
    if n < 2:
        return coords.select("*", *[F.lit(0.0).alias(c) for c in ("px", "py", "pz", "q")])
    tree, low = pyramid(coords, cells)

    def work(batches):
        for batch in batches:
            p = np.stack([batch[a].to_numpy() for a in AXES], axis=1) if batch.num_rows else np.zeros((0, 3))
            parts = [np.zeros((0, 4))]
            for lo in range(0, len(p), CHUNK):
                own = p[lo : lo + CHUNK]
                total, near = tree.forces(own, tree.leaf_of(own, low), push, angle)
                parts.append(np.concatenate([total, near[:, None]], axis=1) / (n - 1))
            out = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, i]) for i in range(4))], [*names, "px", "py", "pz", "q"])

    return coords.mapInArrow(work, schema)
