"""Points in 3-D: pairs and rows within a radius, minimum spacing, normalised coordinates.

Points are rows ``id, x, y, z``.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.operators.ordering import value_at_ranks, with_ordinal
from embedlens.operators.pairs import block_tasks, ids_of, result_schema, sides_of, to_cells, best_k, matrix, plan
from embedlens.session import cut

MAX_PAIRS = 500  # fixed value: default number of pairs
SPACING_SHARE = 0.02  # fixed value: minimum spacing as a share of the sampled median distance
SPACING_PASSES = 4  # fixed value
SLICE_ROWS = 256  # rows of two blocks compared at a time
AXES = ("x", "y", "z")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in AXES), F.lit(0.0)))


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / F.lit(side)).cast("bigint")


def within(points: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """``(id, x, y, z, distance)`` of points within the radius, nearest first. The box around the
    sphere is a plain range filter, which reaches the scan."""
    box = F.lit(True)
    square = F.lit(0.0)
    for c, at in zip(AXES, center):
        box = box & F.col(c).between(at - radius, at + radius)
        square = square + (F.col(c) - at) * (F.col(c) - at)
    return points.where(box & (square <= radius * radius)).withColumn("distance", F.sqrt(square)).orderBy("distance", "id")


def _grid_pairs(points: DataFrame, radius: float) -> DataFrame:
    """All pairs within the radius: cells of that side, each row meets the 27 cells around it."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = points.select(F.struct("id", *AXES).alias("a"), *[_cell(c, radius).alias(f"c{c}") for c in AXES])
    right = points.select(F.struct("id", *AXES).alias("b"), *[_cell(c, radius).alias(f"c{c}") for c in AXES])
    for c in AXES:
        right = right.withColumn("s", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
    met = left.join(right, [f"c{c}" for c in AXES]).where("a.id < b.id").withColumn("distance", _distance("a", "b"))
    return met.where(F.col("distance") <= radius).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance")


def closest_pairs(points: DataFrame, radius: float, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The ``max_pairs`` closest pairs within the radius, ``(id1, id2, distance)``, nearest first.

    At one location only the max_pairs + 1 smallest ids can occur in the answer. Where many points
    crowd a cell, a smaller radius already holds enough pairs: the radius is halved until cells are
    thin, and doubled again only while it yields too few pairs, when points are too far apart to
    crowd the larger cells. The answer is that of the full radius.
    """
    spots = best_k(points.select("id", *AXES, F.struct(*AXES).alias("spot")), max_pairs + 1, "spot", ("id",))
    spots = cut(spots.select("id", *AXES))
    n = spots.count()
    budget = 64 * n + 1_000_000
    r = radius
    while _crowding(spots, r) > budget and r > radius * 2.0**-40:
        r /= 2
    while True:
        found = cut(_grid_pairs(spots, r))
        if r >= radius or len(found.limit(max_pairs).collect()) >= max_pairs:
            break
        r = min(radius, r * 2)
    return found.orderBy("distance", "id1", "id2").limit(max_pairs)


def _crowding(points: DataFrame, side: float) -> int:
    per_cell = points.groupBy(*[_cell(c, side).alias(f"c{c}") for c in AXES]).agg(F.count(F.lit(1)).alias("n"))
    return per_cell.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("s")).first().s


def minimum_spacing(points: DataFrame, cell_rows: int | None = None, block_rows: int = 512) -> DataFrame:
    """Push apart points closer than 2 % of the typical distance, in four passes.

    All pushes of a pass are computed from the same positions and summed per point; a block pair
    emits one push per point, not its pairs.
    """
    n = points.count()
    if n < 2:
        return points
    spacing = SPACING_SHARE * _median_distance(points, n)
    if spacing < 1e-10:
        return points
    now = points
    for _ in range(SPACING_PASSES):
        now = cut(_spread(now, n, spacing, cell_rows, block_rows))
    return now


def _median_distance(points: DataFrame, n: int) -> float:
    """Median distance among evenly strided rows (about fifty to a hundred)."""
    step = max(1, n // 50) if n > 100 else 1
    rows = with_ordinal(points, "id").where(F.col("ordinal") % step == 0).select(*AXES).collect()
    p = np.array([tuple(r) for r in rows])
    i, j = np.triu_indices(len(p), 1)
    d = np.sort(np.sqrt(((p[i] - p[j]) ** 2).sum(1)))
    return float(d[len(d) // 2]) if len(d) else 0.0


def _spread(points: DataFrame, n: int, spacing: float, cell_rows, block_rows) -> DataFrame:
    rows = points.select("id", F.array(*AXES).alias("vector"))
    p = replace(plan(rows, n, 3, cell_rows, block_rows), most_rows=4096)  # a task holds all pushes of two blocks
    kind = rows.schema["id"].dataType.simpleString()
    fields = result_schema(rows, ["id"], [(f"d{c}", pa.float64()) for c in AXES])

    def kernel(key, table):
        left, right, same = sides_of(key, table)
        a, b = matrix(left["vector"]), matrix(right["vector"])
        if not len(a) or not len(b):
            return
        moved, met = [np.zeros(x.shape) for x in (a, b)], [np.zeros(len(x), bool) for x in (a, b)]
        for lo in range(0, len(a), SLICE_ROWS):  # all differences of two blocks would take a gigabyte
            rows = slice(lo, lo + SLICE_ROWS)
            diff = b[None, :, :] - a[rows, None, :]
            dist = np.sqrt((diff**2).sum(2))
            close = (dist < spacing) & (dist > 1e-10)
            with np.errstate(divide="ignore", invalid="ignore"):
                push = np.where(close, (spacing - dist) * 0.5 / dist, 0.0)[:, :, None] * diff
            moved[0][rows], met[0][rows] = -push.sum(1), close.any(1)
            moved[1] += push.sum(0)
            met[1] |= close.any(0)
        out = [(ids_of(left["id"]), moved[0], met[0])]
        if not same:
            out.append((ids_of(right["id"]), moved[1], met[1]))
        ids = np.concatenate([i[m] for i, _, m in out])
        move = np.concatenate([d[m] for _, d, m in out])
        yield pa.table([pa.array(ids), *[pa.array(move[:, c]) for c in range(3)]], names=fields.names).cast(fields)

    moves = block_tasks(to_cells(rows, p, spacing), p, kernel, f"id {kind}, dx double, dy double, dz double", p.tree is not None)
    total = moves.groupBy("id").agg(*[F.sum(f"d{c}").alias(f"d{c}") for c in AXES])
    return points.join(total, "id", "left").select("id", *[(F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in AXES])


def normalise(points: DataFrame) -> DataFrame:
    """Map the 5th..95th percentile box to +-0.9 with one scale for all axes, clamped to +-1."""
    n = points.count()
    if not n:
        return points
    ranks = [min(int(n * 0.05), n - 1), min(int(n * 0.95), n - 1)]
    ends = {c: value_at_ranks(points, c, ranks) for c in AXES}
    scale = max(hi - lo for lo, hi in ends.values())
    if scale < 1e-10:
        return points.select("id", *[F.lit(0.0).alias(c) for c in AXES])
    return points.select(
        "id",
        *[
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(c) - (lo + hi) / 2.0) / scale * 1.8)).alias(c)
            for c, (lo, hi) in ends.items()
        ],
    )
