"""Pairs of near vectors: exact threshold pairs, exact and approximate nearest neighbours.

Rows go to cells of a tree of pivots (``cells``), which is cut finer wherever the data is dense. A row is
also sent to another cell only if the bounds on the way there allow a partner in it; the bounds are
exact, so no pair is lost, and a row meets the cells around it, not all cells of the collection.
Inside a cell rows are split into blocks and each pair of blocks is one Arrow group, so a group
never holds more than two blocks however large its cell is. All rows make about ``BLOCKS`` blocks until those
reach ``BLOCK_BYTES``: each row is copied once per block, so copies stay in step with the rows. Only results
leave a group, a tile of comparisons at a time: pairs over the threshold, a spanning forest of them, or the best k per row.

Where rows have no structure, cells leave nothing out and only copy rows. So the visits to cells are counted first, and
all blocks meet all others without cells unless those at least halve the comparisons and copy a row ``COPIES`` times at most.

Exact copies of one vector are reduced to one row before any comparison (``collapse_copies``); a
collection of which a third is one repeated vector costs no more than its distinct vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import vectors as V
from embedlens.operators import cells as C
from embedlens.operators.cells import SLACK, PivotTree, squared as _squared, unit_rows as _unit_rows
from embedlens.session import cut

BLOCK_ROWS = 256  # rows of a block at least
BLOCK_BYTES = 16 << 20  # vectors of a block at most
BLOCKS = 8  # of all rows, while they are within these bounds
COPIES = 64  # of a row in cells, on average at most
SLICE_ROWS, TILE_ROWS = 512, 2048  # rows of two blocks compared at a time
PLACED_ROWS = 1 << 16  # copies of rows made at a time
CELL_ROWS = 8192
JUDGED = 256  # rows whose exact neighbours tell whether a tree of cells is worth building
BROADCAST_BYTES = 64 << 20  # largest matrix shipped to every task
HELD_BYTES = 64 << 20  # rows that a task keeps while others stream past


# ---------------------------------------------------------------- rows as matrices


def matrix(column) -> np.ndarray:
    """A list column as a 2-d array. Lists of unequal lengths raise an error."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    widths = pc.min_max(pc.list_value_length(column)).as_py()
    if widths["min"] != widths["max"]:
        raise ValueError(f"vectors have from {widths['min']} to {widths['max']} elements; compare one width at a time")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def ids_of(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _slices(n: int, rows: int | None = None):
    rows = rows or SLICE_ROWS
    for start in range(0, n, rows):
        yield start, min(n, start + rows)


def _nearest(a, b, b_ids, k, bound=None):
    """Row, column and distance of the k nearest of ``b`` for each row of ``a``, ties by id.

    A fast squared distance picks candidates of a tile with some slack; their distances are then computed
    directly and sorted, so near-equal vectors do not suffer from cancellation. What a row has found bounds the next tile.
    Single precision picks them where its rounding lets few others through, else double precision.
    """
    rows, cols, dists = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    single = _Single(a, b) if len(a) and len(b) else None
    for lo, hi in _slices(len(a) if len(b) else 0):
        limit = None if bound is None else bound[lo:hi]
        found = single.pick(lo, hi, k, limit) if single.fits else None
        if found is None:
            row, col, dist = _nearest_double(a[lo:hi], b, b_ids, k, limit)
        else:
            row, col = found
            dist = _exact(a[lo:hi], b, row, col)
            row, col, dist = _first_k(row, b_ids[col], dist, k, col)
        rows.append(row + lo)
        cols.append(col)
        dists.append(dist)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _exact(a, b, row, col):
    """Distances of pairs, a portion at a time."""
    step = max(1, BLOCK_BYTES // (8 * b.shape[1]))
    far = [np.sqrt(((a[row[first:last]] - b[col[first:last]]) ** 2).sum(1)) for first, last in _slices(len(row), step)]
    return np.concatenate([np.empty(0), *far])


class _Single:
    """Candidates for the nearest rows in single precision, with a slack no smaller than its rounding errors."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        centre = b.mean(0)  # distances stay, rounding errors shrink with the norms
        a, b = a - centre, b - centre
        own, norm = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        scale = max(own.max(), norm.max())
        self.fits = bool(np.isfinite(scale) and scale > 1e-100)
        if not self.fits:
            return
        self.scale, self.own, self.most = scale, own / scale, norm.max() / scale
        half = 0.5 * (norm / scale) ** 2
        # the dot product with (-a, 1) is (d^2 - |a|^2) / 2
        self.left = np.concatenate([-a / scale, np.ones((len(a), 1))], axis=1, dtype=np.float32, casting="same_kind")
        self.right = np.concatenate([b / scale, half[:, None]], axis=1, dtype=np.float32, casting="same_kind")

    def pick(self, lo: int, hi: int, k: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Row and column of all that may be among the k nearest; None if the slack lets far more than k of a row through."""
        n, own = hi - lo, self.own[lo:hi]
        slack = 2.0**-22 * (self.left.shape[1] + 8) * (own + self.most) ** 2
        limit = np.full(n, np.inf) if bound is None else 0.5 * ((bound / self.scale) ** 2 - own**2)
        kept = np.full((n, k), np.inf, np.float32)  # the smallest values so far
        row, col, fast = [], [], []
        for start, end in _slices(len(self.right), TILE_ROWS):
            tile = self.left[lo:hi] @ self.right[start:end].T
            open_ = np.flatnonzero(np.isinf(limit))
            edge = limit + slack
            if len(open_):
                kth = min(k, end - start) - 1
                edge[open_] = np.partition(tile[open_], kth, axis=1)[:, kth] + slack[open_]
            at = np.flatnonzero(tile <= np.nextafter(edge.astype(np.float32), np.float32(np.inf))[:, None])
            if not len(at):
                continue
            i, j, value = at // (end - start), at % (end - start), tile.reshape(-1)[at]
            held = np.bincount(i, minlength=n)
            if len(at) > n * (4 * k + 64):
                return None
            padded = np.full((n, held.max()), np.inf, np.float32)
            padded[i, np.arange(len(i)) - np.repeat(held.cumsum() - held, held)] = value
            kept = np.partition(np.concatenate([kept, padded], axis=1), k - 1, axis=1)[:, :k]
            limit = np.minimum(limit, kept[:, k - 1] + slack)
            row.append(i)
            col.append(j + start)
            fast.append(value)
        row, col, fast = (np.concatenate([np.empty(0, t), *x]) for x, t in ((row, int), (col, int), (fast, np.float32)))
        keep = fast <= (limit + 2 * slack)[row]
        return row[keep], col[keep]


def _nearest_double(part, b, b_ids, k, bound=None):
    """The same for one slice of rows by candidates in double precision, which are sorted after every tile."""
    norm = (b * b).sum(1)
    own = (part * part).sum(1)
    right = np.concatenate([b, 0.5 * norm[:, None]], axis=1)  # the dot product with (-a, 1) is (d^2 - |a|^2) / 2
    left = np.concatenate([-part, np.ones((len(part), 1))], axis=1)
    tol = 1e-12 * (1.0 + own + norm.max())
    limit = np.full(len(part), np.inf) if bound is None else bound**2
    row, col, dist = np.empty(0, int), np.empty(0, int), np.empty(0)
    for start, end in _slices(len(b), TILE_ROWS):
        fast = left @ right[start:end].T
        edge = 0.5 * (limit - own)
        open_ = np.flatnonzero(np.isinf(limit))
        if len(open_):
            kth = min(k, end - start) - 1
            edge[open_] = np.partition(fast[open_], kth, axis=1)[:, kth]
        i, j = np.nonzero(fast <= (edge + tol)[:, None])
        if not len(i):
            continue
        j = j + start
        row, col, dist = np.concatenate([row, i]), np.concatenate([col, j]), np.concatenate([dist, _exact(part, b, i, j)])
        row, col, dist = _first_k(row, b_ids[col], dist, k, col)
        held = np.bincount(row, minlength=len(part))
        full = np.flatnonzero(held >= k)
        limit[full] = np.minimum(limit[full], dist[held.cumsum()[full] - 1] ** 2)
    return row, col, dist


def _first_k(row, ids, dist, k, carried):
    """The k entries of smallest distance, then id, of each row."""
    order = np.lexsort((ids, dist, row))
    row, dist, carried = row[order], dist[order], carried[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], carried[keep], dist[keep]


# ---------------------------------------------------------------- copies


def same_value(rows: DataFrame, value: Column) -> DataFrame:
    """``(id, rep, copies)`` of rows whose value occurs more than once; rep = smallest id.

    Values are compared by a 128-bit fingerprint, written once next to the ids, so neither vectors
    nor texts are shuffled and they are read a single time. Groups are counted before the shuffle;
    a group of a third of all rows is one row per task there, and a skewed side of the join after it.
    """
    keyed = cut(rows.select("id", F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")))
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return keyed.join(groups, ["h1", "h2"]).select("id", "rep", "copies")


def copy_members(vectors: DataFrame) -> DataFrame:
    """Groups of exact copies of one vector, as in ``same_value``. A hash of a list skips nulls, so their places are hashed too."""
    return same_value(vectors, F.struct(F.col("vector"), F.transform("vector", lambda x: x.isNull())))


def collapse_copies(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct vector: the smallest id stands for its copies."""
    return vectors.join(members.where("id <> rep").select("id"), "id", "left_anti")


# ---------------------------------------------------------------- cells and block tasks


@dataclass(frozen=True)
class Plan:
    """How one width of vectors is cut up."""

    n: int
    dims: int
    block_rows: int  # of a block at least
    tree: PivotTree | None = None
    unit: bool = False  # cells are cut by direction: rows are scaled to length one to find theirs
    most_rows: int | None = None  # of a block, where a kernel compares whole blocks

    def blocks(self, rows: int) -> int:
        """Blocks of a cell with so many rows."""
        most = self.most_rows or max(BLOCK_ROWS, min(1 << 15, BLOCK_BYTES // (8 * max(1, self.dims))))
        return -(-rows // max(self.block_rows, min(most, -(-self.n // BLOCKS))))

    def whole(self) -> Plan:
        """Without cells."""
        return self if self.tree is None else replace(self, tree=None, block_rows=BLOCK_ROWS)


def by_width(vectors: DataFrame, run: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """Apply ``run(rows, n, dims)`` to each vector width: vectors of unequal width never pair."""
    found = vectors.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).where("w > 0").collect()
    parts = [run(vectors.where(F.size("vector") == r.w), r.n, r.w) for r in sorted(found, key=lambda r: r.w)]
    return reduce(DataFrame.unionByName, parts) if parts else run(vectors.limit(0), 0, 1)


def plan(
    vectors: DataFrame, n: int, dims: int, cell_rows: int | None = None, block_rows: int | None = None, unit: bool = False
) -> Plan:
    return Plan(n, dims, block_rows or BLOCK_ROWS, C.build(vectors.select("id", "vector"), n, dims, cell_rows or CELL_ROWS, unit), unit)


def _cell_schema(vectors: DataFrame) -> str:
    held = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    return f"{held}, cell int, guest boolean"


def _placed(batch: pa.RecordBatch, rows: np.ndarray, cells: np.ndarray, guest: np.ndarray) -> pa.RecordBatch:
    """The chosen rows of a batch with their cells."""
    pick = pa.array(rows)
    columns = [c.take(pick) for c in batch.columns] + [pa.array(cells.astype("int32")), pa.array(guest)]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "guest"])


def _portions(vectors: DataFrame, place, emit, schema: str) -> DataFrame:
    """``emit(batch, rows, cells, guest)`` for portions of rows, where ``place(batch)`` gives rows, cells and whether they are guests there.

    A row may visit very many cells: portions are as large as the visits of the one before allow."""

    def run(batches):
        size = 64
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, size)
                start += part.num_rows
                rows, cells, guest = place(part)
                yield from emit(part, rows, cells, guest)
                size = int(max(1, min(4096, PLACED_ROWS * part.num_rows // max(1, len(rows)))))

    return vectors.mapInArrow(run, schema)


def placed(vectors: DataFrame, place) -> DataFrame:
    """``vectors`` with ``cell`` and ``guest``, a row per cell that it is in."""

    def emit(batch, rows, cells, guest):
        step = max(1, min(PLACED_ROWS, BLOCK_BYTES // max(1, batch.nbytes // batch.num_rows)))
        for lo, hi in _slices(len(rows), step):
            yield _placed(batch, rows[lo:hi], cells[lo:hi], guest[lo:hi])

    return _portions(vectors, place, emit, _cell_schema(vectors))


def visits(vectors: DataFrame, place) -> list[tuple[int, int, int]]:
    """``(cell, home, guests)`` of ``placed``, counted without copying a row; one per cell, and the tree they come from is bounded."""

    def emit(batch, rows, cells, guest):
        names, at = np.unique(cells, return_inverse=True)
        n, g = np.bincount(at, minlength=len(names)), np.bincount(at[guest], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names.astype("int32")), pa.array(n - g), pa.array(g)], ["cell", "home", "guests"])

    parts = _portions(vectors.select(*[c for c in vectors.columns if c in ("id", "vector", "bound")]), place, emit, "cell int, home long, guests long")
    found = parts.groupBy("cell").agg(F.sum("home").alias("home"), F.sum("guests").alias("guests")).collect()
    return [(r.cell, r.home, r.guests) for r in found]


def pays(p: Plan, sizes: list[tuple[int, int, int]], among_home: bool = True) -> bool:
    """Whether cells with so many rows at home and guests at least halve the comparisons of all with all, with few copies."""
    home, guests = (np.array([s[i] for s in sizes], dtype=float) for i in (1, 2))
    compared = (home * guests).sum() + among_home * 0.5 * (home * home).sum()
    h, g = (np.array([p.blocks(int(x)) for x in part], dtype=float) for part in (home, guests))
    copies = (home * (g + among_home * h)).sum() + (guests * h).sum()
    return bool(compared <= 0.25 * p.n * p.n and copies <= COPIES * p.n)


def _reached(p: Plan, radius: float):
    """Home of every row, and the lower cells where a partner within ``radius`` may live."""
    tree, unit = p.tree, p.unit

    def place(batch):
        x = matrix(batch["vector"])
        x = _unit_rows(x) if unit else x
        home, _ = tree.home(x)
        r, c = tree.reach(x, np.full(len(x), radius))
        away = c < home[r]
        rows, cells = np.concatenate([np.arange(len(x)), r[away]]), np.concatenate([home, c[away]])
        return rows, cells, np.arange(len(rows)) >= len(x)

    return place


def to_cells(vectors: DataFrame, p: Plan, radius: float | None = None) -> DataFrame:
    """Home row of every vector, and guest rows in lower cells where a partner within ``radius`` may live."""
    if p.tree is None:
        return vectors.select("*", F.lit(0).alias("cell"), F.lit(False).alias("guest"))
    tree, unit = p.tree, p.unit
    if radius is not None:
        return placed(vectors, _reached(p, radius))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["vector"])
                home, _ = tree.home(_unit_rows(x) if unit else x)
                yield _placed(batch, np.arange(len(x)), home, np.zeros(len(x), bool))

    return vectors.mapInArrow(assign, _cell_schema(vectors))


def block_tasks(
    rows: DataFrame, p: Plan, kernel, schema: str, guests: bool, among_home: bool = True, sizes: list[tuple[int, int, int]] | None = None
) -> DataFrame:
    """Run ``kernel`` once per pair of blocks: home blocks with each other, guests with home blocks. It yields tables."""
    spark = rows.sparkSession
    if p.tree is None and not guests:
        sizes = [(0, p.n, 0)]
    elif sizes is None:
        sizes = [
            (r.cell, r.home, r.guests)
            for r in rows.groupBy("cell").agg(
                F.count_if(~F.col("guest")).alias("home"), F.count_if("guest").alias("guests")
            ).collect()
        ]  # one row per cell; the tree they come from is bounded
    blocks = [(c, max(1, p.blocks(h)), p.blocks(g)) for c, h, g in sizes]
    tasks = sum(among_home * h * (h + 1) // 2 + h * g for _, h, g in blocks)
    if p.tree is None and not guests:
        sized = rows.withColumn("home", F.lit(blocks[0][1])).withColumn("guests", F.lit(0))
    else:
        table = F.broadcast(spark.createDataFrame(blocks, "cell int, home int, guests int"))
        sized = rows.join(table, "cell")
    others = lambda n: F.sequence(F.lit(0), n - 1)
    b = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("home"))).cast("int")

    def task(kind, left, right, side):
        return F.struct(
            F.lit(kind).alias("kind"), left.cast("int").alias("p"), right.cast("int").alias("q"), F.lit(side).alias("side")
        )

    at = F.col("b")
    own = F.transform(
        others(F.col("home")),
        lambda j: F.when(at <= j, task(0, at, j, 0)).otherwise(task(0, j, at, 1)),
    )
    if guests:
        met = F.when(F.col("guests") > 0, F.transform(others(F.col("guests")), lambda j: task(1, at, j, 0)))
        met = F.coalesce(met, F.array().cast(_TASK))
        as_home = F.concat(own, met) if among_home else met
        as_guest = F.transform(others(F.col("home")), lambda j: task(1, j, at, 1))
        duties = F.when(F.col("guest"), as_guest).otherwise(as_home)
    else:
        duties = own
    spread = (
        sized.withColumn("b", b)
        .withColumn("t", F.explode(duties))
        .drop("home", "guests", "b", "guest")
        .select("*", "t.*")
        .drop("t")
    )
    width = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["cell", "kind", "p", "q"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in kernel(key, pa.Table.from_batches(list(batches))):
            yield from found.to_batches()

    return spread.repartition(max(1, min(tasks, width)), *keys).groupBy(*keys).applyInArrow(run, schema)


_TASK = "array<struct<kind:int,p:int,q:int,side:int>>"


def sides_of(key, table):
    """Left rows, right rows and whether both are the same block."""
    same = key[1].as_py() == 0 and key[2].as_py() == key[3].as_py()
    side = table["side"].to_numpy()
    if same:
        return table, table, True
    return table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)), False


# ---------------------------------------------------------------- threshold pairs


def matches(key, table, threshold):
    """Matching pairs of a block task, a slice of left rows at a time: ids of both sides once, then
    ``(i, j, similarity)`` of the matches."""
    left, right, same = sides_of(key, table)
    a, b = matrix(left["vector"]), matrix(right["vector"])

    def found():
        if not len(a) or not len(b):
            return
        ua, ub = _unit_rows(a), _unit_rows(b)
        na, nb = (a * a).sum(1), (b * b).sum(1)
        for lo, hi in _slices(len(a)):
            for start, end in _slices(len(b), TILE_ROWS):
                if same and end <= lo + 1:
                    continue
                hit = ua[lo:hi] @ ub[start:end].T >= threshold - 1e-9
                if same:
                    hit &= np.arange(start, end)[None, :] > np.arange(lo, hi)[:, None]
                i, j = np.nonzero(hit)
                i, j = i + lo, j + start
                for first, last in _slices(len(i), max(1, BLOCK_BYTES // (8 * a.shape[1]))):  # all of a tile may match
                    one, two = i[first:last], j[first:last]
                    scale = np.sqrt(na[one] * nb[two])
                    sim = np.divide(np.einsum("ij,ij->i", a[one], b[two]), scale, out=np.zeros(len(one)), where=scale > 0)
                    keep = sim >= threshold
                    if keep.any():
                        yield one[keep], two[keep], sim[keep]

    return left, right, same, found()


def similar(
    vectors: DataFrame, threshold: float, kernel, schema: str, cell_rows: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """Run ``kernel`` over block tasks that together hold every pair at or above the threshold once."""
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))

    def run(rows, n, dims):
        # the cell bound holds for unit vectors; zero vectors have similarity 0 and pair only at threshold <= 0
        p = plan(rows, n, dims, cell_rows, block_rows, unit=True)
        if p.tree is not None and threshold > 0 and _worth_cells(p.tree, radius):
            sizes = visits(rows, _reached(p, radius))
            if pays(p, sizes):
                return block_tasks(to_cells(rows, p, radius), p, kernel, schema, True, sizes=sizes)
        return block_tasks(to_cells(rows, p.whole()), p.whole(), kernel, schema, False)

    return by_width(vectors, run)


def _worth_cells(tree: PivotTree, radius: float, group: np.ndarray | None = None) -> bool:
    """Judge by leaves' pivots, a sample of the data, whether the radius prunes most cells
    (cells of one ``group`` need no comparison)."""
    pivots = tree.pivots
    some = np.arange(0, len(pivots), max(1, len(pivots) // max(64, min(1024, (1 << 22) // len(pivots)))))
    sq = _squared(pivots[some], pivots)
    rows = np.arange(len(some))
    sq[rows, some] = np.inf  # a pivot stands for any row near it: its home is the next one
    home = sq.argmin(1)
    gap = np.sqrt(_squared(pivots[home], pivots))
    gap[gap == 0] = np.inf
    near = (sq - sq[rows, home][:, None]) / (2.0 * gap) <= radius
    if group is not None:
        near &= group[some][:, None] != group[None, :]
    return float(near.mean()) < 0.25


def similar_pairs(vectors: DataFrame, threshold: float, cell_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``(a, b, similarity)``, a < b, for all pairs of rows with cosine similarity >= threshold."""
    kind = vectors.schema["id"].dataType.simpleString()
    fields = result_schema(vectors, ["a", "b"], [("similarity", pa.float64())])

    def kernel(key, table):
        left, right, _, found = matches(key, table, threshold)
        ida, idb = ids_of(left["id"]), ids_of(right["id"])
        for i, j, sim in found:
            a, b = ida[i], idb[j]
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.table([pa.array(a), pa.array(b), pa.array(sim)], names=fields.names).cast(fields)

    return similar(vectors, threshold, kernel, f"a {kind}, b {kind}, similarity double", cell_rows, block_rows)


def similar_links(vectors: DataFrame, threshold: float, cell_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``(a, b)`` links with the same connected components as ``similar_pairs``.

    Each pair of blocks emits a spanning forest of its matches, so a dense group of m rows yields
    about m links per block pair and never its m*m/2 pairs. With cells, rows similar to their own
    pivot are linked to it at once and compared only with rows that link may not reach.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    fields = result_schema(vectors, ["a", "b"], [])
    schema = f"a {kind}, b {kind}"

    def kernel(key, table):
        left, right, same, found = matches(key, table, threshold)
        ida = ids_of(left["id"])
        pool = ida if same else np.concatenate([ida, ids_of(right["id"])])
        root, member = _forest(((i, j if same else j + len(ida)) for i, j, _ in found), len(pool))
        yield pa.table([pa.array(pool[root]), pa.array(pool[member])], names=fields.names).cast(fields)

    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))

    def run(rows, n, dims):
        p = plan(rows, n, dims, cell_rows, block_rows, unit=True) if threshold > 0 else Plan(n, dims, block_rows or BLOCK_ROWS)
        if p.tree is None:
            return block_tasks(to_cells(rows, p), p, kernel, schema, False)
        pivots = p.tree.pivots
        step = max(1, (1 << 22) // len(pivots))

        def linked():
            for lo in range(0, len(pivots), step):
                i, j = np.nonzero(pivots[lo : lo + step] @ pivots.T >= threshold)
                yield i[i + lo < j] + lo, j[i + lo < j]

        root, member = _forest(linked(), len(pivots))
        group = np.arange(len(pivots))
        group[member] = root
        if not _worth_cells(p.tree, radius, group):
            return block_tasks(to_cells(rows, p.whole()), p.whole(), kernel, schema, False)
        return _links_by_cells(rows, p, threshold, radius, group, kernel, schema)

    return by_width(vectors, run)


def _links_by_cells(rows: DataFrame, p: Plan, threshold: float, radius: float, group: np.ndarray, kernel, schema: str) -> DataFrame:
    """Links through pivots, which are rows themselves.

    A row similar to its home pivot is *settled*: it is linked to the pivot, and through it to all
    settled rows of the pivots linked with that one (``group``). Comparing two settled rows of one
    group cannot join anything new, so what is left to compare is every pair with an unsettled row,
    and settled rows of different groups. A group of near copies, however large, is settled whole. If that
    is still most pairs, all rows are compared without cells.
    """
    spark = rows.sparkSession
    tree, pivots = p.tree, p.tree.pivots
    kind = rows.schema["id"].dataType.simpleString()

    def locate(batch):
        x = _unit_rows(matrix(batch["vector"]))
        home, _ = tree.home(x)
        r, c = tree.reach(x, np.full(len(x), radius))
        away = c != home[r]
        settled = (x * pivots[home]).sum(1) >= threshold
        return home, settled, r[away], c[away]

    def tag(batches):
        for batch in batches:
            if batch.num_rows:
                home, settled, _, _ = locate(batch)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(home.astype("int32")), pa.array(settled)], ["id", "cell", "settled"])

    tags = cut(rows.mapInArrow(tag, f"id {kind}, cell int, settled boolean"))
    ids = tree.pivot_ids.tolist()
    pivot_of = spark.createDataFrame(list(enumerate(ids)), f"cell int, pivot {kind}")
    to_pivot = tags.where("settled").join(F.broadcast(pivot_of), "cell").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    among = [(ids[group[i]], ids[i]) for i in range(len(ids)) if group[i] != i]
    open_rows = np.zeros(len(pivots), int)
    for r in tags.where("NOT settled").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        open_rows[r.cell] = r.n

    def unsettled(batch):
        home, settled, r, c = locate(batch)
        # two unsettled rows meet in the lower cell; a settled row visits the unsettled ones
        near = (open_rows[c] > 0) & (settled[r] | (c < home[r]))
        own = np.nonzero(~settled | (open_rows[home] > 0))[0]
        r, c = r[near], c[near]
        return np.concatenate([own, r]), np.concatenate([home[own], c]), np.concatenate([settled[own], np.ones(len(r), bool)])

    def across(batch):
        home, settled, r, c = locate(batch)
        near = settled[r] & (group[home[r]] != group[c]) & (c < home[r])
        own = np.nonzero(settled)[0]
        r, c = r[near], c[near]
        return np.concatenate([own, r]), np.concatenate([home[own], c]), np.concatenate([np.zeros(len(own), bool), np.ones(len(r), bool)])

    to_meet, to_cross = visits(rows, unsettled), visits(rows, across)
    if not (pays(p, to_meet) and pays(p, to_cross, False)):
        return block_tasks(to_cells(rows, p.whole()), p.whole(), kernel, schema, False)
    met = block_tasks(placed(rows, unsettled), p, kernel, schema, True, sizes=to_meet)
    far = block_tasks(placed(rows, across), p, kernel, schema, True, among_home=False, sizes=to_cross)
    parts = [to_pivot, spark.createDataFrame(among, schema), met, far]
    return reduce(DataFrame.unionByName, parts)


def _forest(links, n: int):
    """Star links (root, member) of the components of links over 0..n-1, given in portions."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # hang the larger root under the smaller one, then flatten
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    member = np.nonzero(label != np.arange(n))[0]
    return label[member], member


def result_schema(vectors: DataFrame, id_names, extra) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema["id"].dataType)
    return pa.schema([(n, kind) for n in id_names] + extra)


# ---------------------------------------------------------------- nearest neighbours


def best_k(edges: DataFrame, k: int, src: str = "src", order: tuple = ("dist", "dst")) -> DataFrame:
    """The first k rows per source. Spark limits each group before the shuffle too."""
    w = Window.partitionBy(src).orderBy(*order)
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn_kernel(k: int, fields: pa.Schema, guests_only: bool):
    def kernel(key, table):
        left, right, same = sides_of(key, table)
        a, b, ida, idb = matrix(left["vector"]), matrix(right["vector"]), ids_of(left["id"]), ids_of(right["id"])
        bounds = [side["bound"].to_numpy() if "bound" in side.column_names else None for side in (left, right)]
        parts = []
        if same:
            parts.append((ida, idb, _nearest(a, b, idb, k + 1, bounds[0])))
        else:
            parts.append((idb, ida, _nearest(b, a, ida, k, bounds[1])))
            if not guests_only:
                parts.append((ida, idb, _nearest(a, b, idb, k, bounds[0])))
        for s, d, (row, col, dist) in parts:
            src, dst = s[row], d[col]
            keep = src != dst
            yield pa.table([pa.array(src[keep]), pa.array(dst[keep]), pa.array(dist[keep])], names=fields.names).cast(fields)

    return kernel


def _knn_distinct(rows: DataFrame, n: int, dims: int, k: int, cell_rows, block_rows, probes: int | None) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"src {kind}, dst {kind}, dist double"
    fields = result_schema(rows, ["src", "dst"], [("dist", pa.float64())])
    if probes is None and n >= 4 * (cell_rows or CELL_ROWS) and not _cells_may_pay(rows, n, dims, k):
        p = Plan(n, dims, BLOCK_ROWS)
    else:
        p = plan(rows, n, dims, cell_rows, block_rows)
    home = to_cells(rows, p)
    local = best_k(block_tasks(home, p, _knn_kernel(k, fields, False), schema, False), k)
    if p.tree is None:
        return local
    local = cut(local)  # used for the bounds and in the answer
    inf = F.lit(float("inf"))
    if probes is None:
        kth = local.groupBy("src").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound"))
        held = home.join(kth, home["id"] == kth["src"], "left").select("id", "vector", F.coalesce("bound", inf).alias("bound"))
    else:
        held = home.select("id", "vector", inf.alias("bound"))
    place = _guests(p, k, probes)
    sizes = visits(held, place)
    if probes is None and not pays(p, sizes, False):
        return best_k(block_tasks(to_cells(held, p.whole()), p.whole(), _knn_kernel(k, fields, False), schema, False), k)
    both = placed(held, place)
    away = block_tasks(both, p, _knn_kernel(k, fields, True), schema, True, among_home=False, sizes=sizes)
    return best_k(local.drop("rank").unionByName(away), k)


def _cells_may_pay(rows: DataFrame, n: int, dims: int, k: int) -> bool:
    """Whether bounds of cells could leave out half of the comparisons, judged before a tree is built.

    The exact neighbours of ``JUDGED`` rows give their radii. No cell is cut finer than to one of these rows, its ball no smaller than its
    own k neighbours need, and no home pivot is nearer than the nearest row: the bounds then say which of the rows must still meet.
    The answer is about effort only; neighbours are exact either way."""
    some = cut(rows.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(max(16, min(JUDGED, BROADCAST_BYTES // (8 * dims)))))
    found = search(rows, some.select(F.col("id").alias("query"), "vector"), min(k, n - 1))
    near = found.groupBy("query").agg(F.min_by("id", "rank").alias("next"), F.max("dist").alias("radius"))
    ends = rows.select(F.col("id").alias("next"), F.col("vector").alias("pivot"))
    held = ends.join(F.broadcast(near), "next").join(some.withColumnRenamed("id", "query"), "query").toArrow()  # JUDGED rows
    x, pivot, radius = matrix(held["vector"]).astype(float), matrix(held["pivot"]).astype(float), held["radius"].to_numpy()
    far, gap = _squared(x, x), np.sqrt(_squared(pivot, x))
    lower = (far - ((x - pivot) ** 2).sum(1)[:, None]) / np.maximum(2.0 * gap, 1e-300)
    met = np.maximum(lower, np.sqrt(far) - radius[None, :]) <= radius[:, None]
    return float(met.mean()) <= 0.5


def _guests(p: Plan, k: int, probes: int | None):
    """Home of each row, and the other cells that can hold a neighbour nearer than its bound, or the
    ``probes`` nearest cells when an approximate answer is asked for. A row whose own cell has fewer than k others
    is bounded by the nearest cells that together hold as many."""
    tree = p.tree

    def place(batch):
        x, bound = matrix(batch["vector"]), batch["bound"].to_numpy().copy()
        home, _ = tree.home(x)
        if probes is None:
            short = np.flatnonzero(np.isinf(bound))
            bound[short] = tree.within(x[short], k + 1)
            r, c = tree.reach(x, bound)
        else:
            r, c = tree.nearest_leaves(x, probes)
        away = c != home[r]
        rows, cells = np.concatenate([np.arange(len(x)), r[away]]), np.concatenate([home, c[away]])
        return rows, cells, np.arange(len(rows)) >= len(x)

    return place


def knn(
    vectors: DataFrame,
    k: int,
    cell_rows: int | None = None,
    block_rows: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """``(src, dst, rank, dist)``: the k nearest other rows by Euclidean distance, ties by id.

    Exact by default. ``probes`` visits only that many nearest cells per row (approximate; short
    lists stay short).
    """
    vectors = vectors.select("id", "vector")
    members = copy_members(vectors)
    has_copies = bool(members.limit(1).collect())
    distinct = collapse_copies(vectors, members) if has_copies else vectors

    def run(rows, n, dims):
        return _knn_distinct(rows, n, dims, k, cell_rows, block_rows, probes)

    edges = by_width(distinct, run)
    if has_copies:
        edges = best_k(_expand_copies(vectors, members, edges.drop("rank"), k), k)
    return edges.select("src", "dst", "rank", "dist")


def _expand_copies(vectors: DataFrame, members: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Neighbour lists of all rows from those of distinct vectors.

    Of a group of copies only the k+1 smallest ids can ever be listed as neighbours.
    """
    first = best_k(members, k + 1, "rep", ("id",)).select("rep", F.col("id").alias("copy"))
    reached = edges.join(first, edges["dst"] == first["rep"], "left").select(
        "src", F.coalesce("copy", "dst").alias("dst"), "dist"
    )
    own = first.select(F.col("rep").alias("src"), F.col("copy").alias("dst"), F.lit(0.0).alias("dist"))
    lists = best_k(reached.unionByName(own), k + 1).drop("rank")
    rep_of = vectors.select("id").join(members.select("id", "rep"), "id", "left").select(
        "id", F.coalesce("rep", "id").alias("src")
    )
    return rep_of.join(lists, "src").where("dst <> id").select(F.col("id").alias("src"), "dst", "dist")


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """``(query, id, rank, dist)``: the k nearest rows of each query vector.

    Query vectors (columns ``query``, ``vector``) travel to every task when they fit the broadcast
    bound; each task keeps its own best k per query and only those are shuffled. Larger query sets
    are cut into slices that do.
    """
    rows = queries.select("query", "vector")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("w")).first()
    slices = max(1, -(-(size.n * max(size.w or 1, 1) * 8) // BROADCAST_BYTES))
    parts = [
        _search_slice(vectors, rows.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == s) if slices > 1 else rows, k, metric, exclude_self)
        for s in range(slices)
    ]
    return best_k(reduce(DataFrame.unionByName, parts), k, "query", ("dist", "id"))


def _search_slice(vectors, rows, k, metric, exclude_self):
    held = rows.toArrow()
    qid, q = ids_of(held["query"]), matrix(held["vector"]).astype(float)
    dims = q.shape[1]
    if metric == "cosine":
        q = _unit_rows(q)
    kind = vectors.schema["id"].dataType.simpleString()
    qkind = rows.schema["query"].dataType.simpleString()

    def scan(batches):
        want = k + 1 if exclude_self else k
        row, ids, dist = np.empty(0, int), None, np.empty(0)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            x, names = matrix(batch["vector"]), ids_of(batch["id"])
            x = _unit_rows(x) if metric == "cosine" else x
            r, c, d = _nearest(q, x, names, want)
            row = np.concatenate([row, r])
            ids = names[c] if ids is None else np.concatenate([ids, names[c]])
            dist = np.concatenate([dist, d])
            row, ids, dist = _first_k(row, ids, dist, want, ids)
        if ids is not None:
            if metric == "cosine":
                dist = dist * dist / 2.0
            keep = ids != qid[row] if exclude_self else np.ones(len(row), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid[row[keep]]), pa.array(ids[keep]), pa.array(dist[keep])], ["query", "id", "dist"]
            )

    fit = vectors.where(F.size("vector") == dims).select("id", "vector")
    return fit.mapInArrow(scan, f"query {qkind}, id {kind}, dist double")


def neighbors(vectors: DataFrame, vector_id, k: int = 10) -> DataFrame:
    """k nearest rows of one stored record."""
    target = vectors.where(F.col("id") == F.lit(vector_id)).select(F.col("id").alias("query"), "vector")
    found = target.first()
    if found is None:
        raise KeyError(f"vector '{vector_id}' not found")
    if not found.vector:
        raise ValueError("source vector has no embedding")
    return search(vectors.where("vector IS NOT NULL"), target, k)


def max_similarity(vectors: DataFrame, cell_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``(id, max_sim)``: the highest cosine similarity of each row to any other row.

    On unit vectors the most similar row is the nearest one: cos = 1 - d*d/2. Zero vectors, and rows
    whose width nobody shares, have similarity 0 to every other row.
    """
    flat = V.near_zero_exact(F.col("vector"))
    units = vectors.where(~flat).select("id", V.unit(F.col("vector")).alias("vector"))
    best = knn(units, 1, cell_rows, block_rows).select("src", (1 - F.col("dist") * F.col("dist") / 2).alias("s"))
    stats = vectors.agg(F.count_if(flat).alias("zeros"), F.count_distinct(F.size("vector")).alias("widths")).first()
    floor = F.lit(0.0) if stats.zeros or stats.widths > 1 else None
    joined = vectors.select("id").join(best, F.col("id") == F.col("src"), "left")
    sim: Column = F.coalesce("s", F.lit(0.0)) if floor is None else F.greatest(F.coalesce("s", floor), floor)
    return joined.select("id", sim.alias("max_sim"))


def lone_rows(vectors: DataFrame, threshold: float, cell_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``(id)`` of rows without another row of cosine similarity >= threshold (> 0): a semi-join that stops early.

    A row leaves as soon as it is settled, by one similar row: first rows with an equal direction, then those that meet one in their
    own cell, then in the cells next to it, and only what is left visits all cells within reach. Rows are not compared with
    others once they are settled, and no similarities leave a task. Zero vectors are similar to nothing."""
    rows = vectors.select("id", "vector")
    flat = V.near_zero_exact(F.col("vector"))
    units = rows.where(~flat).select("id", V.unit(F.col("vector")).alias("vector"))
    members = cut(copy_members(units))
    # copies are settled; one of each group stands for them as a partner of other rows
    open_ = collapse_copies(units, members).join(members.select("id").withColumn("copied", F.lit(True)), "id", "left")
    open_ = open_.select("id", "vector", F.coalesce("copied", F.lit(False)).alias("settled"))
    alone = by_width(open_, lambda part, n, dims: _unsettled(part, n, dims, threshold, cell_rows, block_rows))
    return rows.where(flat).select("id").unionByName(alone)


NEXT_CELLS = 4


def _unsettled(rows: DataFrame, n: int, dims: int, threshold: float, cell_rows, block_rows) -> DataFrame:
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    kind = rows.schema["id"].dataType.simpleString()
    fields = result_schema(rows, ["id"], [])
    p = plan(rows, n, dims, cell_rows, block_rows, unit=True)
    if p.tree is not None and not (_worth_cells(p.tree, radius) and pays(p, visits(rows, _reached(p, radius)))):
        p = p.whole()

    def kernel(guests_only):
        def run(key, table):
            left, right, same = sides_of(key, table)
            a, b = matrix(left["vector"]), matrix(right["vector"])
            out = [_first_similar(b, a, right["settled"].to_numpy(), threshold, same, ids_of(right["id"]))]
            if not same and not guests_only:
                out.append(_first_similar(a, b, left["settled"].to_numpy(), threshold, False, ids_of(left["id"])))
            yield pa.table([pa.array(np.concatenate(out))], names=["id"]).cast(fields)

        return run

    home = cut(to_cells(rows, p))
    met = block_tasks(home, p, kernel(False), f"id {kind}", False).distinct()
    left = home.where("NOT settled").join(met, "id", "left_anti")
    if p.tree is None:
        return left.select("id")
    for probes in (NEXT_CELLS, None):
        left = cut(left)
        met = block_tasks(home.unionByName(_visits(left, p, radius, probes)), p, kernel(True), f"id {kind}", True, among_home=False).distinct()
        left = left.join(met, "id", "left_anti")
    return left.select("id")


def _first_similar(a, b, settled, threshold, same, names):
    """Names of the open rows of ``a`` with a similar row in ``b``; a row is left alone once it has one."""
    found = []
    for start, end in _slices(len(a) if len(b) else 0, TILE_ROWS):
        todo = start + np.flatnonzero(~settled[start:end])
        for lo, hi in _slices(len(b) if len(todo) else 0):
            sim = a[todo] @ b[lo:hi].T
            if same:
                own = (todo >= lo) & (todo < hi)
                sim[np.flatnonzero(own), todo[own] - lo] = -np.inf
            hit = (sim >= threshold).any(axis=1)
            found.append(todo[hit])
            todo = todo[~hit]
            if not len(todo):
                break
    return names[np.concatenate(found)] if found else names[:0]


def _visits(open_rows: DataFrame, p: Plan, radius: float, probes: int | None) -> DataFrame:
    """Open rows as guests of the cells within the radius: of the nearest ones, or of all."""
    tree = p.tree

    def place(batch):
        x, home = matrix(batch["vector"]), batch["own"].to_numpy()
        r, c = tree.reach(x, np.full(len(x), radius))
        if probes is not None:
            row, cell = tree.nearest_leaves(x, probes + 1)
            near = np.isin(r * tree.leaves + c, row * tree.leaves + cell)
            r, c = r[near], c[near]
        away = c != home[r]
        return r[away], c[away], np.ones(int(away.sum()), bool)

    return placed(open_rows.select("id", "vector", "settled", F.col("cell").alias("own")), place).drop("own")


# ---------------------------------------------------------------- per-row means by cluster


def cluster_distances(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``(id, cluster, inner, outer)``: mean distance of each row to the other rows of its cluster (null if alone) and the
    smallest mean distance to another cluster (null without one).

    ``rows`` has ``id, vector, cluster``. Every pair is compared. A task holds one block of rows, as many as fit
    ``held_bytes``, with a sum per row and cluster; the whole collection streams past it, and one row per record leaves."""
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("w"), F.count_distinct("cluster").alias("k")).first()
    per_row = 8 * ((size.w or 1) + 2 * size.k + 4)
    width = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-size.n * per_row // held_bytes), min(width, size.n // 512))
    own = rows.select("id", "vector", F.col("cluster").cast("int").alias("cluster"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    held = own.select(F.col("own").alias("block"), F.lit(0).alias("side"), "id", "vector", "cluster", "own")
    passing = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "vector", "cluster", "own")
    dealt = held.unionByName(passing).repartition(blocks, "block").sortWithinPartitions("block", "side")

    def work(batches):
        block = None
        for batch in batches:
            number, side = (batch.column(i).to_numpy() for i in (0, 1))
            steps = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *steps], [*steps, len(number)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if block is None or block.number != number[lo]:
                    if block is not None:
                        yield block.result()
                    block = _Held(int(number[lo]))
                (block.hold if side[lo] == 0 else block.meet)(part)
        if block is not None:
            yield block.result()

    return dealt.mapInArrow(work, f"id {kind}, cluster int, inner double, outer double")


class _Held:
    """One block's rows and their summed distances to each cluster met so far."""

    def __init__(self, number: int):
        self.number, self.parts, self.x = number, [], None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _ready(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.ids, self.x, self.cluster = table["id"], matrix(table["vector"]).astype(float), table["cluster"].to_numpy()
        # the dot product with (b, |b|^2, 1) is the squared distance
        self.left = np.concatenate([-2.0 * self.x, np.ones((len(self.x), 1)), (self.x * self.x).sum(1)[:, None]], axis=1)
        names = ids_of(self.ids)
        self.order = np.argsort(names, kind="stable")
        self.sorted = names[self.order]
        self.slot: dict[int, int] = {}  # cluster -> column of the sums
        self.sums, self.sizes = np.zeros((len(self.x), 0)), np.zeros(0)

    def meet(self, part: pa.RecordBatch) -> None:
        if self.x is None:
            self._ready()
        b, cluster = matrix(part.column(3)).astype(float), part.column(4).to_numpy()
        names, code = np.unique(cluster, return_inverse=True)
        for c in names.tolist():
            self.slot.setdefault(c, len(self.slot))
        if len(self.slot) > self.sums.shape[1]:
            more = len(self.slot) - self.sums.shape[1]
            self.sums, self.sizes = np.pad(self.sums, ((0, 0), (0, more))), np.pad(self.sizes, (0, more))
        columns = np.array([self.slot[c] for c in names.tolist()])
        member = np.zeros((len(code), len(names)))
        member[np.arange(len(code)), code] = 1.0
        self.sizes[columns] += member.sum(0)
        # a row is at distance zero from itself, whatever rounding says
        mine = np.flatnonzero(part.column(5).to_numpy() == self.number)
        at = self.order[np.searchsorted(self.sorted, ids_of(part.column(2))[mine])] if len(mine) else mine
        right = np.concatenate([b, (b * b).sum(1)[:, None], np.ones((len(b), 1))], axis=1)
        for lo, hi in _slices(len(self.x)):
            for start, end in _slices(len(b), TILE_ROWS):
                dist = self.left[lo:hi] @ right[start:end].T
                np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
                here = (at >= lo) & (at < hi) & (mine >= start) & (mine < end)
                dist[at[here] - lo, mine[here] - start] = 0.0
                self.sums[lo:hi, columns] += dist @ member[start:end]

    def result(self) -> pa.RecordBatch:
        own = np.array([self.slot[c] for c in self.cluster.tolist()])
        rows = np.arange(len(own))
        n = np.broadcast_to(self.sizes, self.sums.shape).copy()
        n[rows, own] -= 1
        mean = np.divide(self.sums, n, out=np.full(self.sums.shape, np.inf), where=n > 0)
        inner = mean[rows, own].copy()
        mean[rows, own] = np.inf
        outer = mean.min(1)
        return pa.RecordBatch.from_arrays(
            [self.ids.combine_chunks(), pa.array(self.cluster.astype("int32")), pa.array(inner, mask=np.isinf(inner)), pa.array(outer, mask=np.isinf(outer))],
            ["id", "cluster", "inner", "outer"],
        )
