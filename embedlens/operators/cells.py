"""A tree of pivots that cuts vectors into cells of bounded size.

Each node has pivots, rows of the data themselves; a row goes to the child of the nearest one. A child with more than twice
``cell_rows`` rows is cut again, level by level in Spark: one pass counts the rows of each cell and the farthest of them
from its pivot, another takes the rows of smallest hash of each cell that is too large as its pivots. The driver holds the
pivots only, at most ``TREE_BYTES`` of them, and ships them to the tasks.

Bounds. Let x be nearer to pivot h than to its sibling c. Every y in the cell of c has
d(x,y) >= (d(x,c)^2 - d(x,h)^2) / (2 d(h,c)), and no y is nearer than d(x,c) less the cell's own radius. A subtree is left out
as soon as one of them, at any level, exceeds the radius asked for; so a row meets the cells around it, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAN = 128  # children of a node at most
TREE_BYTES = 64 << 20
SLACK = 1e-9  # widens bounds against rounding; results are re-checked exactly


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


@dataclass
class Node:
    """``child``: number of the child's node, or ~leaf. ``ball``: distance of its farthest row from the pivot."""

    pivots: np.ndarray
    ids: np.ndarray
    child: np.ndarray
    ball: np.ndarray
    gap: np.ndarray = field(init=False)

    def __post_init__(self):
        self.gap = np.sqrt(squared(self.pivots, self.pivots))
        np.fill_diagonal(self.gap, np.inf)


def _by(values: np.ndarray):
    """(value, places) of each distinct value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield values[part[0]], part


class PivotTree:
    def __init__(self, pivots: np.ndarray, ids: np.ndarray):
        self.nodes: list[Node] = []
        self.places: list[tuple[int, int]] = []  # (node, child) of each leaf
        self.rows = np.zeros(0)  # rows of each leaf
        self.add(None, pivots, ids)

    def add(self, leaf: int | None, pivots: np.ndarray, ids: np.ndarray) -> None:
        """Make a leaf (or the root) a node with these pivots; its first child takes the leaf's number."""
        first = [] if leaf is None else [leaf]
        numbers = np.array([*first, *range(len(self.places), len(self.places) + len(pivots) - len(first))])
        if leaf is not None:
            node, at = self.places[leaf]
            self.nodes[node].child[at] = len(self.nodes)
        self.places += [(-1, -1)] * (len(pivots) - len(first))
        for at, number in enumerate(numbers):
            self.places[number] = (len(self.nodes), at)
        self.nodes.append(Node(pivots, ids, ~numbers, np.full(len(pivots), np.inf)))

    @property
    def leaves(self) -> int:
        return len(self.places)

    @property
    def nbytes(self) -> int:
        return sum(n.pivots.nbytes + n.gap.nbytes for n in self.nodes)

    def _of_leaves(self, what: str) -> np.ndarray:
        return np.array([getattr(self.nodes[n], what)[at] for n, at in self.places])

    @property
    def pivots(self) -> np.ndarray:
        return self._of_leaves("pivots")

    @property
    def pivot_ids(self) -> np.ndarray:
        return self._of_leaves("ids")

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and its distance from the leaf's pivot."""
        leaf, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            sq = squared(x[rows], self.nodes[node].pivots)
            near = sq.argmin(1)
            dist[rows] = np.sqrt(sq[np.arange(len(rows)), near])
            for child, part in _by(self.nodes[node].child[near]):
                if child < 0:
                    leaf[rows[part]] = ~child
                else:
                    todo.append((int(child), rows[part]))
        return leaf, dist

    def reach(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that can hold a row within the row's radius."""
        out_rows, out_leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            own = self.nodes[node]
            sq = squared(x[rows], own.pivots)
            near = sq.argmin(1)
            lower = (sq - sq[np.arange(len(rows)), near][:, None]) / (2.0 * own.gap[near])
            lower = np.maximum(lower, np.sqrt(sq) - own.ball[None, :])
            i, c = np.nonzero(lower <= (radius[rows] + SLACK)[:, None])
            child = own.child[c]
            for number, part in _by(child):
                if number >= 0:
                    todo.append((int(number), rows[i[part]]))
            end = child < 0
            out_rows.append(rows[i[end]])
            out_leaves.append(~child[end])
        return np.concatenate(out_rows), np.concatenate(out_leaves)

    def nearest_leaves(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for about ``probes`` leaves of nearest pivots: on each level the nearest children are followed."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        while len(rows):
            met = [found]
            for node, part in _by(nodes):
                own = self.nodes[node]
                sq = squared(x[rows[part]], own.pivots)
                met.append([np.repeat(rows[part], len(own.child)), np.tile(own.child, len(part)), sq.reshape(-1)])
            row, child, sq = (np.concatenate(c) for c in zip(*met))
            order = np.lexsort((child, sq, row))
            row, child, sq = row[order], child[order], sq[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < probes
            row, child, sq = row[keep], child[keep], sq[keep]
            end = child < 0
            found = [row[end], child[end], sq[end]]
            rows, nodes = row[~end], child[~end]
        return found[0], ~found[1]

    def within(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row has at least k rows: the nearest leaves that hold as many lie inside it."""
        out = np.full(len(x), np.inf)
        pivots, ball = self.pivots, self._of_leaves("ball")
        step = max(1, (1 << 22) // max(1, len(pivots)))
        for lo in range(0, len(x), step):
            far = np.sqrt(squared(x[lo : lo + step], pivots)) + ball[None, :]
            order = np.argsort(far, axis=1)
            upto = np.cumsum(self.rows[order], axis=1)
            enough = (upto >= k).argmax(axis=1)
            at = np.arange(len(far))
            value = far[at, order[at, enough]]
            out[lo : lo + step] = np.where(upto[:, -1] >= k, value * (1 + SLACK) + SLACK, np.inf)
        return out


# ---------------------------------------------------------------- building


def _counted(vectors: DataFrame, tree: PivotTree, unit: bool) -> list:
    """``leaf, n, ball`` of each leaf that has rows; partial counts by batch."""
    from embedlens.operators.pairs import matrix

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                leaf, dist = tree.home(unit_rows(x) if unit else x)
                n = np.bincount(leaf, minlength=tree.leaves)
                ball = np.zeros(tree.leaves)
                np.maximum.at(ball, leaf, dist)
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype("int32")), pa.array(n[own]), pa.array(ball[own])], ["leaf", "n", "ball"])

    parts = vectors.select("vector").mapInArrow(count, "leaf int, n long, ball double")
    return parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("ball").alias("ball")).collect()


def _candidates(vectors: DataFrame, tree: PivotTree | None, fans: dict[int, int], unit: bool):
    """Rows of smallest hash of each leaf to be cut: its new pivots."""
    from embedlens.operators.pairs import matrix

    kind = vectors.schema["id"].dataType.simpleString()
    if tree is None:
        rows = vectors.select("id", "vector", F.lit(-1).alias("leaf"))
    else:
        wanted = np.zeros(tree.leaves, bool)
        wanted[list(fans)] = True

        def pick(batches):
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1))
                    leaf, _ = tree.home(unit_rows(x) if unit else x)
                    own = np.flatnonzero(wanted[leaf])
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(leaf[own].astype("int32"))], ["id", "vector", "leaf"])

        rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(pick, f"id {kind}, vector array<double>, leaf int")
    order = Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(fans.values()))
    own = vectors.sparkSession.createDataFrame(list(fans.items()), "leaf int, fan int")  # a row per leaf to be cut
    return first.join(F.broadcast(own), "leaf").where("place <= fan").select("id", "vector", "leaf").toArrow()


def build(vectors: DataFrame, n: int, dims: int, cell_rows: int, unit: bool = False, fan: int | None = None) -> PivotTree | None:
    """The tree of ``vectors`` (id, vector); None where fewer than four cells would come of it.

    A cell that no pivots can divide (copies, or one direction if ``unit``) stays whole, and so do all once the tree reaches ``TREE_BYTES``."""
    from embedlens.operators.pairs import ids_of, matrix

    fan = fan or FAN
    budget = TREE_BYTES // (8 * dims)
    wanted = min(-(-n // cell_rows), fan, budget)
    if wanted < 4:
        return None
    tree, fans, parents = None, {-1: wanted}, {-1: n}
    while fans:
        sample = _candidates(vectors, tree, fans, unit)
        leaf_of = sample["leaf"].to_numpy()
        rows, ids = matrix(sample["vector"]).astype(float), ids_of(sample["id"])
        rows = unit_rows(rows) if unit else rows
        cut_leaves: dict[int, int] = {}
        for leaf, part in _by(leaf_of):
            pivots, first = np.unique(rows[part], axis=0, return_index=True)
            if leaf < 0:
                if len(pivots) < 4:
                    return None
                tree = PivotTree(pivots, ids[part][first])
                cut_leaves |= {i: parents[-1] for i in range(len(pivots))}
            elif len(pivots) > 1:
                start = tree.leaves
                tree.add(int(leaf), pivots, ids[part][first])
                cut_leaves |= {i: parents[int(leaf)] for i in (int(leaf), *range(start, tree.leaves))}
        tree.rows = np.zeros(tree.leaves)
        for r in _counted(vectors, tree, unit):  # a row per leaf
            tree.rows[r.leaf] = r.n
            node, at = tree.places[r.leaf]
            tree.nodes[node].ball[at] = r.ball
        for leaf in np.flatnonzero(tree.rows == 0):
            node, at = tree.places[leaf]
            tree.nodes[node].ball[at] = 0.0
        fans, room = {}, budget - sum(len(x.child) for x in tree.nodes)
        for leaf, parent in sorted(cut_leaves.items()):
            size = tree.rows[leaf]
            children = int(min(-(-size // cell_rows), fan))
            # a cut that leaves nearly all rows in one cell leads nowhere
            if size > 2 * cell_rows and size < 0.95 * parent and children <= room:
                fans[leaf] = children
                room -= children
        parents = {leaf: int(tree.rows[leaf]) for leaf in fans}
    return tree
