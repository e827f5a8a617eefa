import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.operators import pairs as P
from embedlens.operators.components import components
from embedlens.operators.distances import pair_of, strided_pairs


def clustered(n, dims, seed, centers=12, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dims))
    return c[rng.integers(centers, size=n)] + spread * rng.normal(size=(n, dims))


def hot(n, dims, seed):
    """Two thirds clustered, one third exact copies of one vector."""
    x = clustered(n, dims, seed)
    x[rng_pick(n, seed)] = x[0]
    return x


def rng_pick(n, seed):
    return np.random.default_rng(seed + 1).permutation(n)[: n // 3]


def cosines(x):
    norm = np.sqrt((x * x).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (x @ x.T) / np.outer(norm, norm)
    return np.where(np.outer(norm, norm) > 0, s, 0.0)


def brute_pairs(x, threshold):
    s = cosines(x)
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    return set(zip(i.tolist(), j.tolist()))


def brute_knn(x, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((round(d[j], 9), j) for j in range(len(x)) if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(order)}
    return out


@pytest.mark.parametrize("cell_rows,block_rows", [(None, None), (None, 16), (20, 16), (12, 300)])
def test_similar_pairs(make, cell_rows, block_rows):
    x = clustered(240, 6, 1)
    got = P.similar_pairs(make(x), 0.98, cell_rows, block_rows).collect()
    assert {(r.a, r.b) for r in got} == brute_pairs(x, 0.98) and len(got) == len({(r.a, r.b) for r in got})
    s = cosines(x)
    assert all(abs(r.similarity - s[r.a, r.b]) < 1e-9 for r in got)


@pytest.mark.parametrize("threshold", [0.0, -1.0])
def test_zero_vectors_pair_only_at_low_thresholds(make, threshold):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    got = {(r.a, r.b) for r in P.similar_pairs(make(x), threshold).collect()}
    assert got == brute_pairs(x, threshold)
    assert not P.similar_pairs(make(x), 0.1).collect()


def test_mixed_widths_never_pair(make):
    rows = [[1, 0], [1, 0, 0], [1, 0.01], [1, 0, 0.01]]
    assert {(r.a, r.b) for r in P.similar_pairs(make(rows), 0.9).collect()} == {(0, 2), (1, 3)}
    assert {(r.src, r.dst) for r in P.knn(make(rows), 2).collect()} == {(0, 2), (2, 0), (1, 3), (3, 1)}


def test_cells_are_used_and_lose_nothing(make):
    x = clustered(300, 8, 3)
    p = P.plan(make(x), 300, 8, cell_rows=20, unit=True)
    assert p.tree is not None and P._worth_cells(p.tree, 0.2)


@pytest.mark.parametrize("cell_rows,block_rows", [(None, 16), (25, 16)])
def test_links_give_the_components_of_all_pairs(make, cell_rows, block_rows):
    x = clustered(200, 5, 7, centers=15)
    links = P.similar_links(make(x), 0.98, cell_rows, block_rows)
    assert links.count() < 200 * 20
    got = {r.id: r.component for r in components(links).collect()}
    label = list(range(200))
    for i, j in brute_pairs(x, 0.98):
        a, b = label[i], label[j]
        label = [min(a, b) if v in (a, b) else v for v in label]
    want = {i: v for i, v in enumerate(label) if label.count(v) > 1}
    assert got == want


def test_dense_group_emits_no_pairs(make):
    x = np.array([1.0, 0.0, 0.0]) + 1e-4 * np.random.default_rng(0).normal(size=(300, 3))
    links = P.similar_links(make(x), 0.9, block_rows=100)
    assert links.count() <= 6 * 200  # six block pairs, a spanning forest each, in place of 44 850 pairs


@pytest.mark.parametrize("cell_rows,block_rows", [(None, None), (None, 16), (20, 16)])
@pytest.mark.parametrize("build", [clustered, hot])
def test_knn(make, build, cell_rows, block_rows):
    x = build(150, 5, 11)
    got = P.knn(make(x), 4, cell_rows, block_rows).collect()
    assert {(r.src, r.dst, r.rank) for r in got} == brute_knn(x, 4)


def test_knn_is_the_same_for_any_partitioning(make):
    x = hot(90, 4, 2)
    runs = [sorted(map(tuple, P.knn(make(x, parts), 3).collect())) for parts in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_knn_of_few_rows(make, n):
    x = [[float(i), 0.0] for i in range(n)]
    got = {(r.src, r.dst, r.rank) for r in P.knn(make(x), 5).collect()}
    assert got == brute_knn(np.array(x).reshape(n, 2), 5)


def test_string_ids(make):
    rows = [(f"v{i}", [float(i), 0.0]) for i in range(5)] + [("copy", [0.0, 0.0])]
    got = {(r.src, r.dst) for r in P.knn(make(rows, kind="string"), 1).collect()}
    assert ("v0", "copy") in got and ("copy", "v0") in got and ("v4", "v3") in got
    pairs = {(r.a, r.b) for r in P.similar_pairs(make(rows, kind="string"), 0.99).collect()}
    assert ("v1", "v2") in pairs and not any("copy" in p for p in pairs)


def test_approximate_knn_recall(make):
    x = clustered(400, 6, 5)
    exact = {(r.src, r.dst) for r in P.knn(make(x), 5).collect()}
    near = {(r.src, r.dst) for r in P.knn(make(x), 5, cell_rows=40, probes=4).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_search_and_neighbors(make, spark):
    x = clustered(120, 4, 9)
    df = make(x)
    q = spark.createDataFrame([(1000, [float(v) for v in x[3]])], "query bigint, vector array<double>")
    got = P.search(df, q, 3, exclude_self=False).orderBy("rank").collect()
    assert got[0].id == 3 and got[0].dist == 0.0
    want = sorted((d, i) for i, d in enumerate(np.sqrt(((x - x[3]) ** 2).sum(1))))[:3]
    assert [r.id for r in got] == [i for _, i in want]
    assert 3 not in [r.id for r in P.neighbors(df, 3, 5).collect()]
    with pytest.raises(KeyError):
        P.neighbors(df, 999)
    with pytest.raises(ValueError):
        P.neighbors(df.unionByName(make([(500, None)])), 500)


def test_search_in_slices(make, spark, monkeypatch):
    x = clustered(60, 4, 4)
    q = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "query bigint, vector array<double>")
    whole = sorted(map(tuple, P.search(make(x), q, 3).collect()))
    monkeypatch.setattr(P, "BROADCAST_BYTES", 200)
    assert sorted(map(tuple, P.search(make(x), q, 3).collect())) == whole


def test_max_similarity(make):
    x = np.vstack([hot(60, 4, 8), np.zeros((1, 4)), -np.ones((1, 4)) * 50])
    got = {r.id: r.max_sim for r in P.max_similarity(make(x)).collect()}
    s = cosines(x)
    np.fill_diagonal(s, -2)
    assert all(abs(got[i] - s[i].max()) < 1e-9 for i in range(len(x)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_are_settled_through_pivots(make, monkeypatch, seed):
    """A third of the rows in one tiny ball, a chain leading out of it, and scattered rows."""
    rng = np.random.default_rng(seed)
    ball = np.array([1.0, 0, 0, 0]) + 1e-3 * rng.normal(size=(100, 4))
    angle = np.linspace(0.05, 2.5, 40)
    chain = np.stack([np.cos(angle), np.sin(angle), 0 * angle, 0 * angle], 1)
    x = np.vstack([ball, chain, rng.normal(size=(160, 4))])[rng.permutation(300)]
    used = []
    real = P._links_by_cells
    monkeypatch.setattr(P, "_links_by_cells", lambda *a: used.append(1) or real(*a))
    links = P.similar_links(make(x), 0.995, cell_rows=15, block_rows=32)
    assert used
    got = {r.id: r.component for r in components(links).collect()}
    label = list(range(300))
    for i, j in brute_pairs(x, 0.995):
        a, b = label[i], label[j]
        label = [min(a, b) if v in (a, b) else v for v in label]
    assert got == {i: v for i, v in enumerate(label) if label.count(v) > 1}
    assert links.count() < 3000  # the ball alone has 4 950 pairs


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame(chain + star, "a bigint, b bigint").repartition(5)
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}


@pytest.mark.parametrize("n", [2, 3, 17, 500])
def test_pair_index_inverse(spark, n):
    total = n * (n - 1) // 2
    i, j = pair_of(F.col("id"), n)
    rows = spark.range(total).select("id", i.alias("i"), j.alias("j")).orderBy("id").collect()
    assert [(r.i, r.j) for r in rows] == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_pair_index_far_out(spark):
    n = 2_000_000
    total = n * (n - 1) // 2
    i, j = pair_of(F.col("id"), n)
    rows = spark.createDataFrame([(0,), (total - 1,), (total // 2,), (n - 2,), (n - 1,)], "id bigint").select("id", i.alias("i"), j.alias("j")).collect()
    for r in rows:
        assert 0 <= r.i < r.j < n and r.i * (2 * n - 1 - r.i) // 2 + (r.j - r.i - 1) == r.id


def test_strided_pairs(make):
    x = clustered(30, 3, 6)
    every = [(a, b) for a in range(30) for b in range(a + 1, 30)]
    got = sorted((r.id_a, r.id_b) for r in strided_pairs(make(x), 100).collect())
    assert got == sorted(every[t * 4] for t in range(100))
    assert strided_pairs(make(x), 10_000).count() == 435


# ---------------------------------------------------------------- the tree of pivots


def spread(n, dims, seed):
    """Clusters of clusters, of very different density."""
    rng = np.random.default_rng(seed)
    top = rng.normal(0, 20, (5, dims))
    low = top[rng.integers(5, size=40)] + rng.normal(0, 2, (40, dims))
    size = np.sort(rng.integers(40, size=n) * rng.integers(40, size=n) // 40)
    return low[size] + rng.normal(0, 0.2, (n, dims))


def test_tree_cuts_dense_cells_until_they_are_small(make, monkeypatch):
    monkeypatch.setattr(P.C, "FAN", 4)
    x = spread(900, 3, 5)
    tree = P.plan(make(x), 900, 3, cell_rows=20).tree
    assert len(tree.nodes) > 10 and tree.rows.sum() == 900 and tree.rows.max() <= 40
    leaf, dist = tree.home(x)
    assert np.array_equal(np.bincount(leaf, minlength=tree.leaves), tree.rows)
    ball = tree._of_leaves("ball")
    assert (dist <= ball[leaf] + 1e-9).all()


@pytest.mark.parametrize("radius", [0.05, 0.7, 6.0])
def test_reach_loses_no_row_within_the_radius(make, monkeypatch, radius):
    monkeypatch.setattr(P.C, "FAN", 4)
    x = spread(500, 3, 6)
    tree = P.plan(make(x), 500, 3, cell_rows=15).tree
    leaf, _ = tree.home(x)
    row, cell = tree.reach(x, np.full(len(x), radius))
    met = set(zip(row.tolist(), cell.tolist()))
    assert len(met) == len(row)
    near = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2)) <= radius
    assert all((i, leaf[j]) in met for i, j in zip(*np.nonzero(near)))
    assert radius > 1 or len(met) < 0.3 * len(x) * tree.leaves


def test_a_cell_of_copies_stays_whole(make, monkeypatch):
    monkeypatch.setattr(P.C, "FAN", 4)
    x = np.concatenate([np.ones((100, 2)), spread(300, 2, 7)])
    tree = P.plan(make(x), 400, 2, cell_rows=10).tree
    leaf, _ = tree.home(x)
    assert len(set(leaf[:100])) == 1 and tree.rows.sum() == 400
    assert P.plan(make(np.ones((200, 2))), 200, 2, cell_rows=10).tree is None


@pytest.mark.parametrize("build", [spread, hot])
def test_knn_through_a_deep_tree(make, monkeypatch, build):
    monkeypatch.setattr(P.C, "FAN", 4)
    x = build(220, 3, 8)
    got = P.knn(make(x), 4, 6, 64).collect()  # cells of about as many rows as neighbours asked for
    assert {(r.src, r.dst, r.rank) for r in got} == brute_knn(x, 4)


def test_pairs_and_links_through_a_deep_tree(make, monkeypatch):
    monkeypatch.setattr(P.C, "FAN", 5)
    x = clustered(300, 4, 9, centers=25, spread=0.02)
    want = brute_pairs(x, 0.995)
    got = P.similar_pairs(make(x), 0.995, 8, 64)
    assert {(r.a, r.b) for r in got.collect()} == want and len(P.plan(make(x), 300, 4, 8, unit=True).tree.nodes) > 1
    label = {r.id: r.component for r in components(P.similar_links(make(x), 0.995, 8, 64)).collect()}
    assert all(label[i] == label[j] for i, j in want)
    assert set(label) == {i for p in want for i in p}


def test_copies_of_a_row_do_not_grow_with_the_rows(make, monkeypatch):
    """Cells are as small in a collection of sixteen times the rows; each row still meets about as many of them."""
    monkeypatch.setattr(P.C, "FAN", 16)
    copies = []
    for n in (1500, 24_000):
        x = np.random.default_rng(n).random((n, 2))
        tree = P.plan(make(x), n, 2, cell_rows=32).tree
        some = np.random.default_rng(1).integers(n, size=500)
        d = np.sqrt(P._squared(x[some], x))
        kth = np.partition(d, 5, axis=1)[:, 5]
        row, _ = tree.reach(x[some], kth)
        copies.append(len(row) / 500)
        assert tree.rows.max() <= 64
    assert copies[1] < 1.5 * copies[0] and copies[1] < 5


def test_rows_of_thin_cells_are_bounded_by_the_cells_around_them(make, monkeypatch):
    monkeypatch.setattr(P.C, "FAN", 4)
    x = spread(600, 3, 10)
    tree = P.plan(make(x), 600, 3, cell_rows=4).tree
    bound = tree.within(x, 11)
    d = np.sort(np.sqrt(P._squared(x, x)), axis=1)[:, 10]
    assert (bound >= d - 1e-9).all() and np.median(bound) < 3


# ---------------------------------------------------------------- rows without a similar one


def brute_lone(x, threshold):
    s = cosines(x)
    np.fill_diagonal(s, -1)
    return {i for i in range(len(x)) if s[i].max() < threshold}


@pytest.mark.parametrize("cell_rows,block_rows", [(None, None), (None, 30), (10, 16)])
@pytest.mark.parametrize("build,threshold", [(clustered, 0.995), (hot, 0.98), (spread, 0.9999)])
def test_lone_rows(make, monkeypatch, build, threshold, cell_rows, block_rows):
    monkeypatch.setattr(P.C, "FAN", 4)
    x = build(260, 4, 12)
    x[::9] += np.random.default_rng(1).normal(0, 2, x[::9].shape)
    x[3] = 0.0
    got = [r.id for r in P.lone_rows(make(x), threshold, cell_rows, block_rows).collect()]
    assert set(got) == brute_lone(x, threshold) and len(got) == len(set(got)) > 3


def test_settled_rows_do_not_travel(make, monkeypatch):
    """Only rows that found nothing in their own cell visit others."""
    monkeypatch.setattr(P.C, "FAN", 8)
    sent, real = [], P._visits
    monkeypatch.setattr(P, "_visits", lambda rows, *more: sent.append(rows.count()) or real(rows, *more))
    x = clustered(600, 4, 13, centers=20, spread=0.01)
    x[:5] = np.eye(5)[:, :4] * -9 + 0.3
    got = {r.id for r in P.lone_rows(make(x), 0.999, 20, 64).collect()}
    assert got == brute_lone(x, 0.999)
    assert len(sent) == 2 and sent[1] <= sent[0] < 60


def test_lone_rows_of_widths_and_few_rows(make):
    assert {r.id for r in P.lone_rows(make([[1, 0], [1, 0, 0], [1, 0.01], [0, 0]]), 0.5).collect()} == {1, 3}
    assert {r.id for r in P.lone_rows(make([[1, 0]]), 0.5).collect()} == {0}
    assert P.lone_rows(make([]), 0.5).count() == 0


def test_lists_with_nulls_in_other_places_are_no_copies(spark):
    rows = [(1, [1.0, None, 2.0]), (2, [1.0, 2.0]), (3, [None, 1.0, 2.0]), (4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert sorted((r.id, r.rep) for r in P.copy_members(df).collect()) == [(2, 2), (4, 2)]


def test_blocks_grow_with_the_rows_so_copies_do_not():
    """A row is copied once per block: eight times until blocks are full."""
    blocks = {n: P.Plan(n, 64, P.BLOCK_ROWS).blocks(n) for n in (10_000, 100_000, 600_000)}
    assert blocks == {10_000: 8, 100_000: 8, 600_000: 19}


@pytest.mark.parametrize("run", [
    lambda v: {(r.src, r.dst, r.rank) for r in P.knn(v, 3, cell_rows=8, block_rows=16).collect()},
    lambda v: {(r.a, r.b) for r in P.similar_pairs(v, 0.5, 8, 16).collect()},
    lambda v: {(r.id, r.component) for r in components(P.similar_links(v, 0.5, 8, 16)).collect()},
])
def test_rows_without_structure_are_not_sent_to_most_cells(make, monkeypatch, run):
    sent, real = [], P.block_tasks
    monkeypatch.setattr(P, "block_tasks", lambda rows, *a, **b: sent.append(rows.count()) or real(rows, *a, **b))
    x = np.random.default_rng(4).normal(size=(400, 24))
    got = run(make(x))
    assert sent and max(sent) == 400
    if len(next(iter(got))) == 3:
        assert got == brute_knn(x, 3)
    else:
        pairs = brute_pairs(x, 0.5)
        label = list(range(400))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [min(a, b) if v in (a, b) else v for v in label]
        assert got in (pairs, {(i, v) for i, v in enumerate(label) if label.count(v) > 1})


def test_matches_leave_a_task_a_tile_at_a_time():
    n = 5000
    import pyarrow as pa

    table = pa.table({"id": np.arange(n), "vector": pa.array(list(np.ones((n, 2)))), "side": np.zeros(n, "int32")})
    sizes = [len(i) for i, _, _ in P.matches([pa.scalar(0)] * 4, table, 0.9)[3]]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= P.SLICE_ROWS * 2048


@pytest.mark.parametrize("bounded", [False, True])
def test_nearest_over_several_tiles(monkeypatch, bounded):
    monkeypatch.setattr(P, "TILE_ROWS", 7, raising=False)
    x = np.random.default_rng(5).integers(0, 3, (60, 3)).astype(float)
    ids = np.random.default_rng(6).permutation(60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    bound = np.sort(d, axis=1)[:, 4] if bounded else None
    row, col, dist = P._nearest(x, x, ids, 5, bound)
    want = {(i, j) for i in range(60) for j in sorted(range(60), key=lambda j: (d[i, j], ids[j]))[:5]}
    assert set(zip(row.tolist(), col.tolist())) == want and np.allclose(dist, d[row, col])


def test_no_tree_is_built_for_rows_without_structure(make, monkeypatch):
    """Levels of cells were cut, counted and visited before all rows were compared without them."""
    built = []
    real = P.C.build
    monkeypatch.setattr(P.C, "build", lambda *a, **k: built.append(1) or real(*a, **k))
    x = np.random.default_rng(3).normal(size=(500, 24))
    got = P.knn(make(x), 3, cell_rows=16, block_rows=32).collect()
    assert {(r.src, r.dst, r.rank) for r in got} == brute_knn(x, 3) and not built
    x = clustered(500, 24, 4, centers=60, spread=0.001)
    got = P.knn(make(x), 3, cell_rows=16, block_rows=32).collect()
    assert {(r.src, r.dst, r.rank) for r in got} == brute_knn(x, 3) and built


@pytest.mark.parametrize("kind", ["plain", "far", "huge", "tiny", "copies", "grid"])
@pytest.mark.parametrize("bounded", [False, True])
def test_single_precision_loses_no_neighbour(kind, bounded):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8))
    x = {
        "plain": x, "far": x * 1e-6 + 1e3, "huge": x * 1e60, "tiny": x * 1e-60, "copies": np.repeat(x[:70], 10, axis=0), "grid": np.floor(x),
    }[kind]
    ids = rng.permutation(700)
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(ids, far.shape), far))[:, :5]
    bound = np.take_along_axis(far, order[:, 4:], 1)[:, 0] if bounded else None
    row, col, dist = P._nearest(x, x, ids, 5, bound)
    assert (row == np.repeat(np.arange(700), 5)).all() and (col == order.ravel()).all()
    assert np.allclose(dist, np.take_along_axis(far, order, 1).ravel(), rtol=1e-12)
