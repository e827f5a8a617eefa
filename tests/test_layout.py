import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.operators import layout as L
from embedlens.operators import rounds
from embedlens.operators import spatial as S
from embedlens.operators.pairs import knn
from embedlens.sources.collections import Collection
from embedlens.sources.projections import projection, projection_key


def points(spark, p):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id bigint, x double, y double, z double").repartition(3)


def coords(df):
    return np.array([(r.x, r.y, r.z) for r in df.orderBy("id").collect()])


def brute_closest(p, radius, most):
    d = sorted((float(np.sqrt(((p[i] - p[j]) ** 2).sum())), i, j) for i in range(len(p)) for j in range(i + 1, len(p)))
    return [(i, j) for r, i, j in d if r <= radius][:most]


@pytest.mark.parametrize("radius,most", [(0.3, 500), (0.3, 7), (5.0, 20)])
def test_closest_pairs(spark, radius, most):
    p = np.random.default_rng(2).uniform(-1, 1, size=(120, 3))
    got = S.closest_pairs(points(spark, p), radius, most).collect()
    assert [(r.id1, r.id2) for r in got] == brute_closest(p, radius, most)


def test_closest_pairs_with_a_third_at_one_place(spark, monkeypatch):
    p = np.random.default_rng(3).uniform(-1, 1, size=(90, 3))
    p[::3] = 0.0
    got = S.closest_pairs(points(spark, p), 0.5, 10).collect()
    assert [(r.id1, r.id2) for r in got] == brute_closest(p, 0.5, 10)


def test_closest_pairs_narrow_the_radius_in_crowds(spark, monkeypatch):
    p = np.random.default_rng(4).normal(size=(200, 3)) * 1e-3
    full = brute_closest(p, 1.0, 15)
    seen = []
    real = S._grid_pairs
    monkeypatch.setattr(S, "_grid_pairs", lambda pts, r: seen.append(r) or real(pts, r))
    monkeypatch.setattr(S, "_crowding", lambda pts, r: 10**12 if r > 1e-4 else 0)
    got = S.closest_pairs(points(spark, p), 1.0, 15).collect()
    assert [(r.id1, r.id2) for r in got] == full and seen[0] < 1e-3 and seen[-1] < 1.0


def test_within(spark):
    p = np.random.default_rng(5).uniform(-1, 1, size=(80, 3))
    got = [r.id for r in S.within(points(spark, p), (0.1, 0.2, 0.0), 0.6).collect()]
    d = np.sqrt(((p - np.array([0.1, 0.2, 0.0])) ** 2).sum(1))
    assert got == [i for i in np.argsort(d) if d[i] <= 0.6]


def test_minimum_spacing_parts_close_points(spark):
    p = np.random.default_rng(6).uniform(-1, 1, size=(60, 3))
    p[1] = p[0] + [1e-4, 0, 0]
    p[3] = p[2]  # same place: no direction to push in
    got = coords(S.minimum_spacing(points(spark, p), block_rows=16))
    assert np.linalg.norm(got[1] - got[0]) > 1e-3 and np.allclose(got[3], got[2])
    far = [i for i in range(4, 60)]
    assert np.allclose(got[far], p[far], atol=0.1)
    cells = coords(S.minimum_spacing(points(spark, p), cell_rows=8, block_rows=16))
    assert np.allclose(cells, got)


def test_normalise(spark):
    p = np.array([[i, i, i] for i in range(19)] + [[1000, 1000, 1000]], float)
    got = coords(S.normalise(points(spark, p)))
    assert np.abs(got).max() <= 1.0
    q = np.array([[10 * i, i, 0] for i in range(20)], float)
    got = coords(S.normalise(points(spark, q)))
    assert np.ptp(got[:, 0]) > np.ptp(got[:, 1])
    assert not coords(S.normalise(points(spark, np.ones((5, 3))))).any()


def test_curve():
    a, b = L.curve(0.1, 1.0)
    assert 1 < a < 3 and 0.5 < b < 1.5


@pytest.mark.parametrize("n,epochs,share", [(100, 500, None), (101, 400, None), (6_000, 200, 0.30), (60_000, 100, 0.07), (2_000_000, 100, 0.01)])
def test_size_rules(n, epochs, share):
    assert L.epochs_for(n) == epochs and L.sample_share(n) == share


def test_random_projection_keeps_distances(make):
    x = np.random.default_rng(1).normal(size=(40, 300))
    y = {r.id: np.array(r.vector) for r in L.random_projection(make(x), 300).collect()}
    assert len(y[0]) == 50
    ratio = [np.linalg.norm(y[i] - y[i + 1]) / np.linalg.norm(x[i] - x[i + 1]) for i in range(39)]
    assert 0.85 < np.mean(ratio) < 1.15
    w = L.projection_weights(300)
    assert 0.6 < (w == 0).mean() < 0.73 and abs((w > 0).mean() - (w < 0).mean()) < 0.03


def test_pca_matches_eigenvectors(make):
    x = np.random.default_rng(2).normal(size=(100, 6)) * np.array([9, 5, 3, 1, 1, 1])
    got = coords(L.pca(make(x)))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ vectors[:, ::-1][:, :3]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_fuzzy_weights_sum_to_log2_k(make):
    x = np.random.default_rng(3).normal(size=(80, 5))
    w = L._weights(knn(make(x), 8), L._fuzzy).groupBy("src").agg(F.sum("w").alias("s"), F.max("w").alias("m")).collect()
    assert all(r.s == pytest.approx(3.0, abs=1e-6) and r.m == pytest.approx(1.0) for r in w)
    graph = L.fuzzy_graph(knn(make(x), 8)).collect()
    assert all(r.a < r.b and 0 < r.weight <= 1 for r in graph)


def test_affinities_reach_the_perplexity(make):
    x = np.random.default_rng(4).normal(size=(60, 4))
    p = L.affinities(knn(make(x), 30), 10.0, 60).collect()
    assert sum(r.weight for r in p) == pytest.approx(0.5, abs=1e-6)  # one row per unordered pair


def two_clusters(n, gap):
    rng = np.random.default_rng(123)
    return np.vstack([rng.uniform(0, 0.5, size=(n // 2, 3)), gap + rng.uniform(0, 0.5, size=(n // 2, 3))])


@pytest.mark.parametrize("method,gap", [("umap", 100.0), ("tsne", 10.0), ("pca", 100.0)])
def test_projection_separates_clusters(make, method, gap):
    x = two_clusters(40, gap)
    got = coords(L.project(make(x), method, epochs=6))
    assert got.shape == (40, 3) and np.isfinite(got).all() and np.abs(got).max() <= 1
    a, b = got[:20].mean(0), got[20:].mean(0)
    assert ((a - b) ** 2).sum() > 0.1


def test_few_rows_lie_at_the_origin(make):
    assert not coords(L.project(make([[1, 2, 3], [4, 5, 6]]))).any()


def test_rows_without_vectors_lie_at_the_origin(make):
    x = [(i, v) for i, v in enumerate(two_clusters(8, 5.0).tolist())] + [(99, None)]
    got = {r.id: (r.x, r.y, r.z) for r in L.project_collection(Collection(make(x)), "pca").collect()}
    assert len(got) == 9 and got[99] == (0.0, 0.0, 0.0)


def test_first_sample(spark):
    df = spark.range(7000)
    sample = L.first_sample(df, 7000)
    assert sample.count() == pytest.approx(2100, rel=0.1)
    assert L.first_sample(df, 100) is None
    assert L.first_sample(df, 100, 0.5).count() == pytest.approx(3500, rel=0.1)


def test_stored_projection(make, spark, tmp_path):
    c = Collection(make(two_clusters(8, 5.0)), name="c")
    calls = []

    def compute():
        calls.append(1)
        return L.project(c.vectors(), "pca")

    first = projection(c, str(tmp_path / "p"), "pca", compute, min_dist=0.1)
    again = projection(c, str(tmp_path / "p"), "pca", compute, min_dist=0.1)
    assert len(calls) == 1 and np.allclose(coords(first), coords(again))
    other = c.with_df(c.df.where("id > 0"))
    assert projection_key(other, "pca") != projection_key(c, "pca")
    projection(other, str(tmp_path / "p"), "pca", lambda: L.project(other.vectors(), "pca"), min_dist=0.1)
    assert projection(c, str(tmp_path / "p"), "pca", compute, min_dist=0.1).count() == 8


def test_m8_layout_runs_all_epochs_of_its_size(spark, monkeypatch):
    assert _epochs_run(spark, monkeypatch, "m8_layout") == (500, L.epochs_for(500))


@pytest.mark.parametrize("method", ["umap", "tsne"])
def test_blocks_exchange_positions(make, monkeypatch, method):
    """Several blocks, linked with each other, in several rounds: every point is laid out, near those it is near to."""
    monkeypatch.setattr(rounds, "ONE_BLOCK", 20)
    monkeypatch.setattr(L, "TSNE_BLOCK", 20)
    x = np.concatenate([two_clusters(60, 10.0)[i::2] for i in (0, 1)])
    options = {} if method == "umap" else {"learning_rate": 2.0, "perplexity": 5.0}
    got = coords(L.project(make([(f"p{i:02d}", v) for i, v in enumerate(x.tolist())], kind="string"), method, epochs=12, **options))
    assert rounds.blocks_of(60) == 3 and got.shape == (60, 3) and np.isfinite(got).all()
    far = ((got[:, None] - got[None]) ** 2).sum(2)
    own = np.array([0] * 15 + [1] * 15 + [0] * 15 + [1] * 15)
    np.fill_diagonal(far, np.inf)
    assert (own[far.argmin(1)] == own).mean() > 0.9


def test_blocks_in_step_agree_with_one_block(make, monkeypatch):
    x = np.random.default_rng(5).normal(size=(60, 4))
    one = coords(L.tsne_layout(make(x), 60, 8.0, 1.0, 3))
    monkeypatch.setattr(rounds, "ONE_BLOCK", 20)
    monkeypatch.setattr(L, "TSNE_BLOCK", 20)
    monkeypatch.setattr(L, "STALE_ITERATIONS", 1)
    assert np.allclose(coords(L.tsne_layout(make(x), 60, 8.0, 1.0, 3)), one, atol=0.02 * np.abs(one).max())


def _epochs_run(spark, monkeypatch, name):
    from catalog.spark_queries import QUERIES

    seen = []
    monkeypatch.setattr(rounds, "run", lambda at, graph, n, epochs, *more, **options: seen.append((n, epochs)) or at)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 500
    return seen[0]


def test_m9_tsne_layout_runs_all_iterations_of_its_size(spark, monkeypatch):
    assert _epochs_run(spark, monkeypatch, "m9_tsne_layout") == (500, L.iterations_for(500))


@pytest.mark.parametrize("n", [1, 2, 256, 257, 600])
def test_sums_over_all_pairs_by_tiles(n):
    p = np.random.default_rng(n).normal(size=(n, 3)) * 3 + 100
    diff = p[:, None] - p[None]
    q = 1 / (1 + (diff**2).sum(2))
    total, near = rounds.all_pairs(p)
    assert np.allclose(total, ((q**2)[:, :, None] * diff).sum(1), atol=1e-9) and np.allclose(near, q.sum(1) - 1, atol=1e-9)
