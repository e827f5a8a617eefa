import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.operators import clusters as C
from embedlens.plans import reports as R
from embedlens.sources.collections import Collection


def blobs(n=90, dims=4, k=3, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, dims)) * 10
    at = np.arange(n) % k
    return centers[at] + rng.normal(size=(n, dims)), at


def reference_kmeans(x, k, iterations):
    c = [x[0]]
    for _ in range(1, k):
        d = np.min([np.sqrt(((x - m) ** 2).sum(1)) for m in c], axis=0)
        c.append(x[int(d.argmax())])
    c, at = np.array(c), np.zeros(len(x), int)
    for _ in range(iterations):
        new = np.stack([np.sqrt(((x - m) ** 2).sum(1)) for m in c], 1).argmin(1)
        if (new == at).all():
            break
        at = new
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
    return c, at


@pytest.mark.parametrize("k,iterations", [(3, 50), (5, 50), (6, 2)])
def test_kmeans(make, k, iterations):
    x, _ = blobs(seed=4)
    found = C.kmeans(make(x), k, iterations)
    c, at = reference_kmeans(x, k, iterations)
    assert found.centroids == pytest.approx(c)
    assert {r.id: r.cluster for r in found.assign(make(x)).collect()} == dict(enumerate(at.tolist()))


def test_kmeans_of_fewer_rows_than_clusters(make):
    found = C.kmeans(make([[1, 1], [2, 2]]), 4)
    assert found.centroids.tolist() == [[1, 1], [2, 2], [0, 0], [0, 0]]


def test_kmeans_of_equal_rows(make):
    found = C.kmeans(make([[1, 1]] * 6), 3)
    assert {r.cluster for r in found.assign(make([[1, 1]] * 6)).collect()} == {0}


def silhouette(x, at):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = (at == at[i]) & (np.arange(len(x)) != i)
        a = d[i][own].mean() if own.any() else 0.0
        b = min((d[i][at == c].mean() for c in set(at) if c != at[i]), default=np.inf)
        s.append(1.0 if np.isinf(b) else (b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def assigned(make, spark, x, at):
    c = spark.createDataFrame([(i, int(v)) for i, v in enumerate(at)], "id bigint, cluster int")
    return make(x).join(c, "id")


@pytest.mark.parametrize("block", [None, 2000])
def test_silhouette(make, spark, block, monkeypatch):
    x, at = blobs()
    at = at.copy()
    at[5] = 7  # a cluster of one
    df = assigned(make, spark, x, at)
    assert C.silhouette(df).first()[0] == pytest.approx(silhouette(x, at))
    rows = C.cluster_distances(df, block or 1 << 26).collect()
    assert len(rows) == len(x)  # one row per record, however many blocks
    for r in rows:
        d, own = np.sqrt(((x - x[r.id]) ** 2).sum(1)), at == at[r.id]
        others = [d[at == c].mean() for c in set(at) if c != at[r.id]]
        assert r.outer == pytest.approx(min(others)) and r.cluster == at[r.id]
        assert r.inner is None if own.sum() == 1 else r.inner == pytest.approx(d[own].sum() / (own.sum() - 1))


def test_silhouette_of_copies_and_one_cluster(make, spark):
    x = np.repeat(np.random.default_rng(1).normal(size=(7, 3)), 5, axis=0)
    at = np.arange(35) // 5 % 3
    assert C.silhouette(assigned(make, spark, x, at)).first()[0] == pytest.approx(silhouette(x, at))
    one = C.cluster_distances(assigned(make, spark, x, at * 0)).collect()
    assert len(one) == 35 and all(r.outer is None and r.inner is not None for r in one)
    assert C.cluster_distances(assigned(make, spark, x, at).where("1 = 0")).count() == 0


def test_davies_bouldin_skips_equal_centroids(make, spark):
    df = assigned(make, spark, [[0, 0], [0, 0], [4, 0], [4, 2]], [0, 1, 2, 2])
    got = C.davies_bouldin(df, C.cluster_means(df), 3).first()[0]
    d = np.sqrt(17)
    assert got == pytest.approx((1 / d + 1 / d + 1 / d) / 3)


def test_outliers_and_sizes(make, spark):
    x, at = blobs()
    x[0] += 100
    df = C.with_centroid_distance(assigned(make, spark, x, at), C.cluster_means(assigned(make, spark, x, at)))
    found = C.outliers(df).collect()
    assert [r.id for r in found] == [0] and found[0].outlier_score > 2.5
    assert [r["size"] for r in C.cluster_sizes(df, 5).orderBy("cluster").collect()] == [30, 30, 30, 0, 0]


def test_density_needs_ten_rows(make):
    few = C.density_stats(C.local_density(make(blobs(9)[0]))).first()
    assert tuple(few) == (0.0, 0.0, 0, 0)
    copies = C.local_density(make([[1, 1]] * 8)).collect()
    assert {r.density for r in copies} == {1.0}


def test_norm_groups(make, spark):
    rows = spark.createDataFrame([(i, 1.0 if i % 2 else 3.0) for i in range(20)], "id bigint, norm double")
    got = C.norm_group_stats(rows, C.norm_groups(rows)).orderBy("group_id").collect()
    assert [(r["count"], r.mean_norm, r.sample_ids) for r in got] == [(10, 1.0, "1;3;5;7;9"), (10, 3.0, "0;2;4;6;8")]


def test_fingerprint_of_one_and_two_models(make, spark):
    rng = np.random.default_rng(0)
    one = rng.normal(size=(60, 8))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two = one * np.where(np.arange(60) % 2, 1.0, 3.0)[:, None]
    f = R.fingerprint(Collection(make(two)), digits=6)
    assert f.groups.count() == 2 and f.summary.first().multi_model_confidence == pytest.approx((1 / (-2 + 3 * 59**2 / (58 * 57)) - 0.555) / 0.445)
    f = R.fingerprint(Collection(make(one)), digits=6)
    assert f.groups.count() == 1 and f.histogram.count() == 1
    empty = R.fingerprint(Collection(make([None])))
    assert empty.summary.first().n == 0 and empty.histogram.count() == 0 and empty.groups.count() == 0


def test_anomalies(make, spark):
    x, _ = blobs(60)
    x[7] *= 40
    df = make(x).withColumn("a", F.lit("x")).withColumn("b", F.when(F.col("id") == 9, F.lit(" ")).otherwise(F.lit("y")))
    got = {r.id: r for r in R.anomalies(Collection(df, ("a", "b"))).collect()}
    assert "abnormal_norm" in got[7].reasons and list(got[9].reasons) == ["sparse_metadata"] and got[9].anomaly_score == 0.2
    assert R.anomalies(Collection(make(x[:9]), ())).count() == 0


def test_distance_health(make):
    x, _ = blobs(60, 8)
    row = R.distance_health(Collection(make(x))).summary.first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(60, 1)]
    assert row.discrimination_score == pytest.approx((d.max() - d.min()) / d.mean() / 2)
    assert row.samples_tested == 50 and row.recall_at_k == 1.0 and row.overall == "healthy" and row.actual_dims == 8
    few = R.distance_health(Collection(make([[1, 2]]))).summary.first()
    assert few.overall == "insufficient_data"


def test_distribution_report(make):
    x, _ = blobs(60)
    d = R.distribution(Collection(make(x)), k=3)
    row = d.metrics.first()
    assert row.cluster_count == 3 and row.silhouette > 0.5 and sum(r["size"] for r in d.sizes.collect()) == 60
    fast = R.distribution(Collection(make(x)), k=3, exact_silhouette=False).metrics.first()
    assert fast.silhouette_squared > 0.5


@pytest.mark.parametrize("n,k", [(2, 2), (50, 5), (10_000, 20)])
def test_auto_k(n, k):
    assert C.auto_k(n) == k
