"""Clusters of vectors: deterministic k-means, cluster quality, outliers, density, anomalies.

The driver holds the k centroids only (k is at most a few dozen). A pass over the vectors sums rows
per cluster inside each task, so k rows per task are shuffled, not one row per record or cell.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.functions import vectors as V
from embedlens.operators.pairs import Plan, block_tasks, cluster_distances, ids_of, knn, matrix, result_schema, sides_of, to_cells
from embedlens.sources.collections import Collection

OUTLIER_THRESHOLD = 2.5  # fixed value: standard deviations
DENSITY_NEIGHBORS = 5  # fixed value
CENTRALITY = 3  # fixed value: centroids near a row that is too central


def auto_k(n: int, most: int = 20) -> int:
    """Default number of clusters: floor(sqrt(n/2)) within 2..most."""
    return max(2, min(most, int(sqrt(n / 2.0))))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centroids], axis=1)


@dataclass(frozen=True)
class Clustering:
    centroids: np.ndarray
    iterations: int
    basis: np.ndarray | None = None  # centroids of the last assignment, when iterations ran out

    @property
    def k(self) -> int:
        return len(self.centroids)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``(id, vector, cluster, dist)``: nearest centroid, ties to the lowest number."""
        centroids = self.centroids
        basis = centroids if self.basis is None else self.basis
        kind = vectors.schema["id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch["vector"])
                d = _distances(x, centroids)
                at = (d if basis is centroids else _distances(x, basis)).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["vector"], pa.array(at.astype("int32")), pa.array(d[np.arange(len(d)), at])],
                    ["id", "vector", "cluster", "dist"],
                )

        return vectors.select("id", "vector").mapInArrow(run, f"id {kind}, vector array<double>, cluster int, dist double")

    def frame(self, df: DataFrame) -> DataFrame:
        """``(cluster, centroid)``, k rows."""
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        return df.sparkSession.createDataFrame(rows, "cluster int, centroid array<double>")


def kmeans(vectors: DataFrame, k: int, max_iterations: int = 50) -> Clustering:
    """Lloyd's algorithm from the row of smallest id and then the farthest rows; no random state.

    Stops when no row changes its cluster. An empty cluster keeps its centroid. With fewer than k
    rows every row is its own centroid and the rest are zero.
    """
    vectors = vectors.select("id", "vector")
    first = vectors.orderBy("id").limit(k).toArrow()
    rows = matrix(first["vector"]).astype(float)
    if len(rows) < k:
        pad = np.zeros((k - len(rows), rows.shape[1]))
        return Clustering(np.vstack([rows, pad]), 0)
    centroids = rows[:1]
    while len(centroids) < k:
        far = _farthest(vectors, centroids)
        # nothing lies away from the centroids: repeat the first row
        centroids = np.vstack([centroids, rows[:1] if far is None else far])
    previous = None
    for i in range(max_iterations):
        sums, counts, changed = _pass(vectors, centroids, previous)
        if changed == 0:
            return Clustering(centroids, i)
        previous = centroids
        full = counts > 0
        centroids = np.where(full[:, None], sums / np.maximum(counts, 1)[:, None], centroids)
    return Clustering(centroids, max_iterations, previous)


def _farthest(vectors: DataFrame, centroids: np.ndarray):
    """The row farthest from its nearest centroid, smallest id first; each task offers one row."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(matrix(batch["vector"]), centroids).min(1)
            top = np.nonzero(d == d.max())[0]
            ids = batch["id"].take(pa.array(top)).to_pylist()
            j = min(range(len(top)), key=lambda i: ids[i])
            if best is None or (-d[top[j]], ids[j]) < best[0]:
                best = ((-d[top[j]], ids[j]), batch.slice(int(top[j]), 1))
        if best is not None:
            row = best[1]
            yield pa.RecordBatch.from_arrays([row["id"], row["vector"], pa.array([-best[0][0]])], ["id", "vector", "d"])

    offers = vectors.mapInArrow(run, f"id {kind}, vector array<double>, d double")
    found = offers.orderBy(F.desc("d"), "id").limit(1).collect()
    return None if not found or found[0].d <= 0 else np.array([found[0].vector])


def _pass(vectors: DataFrame, centroids: np.ndarray, previous: np.ndarray | None):
    """Sums and sizes of the clusters and the number of rows that changed cluster."""
    k = len(centroids)

    def run(batches):
        sums, counts, changed = np.zeros(centroids.shape), np.zeros(k), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["vector"])
            at = _distances(x, centroids).argmin(1)
            before = np.zeros(len(x), int) if previous is None else _distances(x, previous).argmin(1)
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=k)
            changed += np.bincount(at[at != before], minlength=k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype="int32")), pa.array(list(sums)), pa.array(counts), pa.array(changed)],
            ["cluster", "sums", "n", "changed"],
        )

    part = vectors.mapInArrow(run, "cluster int, sums array<double>, n double, changed double")
    cells = part.select("cluster", F.posexplode("sums").alias("d", "s"), "n", "changed")
    total = cells.groupBy("cluster", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("changed").alias("c"))
    sums, counts, changed = np.zeros(centroids.shape), np.zeros(k), 0
    for r in total.collect():  # k * dims numbers
        sums[r.cluster, r.d] = r.s
        if r.d == 0:
            counts[r.cluster] = r.n
            changed += int(r.c)
    return sums, counts, changed


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """``(cluster, size)`` for clusters 0..k-1, empty ones included."""
    found = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(found, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"))


def cluster_means(assigned: DataFrame) -> DataFrame:
    """``(cluster, centroid)`` of any assignment column."""
    cells = assigned.select("cluster", F.posexplode("vector").alias("d", "x"))
    per_dim = cells.groupBy("cluster", "d").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda c: c["x"])
    return per_dim.groupBy("cluster").agg(ordered.alias("centroid"))


def with_centroid_distance(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds ``dist``, the distance to the row's own centroid."""
    joined = assigned.drop("dist").join(centroids, "cluster")
    return joined.withColumn("dist", V.euclidean(F.col("vector"), F.col("centroid"))).drop("centroid")


def silhouette(assigned: DataFrame, singleton_zero: bool = False) -> DataFrame:
    """``(silhouette)``: mean Euclidean silhouette over ``id, vector, cluster``.

    a = mean distance inside the own cluster (0 when alone), b = smallest mean distance to another
    cluster. ``singleton_zero`` gives lone rows 0, the usual convention, in place of 1.
    """
    per_row = cluster_distances(assigned)
    a, b = F.coalesce("inner", F.lit(0.0)), F.col("outer")
    top = F.greatest(a, b)
    # without another cluster b is infinite and the score tends to 1
    score = F.when(b.isNull(), 1.0).when(top > 0, (b - a) / top).otherwise(0.0)
    if singleton_zero:
        score = F.when(F.col("inner").isNull(), 0.0).otherwise(score)
    return per_row.agg(F.avg(score).alias("silhouette"))


def silhouette_squared(assigned: DataFrame) -> DataFrame:
    """Linear-time silhouette with squared Euclidean distance, for collections too large to compare
    all pairs. It is a different number from ``silhouette``; ask for it by name."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ready = assigned.select(array_to_vector("vector").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    score = ClusteringEvaluator(metricName="silhouette").evaluate(ready)
    return assigned.sparkSession.createDataFrame([(score,)], "silhouette_squared double")


def davies_bouldin(assigned: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """``(davies_bouldin)``: mean over k clusters of the worst (s_i + s_j) / d_ij; centroids at
    distance zero are skipped."""
    spread = with_centroid_distance(assigned, centroids).groupBy("cluster").agg(F.avg("dist").alias("s"))
    rows = centroids.join(spread, "cluster", "left").select(
        F.col("cluster").alias("id"), F.col("centroid").alias("vector"), F.coalesce("s", F.lit(0.0)).alias("s")
    )
    return _worst_ratio(rows, k).agg((F.coalesce(F.sum("r"), F.lit(0.0)) / k).alias("davies_bouldin"))


def _worst_ratio(rows: DataFrame, k: int) -> DataFrame:
    """``(id, r)``: largest (s_i + s_j) / d_ij of each centroid, over block tasks of centroids."""
    kind = rows.schema["id"].dataType.simpleString()
    fields = result_schema(rows, ["id"], [("r", pa.float64())])

    def kernel(key, table):
        left, right, _ = sides_of(key, table)
        a, b = matrix(left["vector"]), matrix(right["vector"])
        if not len(a) or not len(b):
            return
        d = _distances(a, b)
        pair = left["s"].to_numpy()[:, None] + right["s"].to_numpy()[None, :]
        ratio = np.divide(pair, d, out=np.zeros(d.shape), where=d > 0)
        ids = np.concatenate([ids_of(left["id"]), ids_of(right["id"])])
        best = np.concatenate([ratio.max(1), ratio.max(0)])
        yield pa.table([pa.array(ids), pa.array(best)], names=fields.names).cast(fields)

    p = Plan(k, 1, 512, most_rows=512)
    tasks = block_tasks(to_cells(rows, p), p, kernel, f"id {kind}, r double", False)
    return tasks.groupBy("id").agg(F.max("r").alias("r"))


def outliers(assigned: DataFrame, threshold: float = OUTLIER_THRESHOLD) -> DataFrame:
    """``(id, distance_to_cluster, outlier_score)`` beyond mean + threshold * std of all distances, greatest score first."""
    stats = assigned.agg(F.avg("dist").alias("m"), F.stddev_pop("dist").alias("s")).first()
    if stats.m is None:
        return assigned.select("id", F.col("dist").alias("distance_to_cluster"), F.lit(0.0).alias("outlier_score")).limit(0)
    score = F.try_divide(F.col("dist") - stats.m, F.lit(stats.s))
    return assigned.where(F.col("dist") > F.lit(stats.m + threshold * stats.s)).select(
        "id", F.col("dist").alias("distance_to_cluster"), score.alias("outlier_score")
    ).orderBy(F.desc("outlier_score"), "id")


def local_density(vectors: DataFrame, k: int = DENSITY_NEIGHBORS) -> DataFrame:
    """``(id, density)``: inverse mean distance of the k nearest rows, 1 where that mean is 0."""
    mean = knn(vectors, k).groupBy(F.col("src").alias("id")).agg(F.avg("dist").alias("d"))
    return mean.select("id", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0).alias("density"))


def density_stats(density: DataFrame) -> DataFrame:
    """Mean, std and the numbers of rows below mean - std and above mean + std; zeros under 10 rows."""
    s = density.agg(F.count(F.lit(1)).alias("n"), F.avg("density").alias("m"), F.stddev_pop("density").alias("s")).first()
    if s.n < 10:
        s_m, s_s = 0.0, 0.0
        low = high = F.lit(False)
    else:
        s_m, s_s = s.m, s.s
        low, high = F.col("density") < F.lit(s_m - s_s), F.col("density") > F.lit(s_m + s_s)
    return density.agg(F.count_if(low).alias("sparse_region_count"), F.count_if(high).alias("dense_region_count")).select(
        F.lit(s_m).alias("mean_density"), F.lit(s_s).alias("std_density"), "sparse_region_count", "dense_region_count"
    )


def proximity_threshold(centroids: np.ndarray) -> float:
    """Half the median (upper of the middle two) distance between centroids."""
    k = len(centroids)
    d = sorted(float(np.sqrt(((centroids[i] - centroids[j]) ** 2).sum())) for i in range(k) for j in range(i + 1, k))
    return (d[len(d) // 2] if d else 1.0) * 0.5


def nearby_centroids(vectors: DataFrame, centroids: np.ndarray, radius: float) -> DataFrame:
    """``(id, nearby)``: centroids closer than ``radius``."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (_distances(matrix(batch["vector"]), centroids) < radius).sum(1)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(near.astype("int32"))], ["id", "nearby"])

    return vectors.select("id", "vector").mapInArrow(run, f"id {kind}, nearby int")


def anomaly_scores(
    coll: Collection, centroids: np.ndarray, centrality: int = CENTRALITY, radius: float | None = None
) -> DataFrame:
    """``(id, anomaly_score, reasons)`` of rows with at least one sign of poisoning.

    Signs: near many centroids, at most one filled field, sparse surroundings although near two or
    more centroids, a norm over three standard deviations off.
    """
    vectors = coll.vectors()
    radius = proximity_threshold(centroids) if radius is None else radius
    density = local_density(vectors)
    facts = coll.df.where("vector IS NOT NULL").select(
        "id", coll.filled_count().alias("filled"), V.norm(F.col("vector")).alias("norm")
    )
    rows = facts.join(nearby_centroids(vectors, centroids, radius), "id").join(density, "id").persist()
    s = rows.agg(
        F.avg("norm").alias("nm"), F.stddev_pop("norm").alias("ns"),
        F.avg("density").alias("dm"), F.stddev_pop("density").alias("ds"),
    ).first()
    if s.nm is None:
        return rows.select("id", F.lit(0.0).alias("anomaly_score"), F.array().cast("array<string>").alias("reasons")).limit(0)
    signs: list[tuple[str, float, Column]] = [  # fixed values: names and weights
        ("high_centrality", 0.4, F.col("nearby") >= centrality),
        ("sparse_metadata", 0.2, F.col("filled") <= 1),
        ("isolated_but_central", 0.3, (F.col("nearby") >= 2) & (F.col("density") < F.lit(s.dm - s.ds))),
        ("abnormal_norm", 0.3, F.abs(F.col("norm") - s.nm) > F.lit(3.0 * s.ns)),
    ]
    score = F.lit(0.0)
    for _, weight, test in signs:
        score = score + F.when(test, weight).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, _, test in signs]))
    return rows.select("id", F.least(score, F.lit(1.0)).alias("anomaly_score"), reasons.alias("reasons")).where(F.size("reasons") > 0)


@dataclass(frozen=True)
class NormGroups:
    """1-D k-means with two centres on vector norms."""

    low: float
    high: float

    def group_of(self, norm: Column) -> Column:
        # the first centre wins ties
        return F.when(F.abs(norm - self.low) <= F.abs(norm - self.high), 0).otherwise(1)


def norm_groups(norms: DataFrame, column: str = "norm", max_iterations: int = 50) -> NormGroups:
    """Two centres from the smallest and largest norm; one small aggregate per iteration."""
    span = norms.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    now, before = NormGroups(span.lo, span.hi), None
    for _ in range(max_iterations):
        g = now.group_of(F.col(column))
        old = F.lit(0) if before is None else before.group_of(F.col(column))
        s = norms.agg(
            F.avg(F.when(g == 0, F.col(column))).alias("lo"),
            F.avg(F.when(g == 1, F.col(column))).alias("hi"),
            F.count_if(g != old).alias("changed"),
        ).first()
        if not s.changed:
            break
        before, now = now, NormGroups(now.low if s.lo is None else s.lo, now.high if s.hi is None else s.hi)
    return now


def norm_group_stats(norms: DataFrame, groups: NormGroups | None, column: str = "norm") -> DataFrame:
    """``(group_id, count, mean_norm, std_norm, sample_ids)``; one group when ``groups`` is None."""
    g = F.lit(0) if groups is None else groups.group_of(F.col(column))
    tagged = norms.withColumn("group_id", g)
    stats = tagged.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("count"), F.avg(column).alias("mean_norm"), F.stddev_pop(column).alias("std_norm")
    )
    return stats.join(first_ids(tagged, "group_id"), "group_id")


def first_ids(rows: DataFrame, key: str, order: tuple = ("id",), k: int = 5) -> DataFrame:
    """``(key, sample_ids)``: the first k ids of each group, joined by ``;``. The limit applies in
    every task before the shuffle, so a large group costs k rows per task."""
    from embedlens.operators.pairs import best_k

    top = best_k(rows.select(key, *dict.fromkeys([*order, "id"])), k, key, order)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"].cast("string"))
    return top.groupBy(key).agg(F.array_join(listed, ";").alias("sample_ids"))
