"""Stored layouts and projections: files opened, ranges, atomic publishing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.sources import layouts, projections
from embedlens.sources.collections import Collection


def points(spark, n, seed=1, kind="long"):
    p = np.random.default_rng(seed).random((n, 3))
    ids = np.random.default_rng(seed).permutation(n) * 3
    rows = [(f"k{i:06d}" if kind == "string" else int(i), *map(float, q)) for i, q in zip(ids, p)]
    return spark.createDataFrame(rows, f"id {kind}, x double, y double, z double").repartition(5)


def opened(df):
    return len(df.inputFiles())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pages_open_a_fixed_number_of_files(spark, tmp_path, kind):
    counts = []
    for n in (400, 1600):
        rows, path = points(spark, n, kind=kind), str(tmp_path / f"{kind}{n}")
        layouts.publish(rows, path, file_rows=50)
        store = layouts.Layout.open(spark, path)
        assert sum(f.n for f in store.files) == n and len(store.files) >= n // 60
        ids = sorted(r.id for r in rows.collect())
        cursor = ids[n // 2]
        after, page = store.page_after(40, cursor), store.page(40, n // 2 + 1)
        assert [r.id for r in after.collect()] == [r.id for r in page.collect()] == ids[n // 2 + 1 : n // 2 + 41]
        counts.append((opened(after), opened(page)))
        assert [r.id for r in store.page_after(5).collect()] == ids[:5]
        assert [r.id for r in store.page(40, n - 10).collect()] == ids[-10:]
        assert store.page(5, n + 7).count() == 0 and store.page_after(5, ids[-1]).count() == 0
    assert max(max(c) for c in counts) <= 4


def test_boxes_open_files_that_meet_them(spark, tmp_path):
    rows = points(spark, 2000)
    layouts.publish(rows, str(tmp_path), "space", 50)
    store = layouts.Layout.open(spark, str(tmp_path))
    low, high = (0.2, 0.3, 0.4), (0.35, 0.45, 0.55)
    box = store.box(low, high)
    want = {r.id for r in rows.collect() if all(lo <= r[a] <= h for a, lo, h in zip("xyz", low, high))}
    assert {r.id for r in box.collect()} == want and want
    assert opened(box) < len(store.files) / 3
    assert store.box((5, 5, 5), (6, 6, 6)).count() == 0


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        layouts.Layout.open(spark, path)
    layouts.publish(points(spark, 60), path, file_rows=20)
    bad = points(spark, 90, 2).withColumn("x", F.when(F.col("id") == 30, F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        layouts.publish(bad, path, file_rows=20)
    store = layouts.Layout.open(spark, path)
    assert sum(f.n for f in store.files) == 60 and store.page(100).count() == 60
    layouts.publish(points(spark, 90, 2), path, file_rows=20)
    assert layouts.Layout.open(spark, path).page(100).count() == 90
    assert store.page(100).count() == 60  # an open reader keeps its version


def test_an_empty_layout_and_projection(spark, tmp_path):
    layouts.publish(points(spark, 5).limit(0), f"{tmp_path}/a")
    store = layouts.Layout.open(spark, f"{tmp_path}/a")
    assert store.page(5).count() == 0 and store.page_after(5, 1).count() == 0 and store.box((0, 0, 0), (1, 1, 1)).count() == 0
    coll = Collection.of(spark.createDataFrame([], "id long, vector array<double>"), "id", "vector")
    calls = []
    for _ in range(2):
        found = projections.projection(coll, f"{tmp_path}/b", "flat", lambda: calls.append(1) or points(spark, 5).limit(0))
        assert found.count() == 0
    assert len(calls) == 1  # an empty projection is stored as well


def test_a_projection_that_fails_is_not_seen(spark, tmp_path):
    coll = Collection.of(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), "id", "vector")
    bad = points(spark, 5).withColumn("x", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        projections.projection(coll, str(tmp_path), "flat", lambda: bad)
    key = projections.projection_key(coll, "flat")
    assert projections.stored_projection(spark, str(tmp_path), key) is None
    assert projections.projection(coll, str(tmp_path), "flat", lambda: points(spark, 5)).count() == 5
