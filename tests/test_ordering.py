import numpy as np
import pytest

from embedlens.operators import ordering as O


@pytest.mark.parametrize("n", [1, 2, 4, 1000])
def test_percentiles_are_order_statistics(spark, n):
    v = np.random.default_rng(n).normal(size=n) * 1e6
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 0.99]
    assert O.percentiles(df, "v", shares) == [np.sort(v)[min(int(p * n), n - 1)] for p in shares]


def test_percentiles_of_ties_and_wide_ranges(spark):
    v = [5.0] * 400 + [1e-300, 1e300, -1e300, 7.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert O.value_at_ranks(df, "v", [0, 1, 2, 200, 402, 403]) == [-1e300, 1e-300, 5.0, 5.0, 7.0, 1e300]


def test_median_takes_the_upper_middle(spark):
    assert O.percentiles(spark.range(1, 5), "id", [0.5]) == [3.0]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ordinals(spark, parts):
    ids = np.random.default_rng(1).permutation(500) * 3
    df = spark.createDataFrame([(int(i),) for i in ids], "id bigint").repartition(parts)
    got = {r.id: r.ordinal for r in O.with_ordinal(df, "id").collect()}
    assert got == {i * 3: i for i in range(500)}
    assert O.with_ordinal(df.limit(0), "id").count() == 0


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0.5, 1, 9.99, 10)], "v double")
    rows = O.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [3, 0, 0, 0, 2] and rows[0]["min"] == 0 and rows[4]["max"] == 10
    flat = O.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 5).collect()
    assert [tuple(r) for r in flat] == [(0, 2.0, 2.0, 3)]
    assert O.histogram(df.limit(0), "v", 5).count() == 0


def test_moments_and_bimodality(spark):
    v = [1.0] * 50 + [2.0] * 50
    m = O.moments(spark.createDataFrame([(x,) for x in v], "v double"), "v")
    row = m.select("skewness", "kurtosis", O.bimodality(m["skewness"], m["kurtosis"], m["n"]).alias("bc")).first()
    want = (0 + 1) / (-2 + 3.0 * 99**2 / (98 * 97))
    assert row.skewness == pytest.approx(0) and row.kurtosis == pytest.approx(-2) and row.bc == pytest.approx(want)


@pytest.mark.parametrize("v,want", [([1.0], 1.0), ([1.0, 2.0], 0.0), ([1.0, 2.0, 3.0], 0.0), ([2.0] * 5, 1 / (48 / 6))])
def test_bimodality_of_few_rows(spark, v, want):
    m = O.moments(spark.createDataFrame([(x,) for x in v], "v double"), "v")
    assert m.select(O.bimodality(m["skewness"], m["kurtosis"], m["n"])).first()[0] == pytest.approx(want)


def test_effective_dimensions(make):
    x = np.random.default_rng(0).normal(size=(200, 4)) * np.array([10, 3, 0.1, 0.0])
    dims = O.dimension_stats(make(x))
    row = O.effective_dimensions(dims).first()
    var = np.sort(x.var(0))[::-1]
    assert row.actual_dims == 4 and row.effective_dims == int(np.searchsorted(np.cumsum(var), 0.9 * var.sum()) + 1)
    flat = O.effective_dimensions(O.dimension_stats(make([[1, 1]] * 3))).first()
    assert flat.effective_dims == 0
    assert sum(r.variance_ratio for r in dims.collect()) == pytest.approx(1)


def test_running_totals_and_runs_over_range_partitions(spark):
    import random

    from embedlens.operators import ordering

    rng = random.Random(3)
    keys = sorted(rng.sample(range(4000), 500))
    rows = [(k, rng.randrange(1, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    total, want = 0, {}
    for k, n in rows:
        total += n
        want[k] = total
    assert {r.k: r.upto for r in ordering.running_total(df, "k", "n").collect()} == want
    for gap in (3, 25, 10_000):
        run, last, want = 0, None, {}
        for k in keys:
            run += last is not None and k - last > gap
            want[k], last = run, k
        assert {r.k: r.run for r in ordering.gap_runs(df, "k", gap).collect()} == want
    assert ordering.running_total(df.limit(0), "k", "n").count() == 0 and ordering.gap_runs(df.limit(0), "k", 3).count() == 0
