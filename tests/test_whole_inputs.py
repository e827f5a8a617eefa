"""Data beyond bounds that earlier versions had: nothing is cut, sampled by prefix or lost."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from embedlens import Collection
from embedlens.operators import chunks, layout, ordering, pairs, staleness
from embedlens.plans import reports


def numbered(spark, n):
    return spark.range(n).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"))


def test_export_of_more_than_ten_thousand_vectors(spark, tmp_path):
    coll = Collection.of(numbered(spark, 12_000), "id", "vector", name="c")
    moment = datetime(2024, 1, 1, tzinfo=timezone.utc)
    reports.export_collection([coll], "c", "vectors", "csv", str(tmp_path / "all"), moment)
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == 12_000
    reports.export_collection([coll], "c", "vectors", "csv", str(tmp_path / "few"), moment, limit=7)
    assert spark.read.csv(str(tmp_path / "few"), header=True).count() == 7


def test_fields_are_found_in_late_rows(spark):
    late = numbered(spark, 100).withColumn("created_at", F.when(F.col("id") >= 90, "2024-01-01T00:00:00Z")).withColumn("text", F.when(F.col("id") >= 90, "words"))
    coll = Collection.of(late, "id", "vector", name="c")
    assert staleness.timestamp_field(coll) == "created_at" and chunks.content_field(coll) == "text"


def test_health_looks_at_all_distances(spark):
    """The first 20 vectors are spread out, the other thousands nearly coincide, pairwise distances don't discriminate less for it."""
    rows = spark.range(3000).select("id", F.when(F.col("id") < 20, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(5.0))).alias("vector"))
    ratio = reports._discrimination(Collection.of(rows, "id", "vector", name="c"))
    assert ratio > 0.3


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, math.inf, -math.inf, 3.0, math.nan, math.nan],
        [math.inf] * 3, [math.nan], [1e308, -1e308, 0.0, 1.7e308, -1.7e308], [5e-324, 1e-323, 0.0, 5e-324, 2e-323], [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [-0.0, 0.0],
    ],
)
def test_order_statistics_of_any_doubles(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    got = ordering.value_at_ranks(frame, "v", list(range(len(values))))
    want = sorted((v for v in values if not math.isnan(v))) + [math.nan] * sum(map(math.isnan, values))
    assert [repr(abs(g)) if g == 0 else repr(g) for g in got] == [repr(abs(w)) if w == 0 else repr(w) for w in want]


def test_unequal_widths_are_refused(spark, make):
    import pyarrow as pa

    with pytest.raises(ValueError, match="one width at a time"):
        pairs.matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]))
    with pytest.raises(ValueError, match="one width at a time"):
        layout.project(make([[1.0, 2.0], [1.0], [2.0, 1.0], [0.0, 1.0]]))
