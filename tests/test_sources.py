from datetime import datetime, timezone

import pytest

from embedlens.plans import reports as R
from embedlens.sources import collections as S
from embedlens.sources import export

AS_OF = datetime(2024, 6, 1, 12, 30, 5, tzinfo=timezone.utc)


@pytest.fixture()
def coll(spark):
    rows = [(i, None if i == 3 else [float(i), 1.0], t) for i, t in enumerate(['plain', 'with, comma', 'with "quotes"', 'two\nlines', ''])]
    return S.Collection(spark.createDataFrame(rows, "id bigint, vector array<double>, text string"), ("text",), "small")


def test_pages(spark):
    df = spark.range(25)
    assert [r.id for r in S.page(df, 5, 20).collect()] == [20, 21, 22, 23, 24]
    seen, cursor = [], None
    while True:
        page = S.page_after(df, 10, cursor)
        seen += [r.id for r in page.collect()]
        cursor = S.next_cursor(page, 10).first().next_cursor
        if cursor is None:
            break
    assert seen == list(range(25))


def test_keyset_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    plan = S.page_after(spark.read.parquet(str(tmp_path / "t")), 5, 50)._jdf.queryExecution().toString()
    assert "GreaterThan(id,50)" in plan


def test_vectors_do_not_read_metadata(spark, coll, tmp_path):
    coll.df.write.parquet(str(tmp_path / "c"))
    c = coll.with_df(spark.read.parquet(str(tmp_path / "c")))
    plan = R.norms(c)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,vector:array<double>>" in plan


def test_info(spark, coll):
    row = S.collection_info([coll]).first()
    assert (row.name, row["count"], row.vector_dimensions, row.properties) == ("small", 5, 2, ["text"])
    with pytest.raises(KeyError):
        S.find_collection([coll], "other")
    assert S.vector_widths(coll).count() == 1
    assert S.Collection.of(coll.df, "id", "vector").fields == ("text",)


def test_fingerprint_ignores_order(spark, coll):
    assert S.id_fingerprint(coll.df).first() == S.id_fingerprint(coll.df.repartition(7)).first()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_files(spark, coll, tmp_path, fmt):
    rows = export.vector_rows(coll, include_vectors=True)
    path = str(tmp_path / "out")
    export.write(rows, path, fmt)
    if fmt == "csv":
        back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).fillna("")
    else:
        back = spark.read.json(path)
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == want
    with pytest.raises(ValueError):
        export.write(rows, path, "xml")


def test_manifest(coll):
    rows = export.vector_rows(coll)
    assert tuple(export.manifest(rows, "small", "vectors", "csv", AS_OF).first()) == ("csv", "vectors", 5, "small_vectors_20240601_123005.csv")
    assert export.manifest(rows, "*", "health_report", "json", AS_OF).first().filename == "health_report_20240601_123005.json"


def test_health(spark, coll):
    h = R.health([coll], AS_OF)
    issues = {(r.severity, r.category) for r in h.issues.collect()}
    assert issues == {("warning", "orphans"), ("error", "orphans")}
    row = h.summary.first()
    assert (row.score, row.grade, row.total_vectors) == (80, "good", 5)
    lines = export.health_rows(h.collections, h.issues, h.summary).collect()
    assert [r.collection for r in lines] == ["small", "SUMMARY"] and lines[0].issues.count(";") == 1
    sampled = R.health([coll], AS_OF, sample_rows=2)
    assert sampled.summary.first().score == 100
    assert R.health([coll.with_df(coll.df.limit(0))], AS_OF).summary.first().score == 100


def test_performance(spark):
    df = spark.range(1000).selectExpr("id", "array_repeat(0.5D, 768) vector", "'x' text")
    m = R.performance([S.Collection(df, ("text",), "test")])
    row = m.first()
    assert (row.vector_count, row.estimated_memory_bytes, row.estimated_storage_bytes, row.bytes_per_vector) == (1000, 4_808_000, 5_288_800, 4808)
    assert R.recommendations(m).count() == 0
    wide = S.Collection(spark.range(11_000).selectExpr("id", "array_repeat(0.5D, 1600) vector"), (), "wide")
    got = {r.category: r for r in R.recommendations(R.performance([wide])).collect()}
    assert set(got) == {"dimensionality", "indexing"} and got["dimensionality"].priority == "high" and "by 4x" in got["dimensionality"].potential_savings


def test_search_overlays(spark):
    hits = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "id bigint, dist double")
    got = {r.id: r.normalised for r in R.normalised_distance(hits).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None}
    same = R.normalised_distance(hits.where("id = 1")).first()
    assert same.normalised == 0.0
    xyz = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id bigint, x double, y double, z double")
    assert {r.id: r.z for r in R.attach_coordinates(hits, xyz).collect()} == {1: 3.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("kind", ["vectors", "orphans", "duplicates", "outliers", "health_report"])
def test_export_by_type(spark, coll, tmp_path, kind):
    name = "*" if kind == "health_report" else "small"
    row = R.export_collection([coll], name, kind, "json", str(tmp_path / kind), AS_OF).first()
    assert row.data_type == kind and row.filename.endswith("20240601_123005.json")
    want = {"vectors": 5, "orphans": 1, "duplicates": 0, "outliers": 0, "health_report": 1}[kind]
    assert row.record_count == want or kind in ("duplicates", "outliers")


def test_unknown_export(spark, coll, tmp_path):
    with pytest.raises(ValueError):
        R.export_collection([coll], "small", "charts", "csv", str(tmp_path / "x"), AS_OF)


def test_text_search(spark, coll):
    q = spark.createDataFrame([(1, "Quotes with"), (2, "lines, two")], "query bigint, text string")
    got = {(r.query, r.id) for r in R.search_text(coll, q, 1, "text").collect()}
    assert got == {(1, 2), (2, 3)}
