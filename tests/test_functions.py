from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from embedlens.functions import text as X
from embedlens.functions import times, values
from embedlens.functions import vectors as V
from embedlens.sources.collections import Collection, json_properties

AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("a,b,want", [([1, 0, 0], [1, 0, 0], 1.0), ([1, 0, 0], [0, 1, 0], 0.0), ([1, 0], [1, 0, 0], 0.0), ([], [], 0.0), ([0, 0], [1, 1], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert one(df.select(V.cosine(F.col("a"), F.col("b")))) == pytest.approx(want)


def test_unit_and_distance(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(V.unit(F.col("a")).alias("u"), V.unit(F.col("b")).alias("z"), V.euclidean(F.col("a"), F.col("b")).alias("d"), V.near_zero(F.col("b")).alias("n"), V.vector_text(F.col("a")).alias("t")).first()
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.d == 5.0 and row.n and row.t == "[3.0;4.0]"


def test_empty_json_values(spark):
    docs = ['{"f":null}', '{"f":" \\t"}', '{"f":[]}', '{"f":{}}', '{"f":"[]"}', "{}", '{"f":0}', '{"f":false}', '{"f":[1]}', None]
    df = spark.createDataFrame([(i, None, d) for i, d in enumerate(docs)], "id int, vector array<double>, m string")
    c = Collection.of_json(df, "m", ("f",))
    got = [r.e for r in c.df.orderBy("id").select(c.is_empty("f").alias("e")).collect()]
    assert got == [True, True, True, True, False, True, False, False, False, True]
    assert json_properties(df, "m") == ["f"]


def test_empty_typed_values(spark):
    df = spark.createDataFrame([(" 　", [], None), ("x", [1], 2)], "s string, a array<int>, n int")
    types = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[values.is_empty(F.col(c), types[c]).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False)]


@pytest.mark.parametrize(
    "text,days",
    [
        ("2024-05-31T00:00:00Z", 1.0), ("2024-05-31T02:00:00+02:00", 1.0), ("2024-05-31T12:30:00.5Z", 11 / 24), ("1717113600", 1.0),
        ("1717113600000", 1.0), ("2024-05-31", None), ("soon", None), ("2024-13-31T00:00:00Z", None), ("2024-06-01T01:30:00Z", -1 / 24),
    ],
)
def test_age_of_text(spark, text, days):
    df = spark.createDataFrame([(text,)], "t string")
    got = one(df.select(times.age_days(times.epoch_micros(F.col("t"), df.schema["t"].dataType), AS_OF)))
    assert got == (None if days is None else pytest.approx(days))


def test_age_of_numbers_and_json(spark):
    df = spark.createDataFrame([(1717113600, 1717113600.9)], "i bigint, f double")
    t = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(*[times.age_days(times.epoch_micros(F.col(c), t[c]), AS_OF).alias(c) for c in df.columns]).first()
    assert (row.i, row.f) == (1.0, 1.0)
    docs = ['{"t":1717113600}', '{"t":1717113600000}', '{"t":1717113600.5}', '{"t":"2024-05-31T00:00:00Z"}', '{"t":[1]}', '{"t":true}']
    c = Collection.of_json(spark.createDataFrame([(i, None, d) for i, d in enumerate(docs)], "id int, vector array<double>, m string"), "m", ("t",))
    ages = times.age_days(times.epoch_micros(c.field("t"), c.types["t"]), AS_OF)
    assert [r[0] for r in c.df.orderBy("id").select(ages).collect()] == [1.0, 1.0, 1.0, 1.0, None, None]


def test_seconds_only(spark):
    df = spark.createDataFrame([(1717113600000,)], "i bigint")
    got = one(df.select(times.whole_days(times.epoch_micros(F.col("i"), df.schema["i"].dataType, millis=False), AS_OF)))
    assert got < 0  # read as seconds, a date far ahead


@pytest.mark.parametrize("n,want", [(500, "500 bytes"), (1024, "1.0 KB"), (1536, "1.5 KB"), (2**20, "1.0 MB"), (2**30, "1.0 GB")])
def test_format_bytes(spark, n, want):
    assert one(spark.range(1).select(X.format_bytes(F.lit(n)))) == want


@pytest.mark.parametrize("n,want", [(100, "100"), (1000, "1,000"), (1000000, "1,000,000")])
def test_format_count(spark, n, want):
    assert one(spark.range(1).select(X.format_count(F.lit(n)))) == want


def test_boundary_and_preview(spark):
    rows = [("lower start and no end",), ("Upper start",), ("lower, closed.",), (" été 　",), ("",), ("é" * 120,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(X.broken_boundary(F.col("t")).alias("b"), X.preview(F.col("t")).alias("p"), X.byte_length(F.col("t")).alias("n")).collect()
    assert [r.b for r in got] == [True, False, False, True, False, True]
    assert got[5].p == "é" * 100 + "..." and got[5].n == 240


def overlap(a, b, share=0.8):
    longer = max(len(a), len(b))
    best = max((n for n in range(1, min(len(a), len(b)) + 1) if a[-n:] == b[:n]), default=0)
    return best if longer and best > share * longer else None


def test_overlap_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [("", "a"), ("a", "a"), ("aaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaa"), ("xaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaab")]
    for _ in range(300):
        core = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) * rng.randint(1, 4)
        rows.append(("".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) + core, core + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", X.high_overlap(F.col("a"), F.col("b"), 0.8).alias("n")).collect()
    assert [r.n for r in got] == [overlap(r.a, r.b) for r in got]
    assert sum(r.n is not None for r in got) > 50
