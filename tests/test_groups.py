"""Orphans, duplicates, contradictions, staleness and chunks."""

import random
from datetime import datetime, timedelta, timezone
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.operators import chunks, duplicates, orphans, staleness
from embedlens.operators.components import components
from embedlens.operators.contradictions import Contradictions
from embedlens.plans import reports as R
from embedlens.sources.collections import Collection

AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)
V = [0.1, 0.2, 0.3]


def docs(spark, rows, fields):
    df = spark.createDataFrame([(str(i), v, m) for i, (v, m) in enumerate(rows)], "id string, vector array<double>, m string")
    return Collection.of_json(df, "m", fields)


@pytest.mark.parametrize(
    "vector,doc,options,want",
    [
        (None, "{}", {}, ("missing_vector", ["vector"])),
        (V, '{"other":"value"}', {"required": ("title",)}, ("missing_metadata", ["title"])),
        (V, '{"text":""}', {"content": "text"}, ("empty_content", ["text"])),
        (V, '{"title":"Test","text":"Some content"}', {"required": ("title",), "content": "text"}, None),
        (V, '{"at":"2024-01-01T00:00:00Z"}', {"stale_days": 90, "timestamp": "at"}, ("stale", ["at"])),
        (V, '{"at":1704067200}', {"stale_days": 90, "timestamp": "at"}, ("stale", ["at"])),
        (V, '{"at":1704067200000}', {"stale_days": 90, "timestamp": "at"}, None),
        (V, '{"at":"2024-05-31T00:00:00Z"}', {"stale_days": 90, "timestamp": "at"}, None),
        (V, '{"other":1}', {"content": "absent"}, ("empty_content", ["absent"])),
    ],
)
def test_orphan_reasons(spark, vector, doc, options, want):
    c = docs(spark, [(vector, doc)], ("title", "text", "at", "other"))
    got = orphans.classify(c, as_of=AS_OF, **options).collect()
    assert [(r.reason, list(r.missing_fields)) for r in got] == ([want] if want else [])


def test_rows_without_metadata_object(spark):
    c = docs(spark, [(V, None)], ("title",))
    missing = F.lit(False)
    assert orphans.classify(c, required=("title",), has_metadata=missing).first().reason == "missing_metadata"
    assert orphans.classify(c, content="title", has_metadata=missing).count() == 0
    assert {r.reason: r.n for r in orphans.by_reason(orphans.classify(c, required=("title",))).collect()}["stale"] == 0


def plain(make, spark, vectors, labels=None):
    df = make(vectors)
    meta = spark.createDataFrame([(i, None if labels is None else labels[i]) for i in range(len(vectors))], "id bigint, label string")
    return Collection(df.join(meta, "id"), ("label",))


def test_exact_duplicates(make, spark):
    found = R.find_duplicates(plain(make, spark, [[4, 5, 6], [1, 2, 3], [1, 2, 3]]), near=False)
    (g,) = found.groups.collect()
    assert (g.group_id, g.kind, g["size"], g.similarity) == ("exact_1", "exact", 2, 1.0)
    assert found.totals.first().surplus == 1


def test_stages_take_turns_and_similarity_is_the_mean_over_all_pairs(make, spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 6))
    x = np.vstack([base[0], base[0], base[1] + 0.02 * rng.normal(size=(5, 6)), base[2], -base[2]])
    text = ["Same "] * 2 + [f"t{i}" for i in range(5)] + [" twin", "TWIN　"]
    found = R.find_duplicates(plain(make, spark, x, text), text_field="label")
    groups = {g.kind: g for g in found.groups.collect()}
    assert {k: (g.first_id, g["size"]) for k, g in groups.items()} == {"exact": (0, 2), "near_duplicate": (2, 5), "text_hash": (7, 2)}
    u = x[2:7] / np.linalg.norm(x[2:7], axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i, j in combinations(range(5), 2)])
    assert groups["near_duplicate"].similarity == pytest.approx(want)
    kept = duplicates.keep_first(plain(make, spark, x, text), found.members).df
    assert sorted(r.id for r in kept.select("id").collect()) == [0, 2, 7]


def test_no_stage_and_no_duplicates(make, spark):
    c = plain(make, spark, [[1, 0], [0, 1]], ["a", "b"])
    assert R.find_duplicates(c, exact=False, near=False).groups.count() == 0
    assert R.find_duplicates(c, text_field="label").groups.count() == 0


def test_member_lists_of_a_large_group_stay_bounded(spark):
    members = spark.range(2500).select(F.lit("exact").alias("kind"), F.lit(0).cast("bigint").alias("first_id"), "id")
    rows = duplicates.member_lists(members, 100).collect()
    ids = [i for r in rows for i in r.vector_ids.split(";")]
    assert len(rows) == 25 and sorted(map(int, ids)) == list(range(2500)) and max(len(r.vector_ids.split(";")) for r in rows) < 200


def brute_contradictions(x, labels, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(i, j) for i, j in combinations(range(len(x)), 2) if u[i] @ u[j] >= threshold - 1e-12 and (labels[i] or None) != (labels[j] or None)}


def test_contradictions_with_a_hot_vector(make, spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x[::3] = x[0]
    x[1::9] = x[0] * 1.5 + 0.001
    labels = [["a", "b", "", None, "a"][i % 5] for i in range(40)]
    found = Contradictions(plain(make, spark, x, labels), 0.9, 1000)
    want = brute_contradictions(x, labels, 0.9)
    assert found.total().first().contradictions == len(want)
    pairs = found.pairs(1000).collect()
    assert sum(r.row_pairs for r in pairs) == len(want)
    assert all((r.vector_a_id, r.vector_b_id) in want for r in pairs)
    top = found.pairs(3).collect()
    assert [tuple(r) for r in top] == [tuple(r) for r in pairs[:3]]


def test_zero_vectors_do_not_contradict(make, spark):
    found = Contradictions(plain(make, spark, [[0, 0], [0, 0]], ["a", "b"]))
    assert found.total().first().contradictions == 0 and not found.pairs().collect()


def aged(spark, days):
    rows = [(i, None, (AS_OF - timedelta(days=d)).strftime("%Y-%m-%dT%H:%M:%SZ")) for i, d in enumerate(days)]
    return Collection(spark.createDataFrame(rows, "id int, vector array<double>, updated_at string"), ("updated_at",))


def test_dead_zones(spark):
    days = [10, 100, 101, 102, 103, 104, 105, 140, 141, 500, 501, 502.5, 900]
    s = R.stale_records(aged(spark, days), AS_OF)
    zones = s.dead_zones.orderBy("zone").collect()
    assert [(z["count"], z.min_age_days, z.max_age_days, z.sample_ids) for z in zones] == [(6, 100, 105, "1;2;3;4;5"), (3, 500, 502.5, "9;10;11")]
    row = s.summary.first()
    assert (row.timestamp_field, row.n, row.stale_count, row.median_age_days, row.p99) == ("updated_at", 13, 12, 105, 900)
    assert sum(r["count"] for r in s.histogram.collect()) == 13


def test_staleness_without_timestamps(spark):
    c = Collection(spark.createDataFrame([(1, None, "x")], "id int, vector array<double>, title string"), ("title",))
    s = R.stale_records(c, AS_OF)
    assert s.field is None and s.summary.first().n == 0 and s.dead_zones.count() == 0 and s.histogram.count() == 0


def chunk_rows(spark, texts, ids=None, source=None):
    ids = ids or list(range(len(texts)))
    kind = "string" if isinstance(ids[0], str) else "bigint"
    rows = [(i, None, t, "s" if source is None else source[n]) for n, (i, t) in enumerate(zip(ids, texts))]
    return Collection(spark.createDataFrame(rows, f"id {kind}, vector array<double>, body string, src string").repartition(3), ("body", "src"))


@pytest.mark.parametrize("text_ids", [False, True])
def test_previous_row_across_stretches(spark, monkeypatch, text_ids):
    monkeypatch.setattr(chunks, "RUN_ROWS", 4)
    n = 30
    numbers = [i * 3 for i in range(n)]
    ids = [f"{i:05d}" for i in numbers] if text_ids else numbers
    source = [None if i % 5 == 4 else "hot" if i % 3 else f"cold{i % 2}" for i in range(n)]
    c = chunk_rows(spark, [f"t{i}" for i in range(n)], ids, source)
    got = {r.id: r.prev for r in chunks.with_previous(chunks.texts(c, "body", "src"), "src").collect()}
    last, want = {}, {}
    for i in range(n):
        want[ids[i]] = last.get(source[i])
        last[source[i]] = f"t{i}"
    assert got == want
    everything = {r.id: r.prev for r in chunks.with_previous(chunks.texts(c, "body")).collect()}
    assert everything == {ids[i]: f"t{i - 1}" if i else None for i in range(n)}


def test_chunk_report(spark):
    long = "A sentence that is long enough to pass the lower bound of fifty bytes."
    c = chunk_rows(spark, ["short", long, "x" + long[:-1], "lower without an end but long enough to be a chunk here", long + "!" * 5000])
    q = R.chunk_quality(c)
    got = sorted((r.id, r.issue) for r in q.issues.collect())
    assert got == [(0, "too_short"), (0, "broken_boundary"), (2, "broken_boundary"), (3, "broken_boundary"), (4, "too_long")] or set(got) == {
        (0, "too_short"), (0, "broken_boundary"), (2, "broken_boundary"), (3, "broken_boundary"), (4, "too_long")}
    row = q.summary.first()
    assert (row.content_field, row.n, row.quality_score, row.grade) == ("body", 5, 0.0, "poor")
    assert {r.issue: r.n for r in q.breakdown.collect()}["orphan"] == 0


def test_repeated_chunk(spark):
    t = "The same words are found again in the very next chunk of this text."
    c = chunk_rows(spark, [t, t, "A different text that shares nothing with the ones before it at all."])
    (issue,) = R.chunk_quality(c).issues.collect()
    assert (issue.id, issue.issue, issue.detail) == (1, "high_overlap", "100% overlap with previous chunk")


def test_content_field_choice(spark):
    c = Collection(spark.createDataFrame([(1, None, "", "x", 1)], "id int, vector array<double>, text string, body string, n int"), ("text", "body", "n"))
    assert chunks.content_field(c) == "body"
    c = Collection(spark.createDataFrame([(1, None, "x")], "id int, vector array<double>, pageContent string"), ("pageContent",))
    assert chunks.content_field(c) == "pageContent"
    with pytest.raises(ValueError):
        R.chunk_quality(Collection(c.df.select("id", "vector"), ()))


def test_timestamp_field_choice(spark):
    c = Collection(spark.createDataFrame([(1, None, "soon", "17")], "id int, vector array<double>, created_at string, date string"), ("created_at", "date"))
    assert staleness.timestamp_field(c) == "date"


def _linked(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long").repartition(4)


def _brute_components(pairs):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in list(root)}


@pytest.mark.parametrize("hubs", [1000, 20])
def test_components_of_stars_chains_and_rings(spark, hubs):
    rng = random.Random(2)
    pairs = [(500, i) for i in range(501, 560)] + [(i, 499) for i in range(600, 640)] + [(i, i + 1) for i in range(40)]
    pairs += [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(800, 800)] + [(rng.randrange(900, 960), rng.randrange(900, 960)) for _ in range(40)]
    got = {r.id: r.component for r in components(_linked(spark, pairs), hubs=hubs).collect()}
    assert got == _brute_components([p for p in pairs if p[0] != p[1]])


def test_a_hub_with_a_third_of_all_links_is_spread(spark):
    """Links of a hub stay in the partitions they are in: none holds more than its share."""
    from embedlens.operators.components import hub_nodes, with_least

    hub = spark.range(3000).select(F.lit(10**9).alias("u"), (F.col("id") + 5).alias("v"))
    rest = spark.range(6000).select((F.col("id") % 2900).alias("u"), (F.col("id") * 7 % 2900 + 10).alias("v"))
    rows = hub.unionByName(rest).repartition(16, "v").cache()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = hub_nodes(rows, 9000)
        assert found.collect() == [(10**9,)]
        out = with_least(rows, found)
        sizes = [r["count"] for r in out.where("u = 1000000000").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 400 and len(sizes) == 16
        assert out.where("u = 1000000000").select("m").distinct().collect() == [(5,)]
        assert out.count() == 9000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        rows.unpersist()


def _contradicting(spark, seed, n=160, hot=70):
    """Rows of near vectors; a third is one vector with many different and some equal metadata."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.01 * rng.normal(size=5) if i >= hot else centres[0]
        rows.append((f"r{i * 37 % 1000:03d}", [float(x) for x in v.round(3)], f"m{rng.integers(9 if i >= hot else 40)}"))
    rows += [("copy", rows[-1][1], "other"), ("same", rows[-1][1], rows[-1][2])]
    df = spark.createDataFrame(rows, "id string, vector array<double>, title string").repartition(4)
    return rows, Collection.of(df, "id", "vector")


def _brute_contradictions(rows, threshold):
    x = np.array([v for _, v, _ in rows])
    norm = np.sqrt((x * x).sum(1))
    sim = (x @ x.T) / np.outer(norm, norm)
    return [
        (sim[i, j], *sorted((i, j), key=lambda r: rows[r][0])) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if rows[i][2] != rows[j][2] and (sim[i, j] >= threshold or rows[i][1] == rows[j][1])
    ]


@pytest.mark.parametrize("signatures", [256, 3])
def test_contradictions_against_all_row_pairs(spark, monkeypatch, signatures):
    from embedlens.operators import contradictions

    monkeypatch.setattr(contradictions, "SIGNATURES", signatures)
    rows, coll = _contradicting(spark, 3)
    want = _brute_contradictions(rows, 0.9)
    found = Contradictions(coll, 0.9, 40)
    assert found.total().first()[0] == len(want)
    # rows of one vector and one title are one signature, the smallest id stands for it
    least = {}
    for i, v, t in rows:
        least[str(v), t] = min(least.get((str(v), t), i), i)
    pairs = {}
    for sim, i, j in want:
        a, b = sorted(least[str(rows[r][1]), rows[r][2]] for r in (i, j))
        s, n = pairs.get((a, b), (sim, 0))
        pairs[a, b] = (s, n + 1)
    order = sorted((-round(s, 9), a, b, n) for (a, b), (s, n) in pairs.items())
    got = [(-round(r.similarity, 9), r.vector_a_id, r.vector_b_id, r.row_pairs) for r in found.pairs().collect()]
    assert sorted(got) == order[:40]


def test_undecided_pairs_never_leave_a_task(spark, monkeypatch):
    """However many pairs of vectors with differing copies are near each other, a task returns its count and its best."""
    from embedlens.operators import contradictions, pairs

    rows = [(f"r{i:04d}", [1.0, 0.001 * (i // 3)], f"m{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, title string").repartition(4)
    real = pairs.plan
    monkeypatch.setattr(pairs, "plan", lambda v, n, d, cell_rows=None, block_rows=None, unit=False: real(v, n, d, cell_rows, 50, unit))
    found = contradictions.Contradictions(Collection.of(df, "id", "vector"), 0.9, 7)
    tasks = 4 * 5 // 2  # pairs of blocks
    assert found.found.count() <= tasks * (7 + 1)
    assert found.total().first()[0] == len(_brute_contradictions(rows, 0.9))


def test_dates_in_wrong_units_are_put_in_order_over_tasks(spark, monkeypatch):
    """The same zones and percentiles whether hours fit one window or not."""
    rng = random.Random(8)
    hours = [rng.randrange(3000, 30_000) if i % 5 else rng.randrange(10**9, 10**10) for i in range(300)]
    ages = spark.createDataFrame([(i, h, h / 24.0) for i, h in enumerate(hours)], "id long, age_hours long, age_days double").repartition(4)
    assert not staleness._few(staleness.hour_counts(ages), "age_hours")
    far = sorted(map(tuple, staleness.dead_zones(ages).collect())), staleness.age_percentiles(ages)
    monkeypatch.setattr(staleness, "FEW_VALUES", 10**12)
    near = sorted(map(tuple, staleness.dead_zones(ages).collect())), staleness.age_percentiles(ages)
    assert far == near and len(far[0]) >= 1


def test_previous_row_of_sparse_ids(spark):
    from embedlens.operators.chunks import with_previous

    rows = [(i * 1_000_003, f"t{i}", f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, source string").repartition(4)
    got = {r.id: r.prev for r in with_previous(df, "source").collect()}
    assert got == {i: (f"t{n - 2}" if n > 1 else None) for n, (i, _, _) in enumerate(rows)}
    assert {r.id: r.prev for r in with_previous(df).collect()} == {i: (f"t{n - 1}" if n else None) for n, (i, _, _) in enumerate(rows)}


def test_lists_of_a_large_group_of_texts_are_cut_as_in_sql(spark, tmp_path):
    import duckdb

    from catalog.oracle import ORACLE
    from catalog.spark_queries import QUERIES

    text = F.when(F.col("doc_id") < 2500, "Same  words").otherwise(F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")))
    docs = spark.range(2520).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.withColumn("text", text).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).selectExpr("id as vec_id", "array(1.0f, 2.0f) as embedding", "1 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((r.first_id, r.vector_ids) for r in QUERIES["a2_text_dups"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE["a2_text_dups"]).fetchall()) and len(got) == 3 + 7


def test_a_chunk_report_reads_its_texts_few_times(spark, tmp_path):
    """Every pass over a joined collection shuffles all texts."""
    import uuid

    from embedlens.sources.collections import Collection

    folder = str(tmp_path)

    def reading(batches):
        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            yield from batches

    base = spark.range(40, numPartitions=1).selectExpr("id", "cast(array(cos(id), sin(id)) as array<double>) as vector", "concat('Text ', id, '.') as text", "'s' as source")
    coll = Collection(base.mapInArrow(reading, base.schema), ("text", "source"), "texts")
    found = R.chunk_quality(coll, source="source")
    assert found.issues.count() == 40 and found.summary.first().content_field == "text" and found.histogram.count() == 20
    assert len(list(tmp_path.iterdir())) <= 9
