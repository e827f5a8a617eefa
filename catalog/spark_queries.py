"""One Spark query per operator of the inventory. Numbers are rounded to six digits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import fixtures as X
from embedlens.functions import text as TX
from embedlens.functions import times
from embedlens.functions import vectors as V
from embedlens.operators import codes, chunks, clusters, contradictions, distances, duplicates, layout, orphans, spatial, staleness
from embedlens.operators import ordering as O
from embedlens.operators import pairs as P
from embedlens.operators.components import components
from embedlens.plans import reports as R
from embedlens.session import cut, ensure_checkpoint_dir
from embedlens.sources import collections as S
from embedlens.sources import export, layouts, projections

QUERIES: dict = {}
NEAR = 0.98
LINK = 0.4  # similarity at which the given vectors form a few chains


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All floating columns rounded to six digits."""
    return df.select(*[r6(f"`{n}`").alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


# ---------------------------------------------------------------- sources and sinks


@query
def s1_offset_page(spark, d):
    c = X.text_collection(spark, d)
    return S.page(c.df.select("id", "label", "lang"), 50, 100).withColumn("total", F.lit(c.df.count()))


@query
def s2_keyset_page(spark, d):
    return S.page_after(X.text_collection(spark, d).df.select("id", "label", "lang"), 50, 123)


def _stored(spark, rows, by, file_rows):
    """A stored layout of rows that Spark derives from the tables."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/layout-{by}-{datetime.now().timestamp()}"
    layouts.publish(rows, path, by, file_rows)
    return layouts.Layout.open(spark, path)


@query
def s2_page_of_layout(spark, d):
    """The same page from files in id order, of which two or three are opened."""
    return _stored(spark, X.text_collection(spark, d).df.select("id", "label", "lang"), "id", 40).page_after(50, 123)


@query
def s1_page_of_layout(spark, d):
    return _stored(spark, X.text_collection(spark, d).df.select("id", "label", "lang"), "id", 40).page(30, 95)


@query
def s2_next_cursor(spark, d):
    page = S.page_after(X.text_collection(spark, d).df.select("id"), 50, 123)
    return S.next_cursor(page, 50)


@query
def s3_full_scan(spark, d):
    return X.text_collection(spark, d).df.select("id", "label", "lang", "source", "n_chars")


@query
def s4_collection_profile(spark, d):
    info = S.collection_info([X.collection(spark, d), X.collection_dup(spark, d), X.collection_mixed(spark, d), X.chunk_collection(spark, d)])
    return info.withColumn("properties", F.array_join("properties", ","))


@query
def s5_collection_info(spark, d):
    every = [X.collection(spark, d), X.collection_dup(spark, d), X.collection_mixed(spark, d)]
    return S.collection_info([S.find_collection(every, "collection_dup")]).withColumn("properties", F.array_join("properties", ","))


@query
def s6_row_normaliser(spark, d):
    e, t = X.table(spark, d, "embeddings"), X.table(spark, d, "documents")
    c = S.Collection.of(e.join(t, e["vec_id"] == t["doc_id"], "left").drop("doc_id"), "vec_id", "embedding")
    return c.df.select(F.col("id").cast("string").alias("id"), F.size("vector").alias("width"), c.metadata_json().alias("metadata"))


@query
def s7_export_vectors(spark, d):
    c = X.text_collection(spark, d)
    stepped = c.with_df(c.df.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 1000).cast("double"))))
    return export.vector_rows(stepped, include_vectors=True, limit=None)


@query
def s8_export_orphans(spark, d):
    return export.orphan_rows(orphans.classify(X.text_collection(spark, d), required=("text", "label"), content="text"))


@query
def s9_export_duplicates(spark, d):
    c = X.collection_dup(spark, d)
    found = R.find_duplicates(c, text_field="text")
    return rounded(export.duplicate_rows(found.groups, duplicates.member_lists(found.members)))


def _label_outliers(spark, d):
    rows = X.by_label(spark, d)
    return clusters.outliers(clusters.with_centroid_distance(rows, clusters.cluster_means(rows)), 1.5)


@query
def s10_export_outliers(spark, d):
    return rounded(export.outlier_rows(_label_outliers(spark, d), X.text_collection(spark, d)))


@query
def s11_export_health(spark, d):
    h = _health(spark, d)
    return export.health_rows(h.collections, h.issues, h.summary)


@query
def s12_csv_roundtrip(spark, d):
    rows = export.vector_rows(X.text_collection(spark, d), limit=None)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv-{datetime.now().timestamp()}"
    export.write(rows, path, "csv")
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("id string, metadata string").csv(path)


@query
def s13_manifest(spark, d):
    return export.manifest(export.vector_rows(X.text_collection(spark, d), limit=None), "docs", "vectors", "csv", X.AS_OF)


@query
def s14_stored_projection(spark, d):
    c = X.plain(spark, d)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/projections-{datetime.now().timestamp()}"
    for _ in range(2):  # the second call reads what the first one stored
        found = projections.projection(c, path, "coordinates", lambda: spatial.normalise(X.points(spark, d)), min_dist=0.1)
    return rounded(found)


@query
def s15_id_fingerprint(spark, d):
    return S.id_fingerprint(X.collection(spark, d).df)


# ---------------------------------------------------------------- filters and predicates


@query
def f1_empty_values(spark, d):
    c = X.json_collection(spark, d)
    return c.df.select("id", c.is_empty("f").alias("empty"))


@query
def f2_has_embedding(spark, d):
    return X.text_collection(spark, d).vectors().select("id")


@query
def f3_missing_fields(spark, d):
    found = orphans.classify(X.text_collection(spark, d), required=("label", "lang", "text"))
    return found.select("id", "reason", F.array_join("missing_fields", ";").alias("missing_fields"))


@query
def f4_orphan_class(spark, d):
    found = orphans.classify(X.collection(spark, d), content="text", stale_days=200, timestamp="created_at", as_of=X.AS_OF)
    return found.select("id", "reason", F.array_join("missing_fields", ";").alias("missing_fields"))


@query
def f5_content_field(spark, d):
    c = X.collection(spark, d)
    return c.df.agg(F.lit(chunks.content_field(c)).alias("content_field"))


@query
def f6_timestamp_field(spark, d):
    c = X.collection(spark, d)
    return c.df.agg(F.lit(staleness.timestamp_field(c)).alias("timestamp_field"))


@query
def f7_age_days(spark, d):
    return rounded(staleness.record_ages(X.collection(spark, d), "created_at", X.AS_OF).select("id", "age_days"))


@query
def f7_age_formats(spark, d):
    """One moment in every accepted notation."""
    v = X.table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("array<double>").alias("vector"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    text = F.concat(F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    kind = F.col("id") % 5
    doc = (
        F.when(kind == 0, F.to_json(F.struct(text.alias("t")))).when(kind == 1, F.to_json(F.struct(F.col("s").alias("t"))))
        .when(kind == 2, F.to_json(F.struct((F.col("s") * 1000).alias("t")))).when(kind == 3, F.to_json(F.struct(F.col("s").cast("string").alias("t"))))
        .otherwise(F.to_json(F.struct(F.lit("no date").alias("t"))))
    )
    c = S.Collection.of_json(v.withColumn("m", doc), "m", ("t",))
    return rounded(staleness.record_ages(c, "t", X.AS_OF).select("id", "age_days"))


@query
def f8_stale_rows(spark, d):
    c = X.collection(spark, d)
    epoch = times.epoch_micros(c.field("created_at"), c.types["created_at"], millis=False)
    return c.df.select("id", times.whole_days(epoch, X.AS_OF).alias("days")).where("days > 200")


@query
def f9_empty_content(spark, d):
    c = X.collection(spark, d)
    return c.df.select("id", orphans.empty_content(c).alias("empty_content"))


@query
def f10_grades(spark, d):
    score = (F.col("n_chars") % 1010) / 10.0
    return X.table(spark, d, "documents").select("doc_id", R.grade(score).alias("grade"))


@query
def f11_length_issues(spark, d):
    return chunks.length_issues(chunks.texts(X.chunk_collection(spark, d), "text")).select("id", "issue", "detail")


@query
def f12_broken_boundary(spark, d):
    return chunks.boundary_issues(chunks.texts(X.chunk_collection(spark, d), "text")).select("id", "issue")


@query
def f13_preview(spark, d):
    return X.table(spark, d, "documents").select("doc_id", TX.preview(F.col("text")).alias("preview"))


@query
def f14_hash_sample(spark, d):
    return layout.hash_sample(X.embeddings(spark, d).select("id"), 0.3)


@query
def f15_sample_share(spark, d):
    n = X.table(spark, d, "events").count()
    return X.table(spark, d, "events").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.lit(layout.sample_share(n)))


@query
def f16_overlay_staleness(spark, d):
    ages = staleness.record_ages(X.collection(spark, d), "created_at", X.AS_OF)
    return rounded(R.overlay_staleness(ages).drop("label"))


@query
def f16_overlay_duplicates(spark, d):
    found = R.find_duplicates(X.collection_dup(spark, d))
    return R.overlay_duplicates(found.groups, found.members)


@query
def f16_overlay_anomalies(spark, d):
    return rounded(R.overlay_anomalies(_anomalies(spark, d)))


@query
def f16_overlay_models(spark, d):
    rows = R.norms(X.collection_mixed(spark, d), 6)
    return R.overlay_models(rows, clusters.norm_groups(rows))


# ---------------------------------------------------------------- vector scalars


@query
def v1_norms(spark, d):
    return rounded(R.norms(X.collection_mixed(spark, d)))


def _adjacent(spark, d):
    e = X.collection_mixed(spark, d).vectors()
    a = e.select(F.col("id").alias("a"), F.col("vector").alias("va"))
    b = e.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vector").alias("vb"))
    return a.join(b, "a")


@query
def v2_cosine_pairs(spark, d):
    return rounded(_adjacent(spark, d).select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cosine")))


@query
def v3_euclidean(spark, d):
    return rounded(_adjacent(spark, d).select("a", "b", V.euclidean(F.col("va"), F.col("vb")).alias("dist")))


@query
def v4_squared_euclidean(spark, d):
    return rounded(_adjacent(spark, d).select("a", "b", V.squared_euclidean(F.col("va"), F.col("vb")).alias("dist2")))


@query
def v5_exact_fingerprint(spark, d):
    e = X.collection_dup(spark, d).vectors()
    return P.copy_members(e)


@query
def v6_text_form(spark, d):
    t = X.table(spark, d, "documents")
    return t.select("doc_id", F.md5(TX.normal_form(F.col("text")).cast("binary")).alias("form"))


@query
def v7_random_projection(spark, d):
    out = layout.random_projection(X.embeddings(spark, d), 64, 50)
    return rounded(out.select("id", F.posexplode("vector").alias("j", "x")))


@query
def v8_near_zero(spark, d):
    scale = F.when(F.col("label") == 3, 1e-6).otherwise(1.0)
    e = X.embeddings(spark, d).withColumn("vector", F.transform("vector", lambda x: x * scale))
    return e.select("id", V.near_zero(F.col("vector")).alias("near_zero"))


# ---------------------------------------------------------------- pairs and neighbours


@query
def j1_near_pairs(spark, d):
    return rounded(P.similar_pairs(X.embeddings(spark, d), 0.3))


@query
def j1_near_pairs_cells(spark, d):
    """The same join through cells, on vectors that cluster."""
    rows = X.collection_dup(spark, d).vectors()
    distinct = P.collapse_copies(rows, P.copy_members(rows))
    return rounded(P.similar_pairs(distinct, 0.9, cell_rows=100, block_rows=128))


@query
def j2_contradictions(spark, d):
    found = contradictions.Contradictions(X.collection_dup(spark, d)).pairs()
    text = F.array_join(F.transform("differences", lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["value_a"], F.lit("")), F.lit("|"), F.coalesce(x["value_b"], F.lit("")))), ";")
    return rounded(found.withColumn("differences", text))


@query
def j2_contradiction_total(spark, d):
    return contradictions.Contradictions(X.collection_dup(spark, d)).total()


@query
def j3_knn_exact(spark, d):
    return rounded(P.knn(X.embeddings(spark, d), 5))


@query
def j3_knn_cells(spark, d):
    """Exact neighbours through pivot cells, on a collection with copies."""
    return rounded(P.knn(X.collection_dup(spark, d).vectors(), 3, cell_rows=128, block_rows=256))


@query
def j4_knn_approximate(spark, d):
    return rounded(P.knn(X.embeddings(spark, d), 5, cell_rows=64, probes=3))


@query
def j4_knn_coded(spark, d):
    """Neighbours through codes in inverted lists: every row listed, distances true by another formula, recall against exact neighbours."""
    e = X.embeddings(spark, d).select("id", "vector")
    near, exact = codes.knn_coded(e, 5, lists=8, probes=7), P.knn(e, 5)
    ends = [e.select(F.col("id").alias(i), F.col("vector").alias(v)) for i, v in (("src", "a"), ("dst", "b"))]
    met = near.join(ends[0], "src").join(ends[1], "dst")
    a, b = F.col("a"), F.col("b")
    true = F.sqrt(V.squared_norm(a) + V.squared_norm(b) - 2 * V.dot(a, b))
    hit = exact.select("src", "dst", F.lit(1).alias("hit"))
    return met.join(hit, ["src", "dst"], "left").agg(
        F.count_distinct("src").alias("rows"), F.count(F.lit(1)).alias("listed"), F.count_if(F.abs(F.col("dist") - true) > 1e-9).alias("wrong"),
        (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
    )


@query
def j5_neighbors(spark, d):
    return rounded(P.neighbors(X.embeddings(spark, d), 7, 10).select("id", "rank", "dist"))


def _label_queries(spark, d):
    means = clusters.cluster_means(X.by_label(spark, d))
    return means.select(F.col("cluster").cast("bigint").alias("query"), F.col("centroid").alias("vector"))


@query
def j6_search(spark, d):
    return rounded(P.search(X.embeddings(spark, d), _label_queries(spark, d), 20, exclude_self=False))


@query
def j6_search_cosine(spark, d):
    return rounded(P.search(X.collection_mixed(spark, d).vectors(), _label_queries(spark, d), 20, "cosine", exclude_self=False))


@query
def j6_search_text(spark, d):
    """Documents nearest to each benchmark passage by hashed words."""
    texts = X.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return rounded(R.search_text(X.chunk_collection(spark, d), texts, 5, "text"))


@query
def j7_normalised_distance(spark, d):
    hits = P.neighbors(X.embeddings(spark, d), 7, 20).select("id", "dist")
    return rounded(R.normalised_distance(hits))


@query
def j8_attach_coordinates(spark, d):
    hits = P.neighbors(X.collection_dup(spark, d).vectors(), 7, 20).select("id", "rank")
    return rounded(R.attach_coordinates(hits, X.points(spark, d)))


@query
def j9_cascade_remaining(spark, d):
    rows = X.collection_dup(spark, d).vectors()
    return rows.join(duplicates.exact_members(rows).select("id"), "id", "left_anti").select("id")


@query
def j10_recall_given(spark, d):
    """Recall of a search that looks inside the own label only."""
    e = X.embeddings(spark, d)
    label = e.select("id", "label")
    near = P.knn(e, 25)
    own = near.join(label.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    return rounded(distances.recall(e, own.where("ls = ld"), 10, e.count()))


@query
def j11_symmetrise(spark, d):
    edges = P.knn(X.embeddings(spark, d), 5).select("src", "dst", (1 / (1 + F.col("dist"))).alias("w"))
    return rounded(layout.symmetrise(edges))


@query
def j12_radius_pairs(spark, d):
    return rounded(spatial.closest_pairs(X.points(spark, d), 0.05, 500))


@query
def j13_radius_rows(spark, d):
    return rounded(spatial.within(X.points(spark, d), (0.1, 0.0, -0.1), 0.2))


@query
def j13_box_of_layout(spark, d):
    """Points in a box from files along a space-filling curve."""
    return rounded(_stored(spark, X.points(spark, d).select("id", "x", "y", "z"), "space", 50).box((-0.1, -0.2, -0.3), (0.3, 0.2, 0.1)))


@query
def j14_delete_ids(spark, d):
    c = X.text_collection(spark, d)
    gone = X.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return duplicates.delete_ids(c, gone).df.select("id", "lang")


@query
def j15_keep_first(spark, d):
    c = X.collection_dup(spark, d)
    return duplicates.keep_first(c, duplicates.duplicate_members(c)).df.select("id", "label")


@query
def j16_strided_pairs(spark, d):
    return rounded(distances.strided_pairs(X.embeddings(spark, d), 10_000))


# ---------------------------------------------------------------- aggregates


@query
def a1_exact_dups(spark, d):
    m = duplicates.exact_members(X.collection_dup(spark, d).vectors())
    return duplicates.member_lists(m).select("first_id", "vector_ids")


@query
def a2_text_dups(spark, d):
    m = duplicates.text_members(X.text_collection(spark, d), "text")
    return duplicates.member_lists(m).select("first_id", "vector_ids")


@query
def a3_components(spark, d):
    return components(P.similar_links(X.embeddings(spark, d), LINK))


@query
def a3_near_groups(spark, d):
    c = X.plain(spark, d)
    m = cut(duplicates.near_members(c.vectors(), LINK))
    return rounded(duplicates.duplicate_groups(c, m).select("first_id", "size", "similarity"))


@query
def a3_components_cells(spark, d):
    """Components through pivot cells, with near copies settled on their pivots."""
    return components(P.similar_links(X.collection_dup(spark, d).vectors(), 0.98, cell_rows=100, block_rows=256))


@query
def a4_duplicate_totals(spark, d):
    return duplicates.duplicate_totals(duplicates.duplicate_members(X.collection_dup(spark, d), text_field="text"))


@query
def a5_orphans_by_reason(spark, d):
    return orphans.by_reason(orphans.classify(X.collection(spark, d), content="text", stale_days=200, timestamp="created_at", as_of=X.AS_OF))


@query
def a6_completeness(spark, d):
    return rounded(orphans.completeness(X.collection(spark, d)))


@query
def a7_moments(spark, d):
    return rounded(O.moments(X.table(spark, d, "events"), "value"))


@query
def a8_percentiles(spark, d):
    shares = [0.25, 0.5, 0.75, 0.9, 0.99]
    got = O.percentiles(X.table(spark, d, "lineitem"), "l_extendedprice", shares)
    base = X.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))
    return rounded(base.select("n", *[F.lit(v).alias(f"p{int(p * 100)}") for p, v in zip(shares, got)]))


@query
def a10_bimodality(spark, d):
    m = O.moments(R.norms(X.collection_mixed(spark, d), 6), "norm")
    args = (F.col("skewness"), F.col("kurtosis"), F.col("n"))
    bc = O.bimodality(*args)
    return rounded(m.select("n", bc.alias("bc"), O.model_confidence(bc).alias("confidence"), O.bimodality_unclamped(*args).alias("bc_unclamped")))


@query
def a11_histogram(spark, d):
    return rounded(O.histogram(X.table(spark, d, "events"), "value", 30))


@query
def a12_dim_stats(spark, d):
    return rounded(O.dimension_stats(X.embeddings(spark, d)))


@query
def a13_meta_diff(spark, d):
    t = X.table(spark, d, "documents")
    fields = ["lang", "n_chars", "source"]
    a = t.select(F.col("doc_id").alias("a"), F.struct("lang", F.col("n_chars").cast("string").alias("n_chars"), "source").alias("ma"))
    b = t.select((F.col("doc_id") - 20).alias("a"), F.struct("lang", F.col("n_chars").cast("string").alias("n_chars"), "source").alias("mb"))
    found = a.join(b, "a").select("a", F.explode(contradictions.differences(F.col("ma"), F.col("mb"), fields)).alias("d"))
    return found.select("a", "d.field", "d.value_a", "d.value_b")


@query
def a14_cluster_sizes(spark, d):
    return clusters.cluster_sizes(X.by_label(spark, d), 12)


@query
def a15_silhouette(spark, d):
    return rounded(clusters.silhouette(X.by_label(spark, d)))


@query
def a16_davies_bouldin(spark, d):
    rows = X.by_label(spark, d)
    return rounded(clusters.davies_bouldin(rows, clusters.cluster_means(rows), 10))


@query
def a17_density(spark, d):
    return rounded(clusters.density_stats(clusters.local_density(X.embeddings(spark, d))))


@query
def a18_effective_dims(spark, d):
    return O.effective_dimensions(O.dimension_stats(X.embeddings(spark, d)))


@query
def a19_distance_stats(spark, d):
    p = distances.strided_pairs(X.embeddings(spark, d), 10_000)
    score = distances.discrimination(F.min("dist"), F.max("dist"), F.avg("dist"))
    return rounded(p.agg(F.count("dist").alias("n"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"), F.min("dist").alias("min"), F.max("dist").alias("max"), score.alias("discrimination")))


def _some(spark, d):
    return [X.collection(spark, d), X.collection_dup(spark, d), X.chunk_collection(spark, d)]


@query
def a20_storage(spark, d):
    return R.performance(_some(spark, d))


def _health(spark, d):
    return R.health(_some(spark, d), X.AS_OF)


@query
def a21_health_score(spark, d):
    return _health(spark, d).summary.select("score", "grade", "total_vectors", "estimated_storage_bytes", "issue_count")


@query
def a22_max_similarity(spark, d):
    return rounded(P.max_similarity(X.collection_mixed(spark, d).vectors()))


@query
def a23_totals(spark, d):
    return R.performance_totals(R.performance(_some(spark, d)))


# ---------------------------------------------------------------- windows and order


@query
def w1_overlap(spark, d):
    rows = chunks.texts(X.chunk_collection(spark, d), "text", "source")
    met = chunks.with_previous(rows, "source")
    return met.select("id", TX.high_overlap(F.col("prev"), F.col("text"), 0.8).alias("overlap"))


@query
def w1_overlap_within_docs(spark, d):
    """Overlap of each document with its own text moved on by one sentence length."""
    t = X.table(spark, d, "documents").select("doc_id", "text", "n_chars")
    prev = F.concat(F.lit("Before. "), F.left("text", F.length("text")))
    return t.select("doc_id", TX.high_overlap(prev, F.col("text"), 0.8).alias("overlap"))


@query
def w2_dead_zones(spark, d):
    return rounded(staleness.dead_zones(staleness.record_ages(X.collection(spark, d), "created_at", X.AS_OF)))


@query
def w3_cumulative_variance(spark, d):
    dims = O.dimension_stats(X.embeddings(spark, d))
    ranked = O.with_ordinal(dims.select("dim", "variance").withColumn("minus", -F.col("variance")), "minus", "dim", name="place")
    # one row per dimension: the width of a vector
    upto = F.sum("variance").over(Window.orderBy("place")) / F.sum("variance").over(Window.partitionBy())
    return rounded(ranked.select("dim", "place", "variance", upto.alias("share")))


@query
def w4_ordinals(spark, d):
    return O.with_ordinal(X.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "ordinal")


@query
def w5_first_ids(spark, d):
    rows = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return clusters.first_ids(rows, "source")


# ---------------------------------------------------------------- clusters and anomalies


@query
def m1_kmeans_k3_i3(spark, d):
    e = X.embeddings(spark, d)
    found = clusters.kmeans(e, 3, 3)
    return rounded(found.assign(e).select("id", "cluster", "dist"))


@query
def m2_auto_k(spark, d):
    e = X.embeddings(spark, d)
    n = e.count()
    return e.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(clusters.auto_k(n)).alias("k"), F.lit(clusters.auto_k(n, 15)).alias("k_anomaly"))


@query
def m3_norm_groups(spark, d):
    rows = R.norms(X.collection_mixed(spark, d), 6)
    return rounded(clusters.norm_group_stats(rows, clusters.norm_groups(rows)))


@query
def m4_outliers(spark, d):
    return rounded(_label_outliers(spark, d))


def _label_centroids(spark, d):
    import numpy as np

    rows = clusters.cluster_means(X.by_label(spark, d)).orderBy("cluster").collect()
    return np.array([r.centroid for r in rows])


@query
def m5_nearby_centroids(spark, d):
    c = _label_centroids(spark, d)
    return clusters.nearby_centroids(X.embeddings(spark, d), c, 1.0)


def _anomalies(spark, d):
    c = X.collection_dup(spark, d)
    return clusters.anomaly_scores(c, _label_centroids(spark, d), 3, radius=1.02)


@query
def m6_anomaly_score(spark, d):
    return rounded(_anomalies(spark, d).withColumn("reasons", F.array_join("reasons", ";")))


@query
def m7_fuzzy_graph(spark, d):
    return rounded(layout.fuzzy_graph(P.knn(X.embeddings(spark, d), 15)))


@query
def m8_layout(spark, d):
    return rounded(layout.project(X.embeddings(spark, d), "umap"))


@query
def m9_tsne_layout(spark, d):
    return rounded(layout.project(X.embeddings(spark, d), "tsne"))


@query
def m11_pca(spark, d):
    return rounded(layout.project(X.embeddings(spark, d), "pca"))


@query
def m12_spacing(spark, d):
    return rounded(spatial.minimum_spacing(X.points(spark, d)))


@query
def m13_normalise(spark, d):
    return rounded(spatial.normalise(X.points(spark, d)))


@query
def m14_sample_first(spark, d):
    """PCA coordinates of the first sample (the whole collection while it is small)."""
    e = X.embeddings(spark, d)
    n = e.count()
    picked = layout.first_sample(e, n)
    return rounded(layout.project((e if picked is None else picked).select("id", "vector"), "pca"))


# ---------------------------------------------------------------- reports


@query
def r1_health_collections(spark, d):
    return rounded(_health(spark, d).collections)


@query
def r1_health_issues(spark, d):
    return R.global_issues(_health(spark, d).issues).select("severity", "category", "message", "affected_count")


@query
def r3_duplicates(spark, d):
    found = R.find_duplicates(X.collection_dup(spark, d), text_field="text")
    return rounded(found.groups.select("group_id", "kind", "first_id", "size", "similarity"))


@query
def r3_duplicate_members(spark, d):
    return R.find_duplicates(X.collection_dup(spark, d), text_field="text").members


@query
def r4_cluster_metrics(spark, d):
    return rounded(R.distribution(X.plain(spark, d), k=3, iterations=3).metrics)


@query
def r4_default_clusters(spark, d):
    """Clusters with the default number and iterations, beside their sizes."""
    found = R.distribution(X.plain(spark, d))
    return found.sizes


@query
def r4_outliers(spark, d):
    found = R.distribution(X.plain(spark, d), k=3, iterations=3, threshold=1.5)
    ranked = O.with_ordinal(found.outliers.withColumn("minus", -F.col("outlier_score")), "minus", "id", name="rank").drop("minus")
    return rounded(ranked)


@query
def r5_recommendations(spark, d):
    tall = S.Collection.of(X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", name="lineitem")
    return R.recommendations(R.performance([*_some(spark, d), tall]))


@query
def r7_staleness(spark, d):
    return rounded(R.stale_records(X.collection(spark, d), X.AS_OF).summary)


@query
def r7_age_histogram(spark, d):
    return rounded(R.stale_records(X.collection(spark, d), X.AS_OF).histogram)


@query
def r9_anomalies(spark, d):
    return rounded(R.anomalies(X.plain(spark, d), k=3, iterations=3).withColumn("reasons", F.array_join("reasons", ";")))


@query
def r10_fingerprint(spark, d):
    return rounded(R.fingerprint(X.collection_mixed(spark, d), digits=6).summary)


@query
def r10_groups(spark, d):
    return rounded(R.fingerprint(X.collection_mixed(spark, d), digits=6).groups)


@query
def r10_histogram(spark, d):
    return rounded(R.fingerprint(X.collection_mixed(spark, d), digits=6).histogram)


@query
def r11_chunk_summary(spark, d):
    return rounded(R.chunk_quality(X.text_collection(spark, d), source="source").summary)


@query
def r11_chunk_issues(spark, d):
    return R.chunk_quality(X.text_collection(spark, d), source="source").issues.select("id", "issue")


@query
def r11_length_histogram(spark, d):
    return rounded(R.chunk_quality(X.text_collection(spark, d), source="source").histogram)


@query
def r12_distance_health(spark, d):
    e = X.plain(spark, d)
    exact = P.knn(e.vectors(), 10)
    return rounded(R.distance_health(e, approximate=exact).summary)


@query
def r12_distance_histogram(spark, d):
    e = X.plain(spark, d)
    return rounded(R.distance_health(e, approximate=P.knn(e.vectors(), 10)).histogram)


@query
def r13_vectors_with_projection(spark, d):
    return rounded(layout.project_collection(X.text_collection(spark, d), "pca").select("id", "lang", "x", "y", "z"))
