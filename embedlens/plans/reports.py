"""The analyses a user asks for. Each returns a report object whose parts are tidy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.functions import text as X
from embedlens.functions import times
from embedlens.functions import vectors as V
from embedlens.functions.encode import hashing_encoder
from embedlens.operators import chunks, clusters, contradictions, distances, duplicates, layout, orphans, staleness
from embedlens.operators import ordering as O
from embedlens.operators.pairs import knn, search
from embedlens.plans import messages as M
from embedlens.session import cut
from embedlens.sources import export
from embedlens.sources.collections import Collection, collection_info, find_collection

ISSUE = "collection string, severity string, category string, message string, affected_count bigint, recommendation string"


def grade(score: Column) -> Column:
    s = F.floor(score)
    return F.when(s >= 90, "excellent").when(s >= 70, "good").when(s >= 50, "fair").otherwise("poor")


def grade_of(score: float) -> str:
    s = int(score)
    return "excellent" if s >= 90 else "good" if s >= 70 else "fair" if s >= 50 else "poor"


# ---------------------------------------------------------------- fingerprint


@dataclass(frozen=True)
class Fingerprint:
    summary: DataFrame
    groups: DataFrame
    histogram: DataFrame


def norms(coll: Collection, digits: int | None = None) -> DataFrame:
    n = V.norm(F.col("vector"))
    return coll.vectors().select("id", (n if digits is None else F.round(n, digits)).alias("norm"))


def fingerprint(coll: Collection, bins: int = 50, digits: int | None = None) -> Fingerprint:
    """Signs of mixed embedding models in the distribution of vector norms. ``digits`` rounds norms
    first, which removes float noise inside a group."""
    rows = norms(coll, digits).persist()
    stats = O.moments(rows, "norm")
    bc = O.bimodality(F.col("skewness"), F.col("kurtosis"), F.col("n"))
    s = stats.withColumn("bimodality_coefficient", F.when(F.col("n") > 0, bc).otherwise(0.0))
    s = s.withColumn("multi_model_confidence", O.model_confidence(F.col("bimodality_coefficient")))
    row = s.first()
    median = O.percentiles(rows, "norm", [0.5], row.n)[0]
    summary = coll.df.sparkSession.createDataFrame(
        [(row.n, *[float(row[c] or 0.0) for c in ("mean", "std", "min", "max")], float(median), row.bimodality_coefficient, row.multi_model_confidence)],
        "n bigint, mean double, std double, min double, max double, median double, bimodality_coefficient double, multi_model_confidence double",
    )
    mixed = row.n and row.multi_model_confidence > 0.1
    groups = clusters.norm_group_stats(rows, clusters.norm_groups(rows) if mixed else None)
    return Fingerprint(summary, groups, O.histogram(rows, "norm", bins))


# ---------------------------------------------------------------- staleness


@dataclass(frozen=True)
class Staleness:
    field: str | None
    summary: DataFrame
    histogram: DataFrame
    dead_zones: DataFrame
    ages: DataFrame


def stale_records(coll: Collection, as_of: datetime, days: int = staleness.STALE_DAYS, bins: int = 30, field: str | None = None) -> Staleness:
    spark = coll.df.sparkSession
    field = field or staleness.timestamp_field(coll)
    if field is None:
        ages = coll.df.select("id", F.lit(None).cast("bigint").alias("age_hours"), F.lit(None).cast("double").alias("age_days")).limit(0)
    else:
        ages = staleness.record_ages(coll, field, as_of)
    ages = ages.persist()
    s = ages.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("age_days") > days).alias("stale")).first()
    p = staleness.age_percentiles(ages, n=s.n)
    share = s.stale / s.n * 100.0 if s.n else 0.0
    summary = spark.createDataFrame(
        [(field, s.n, s.stale, share, p[1], *p)],
        "timestamp_field string, n bigint, stale_count bigint, stale_percentage double, median_age_days double, "
        "p25 double, p50 double, p75 double, p90 double, p99 double",
    )
    hours = staleness.hour_counts(ages).withColumn("age_days", F.col("age_hours") / 24.0)
    return Staleness(field, summary, O.histogram(hours, "age_days", bins, weight="n"), staleness.dead_zones(ages, days), ages.select("id", "age_days"))


# ---------------------------------------------------------------- duplicates, contradictions, orphans


@dataclass(frozen=True)
class Duplicates:
    groups: DataFrame
    members: DataFrame
    totals: DataFrame


def find_duplicates(coll: Collection, threshold: float = duplicates.THRESHOLD, exact: bool = True, near: bool = True, text_field: str | None = None) -> Duplicates:
    members = duplicates.duplicate_members(coll, threshold, exact, near, text_field)
    return Duplicates(duplicates.duplicate_groups(coll, members), members, duplicates.duplicate_totals(members))


def find_contradictions(
    coll: Collection, threshold: float = contradictions.THRESHOLD, max_results: int = contradictions.MAX_RESULTS
) -> contradictions.Contradictions:
    return contradictions.Contradictions(coll, threshold, max_results)


def find_orphans(coll: Collection, **options) -> DataFrame:
    return orphans.classify(coll, **options)


# ---------------------------------------------------------------- distribution, anomalies


@dataclass(frozen=True)
class Distribution:
    clustering: clusters.Clustering
    assigned: DataFrame
    metrics: DataFrame
    sizes: DataFrame
    outliers: DataFrame
    density: DataFrame
    dimensions: DataFrame


def distribution(coll: Collection, k: int | None = None, threshold: float = clusters.OUTLIER_THRESHOLD, iterations: int = 50, exact_silhouette: bool = True) -> Distribution:
    """Clusters with silhouette and Davies-Bouldin index, outliers, density, per-dimension statistics.

    The Euclidean silhouette compares all pairs; ``exact_silhouette=False`` reports the linear-time
    squared-Euclidean one, under its own name.
    """
    vectors = coll.vectors()
    k = k or clusters.auto_k(vectors.count())
    found = clusters.kmeans(vectors, k, iterations)
    assigned = found.assign(vectors)  # recomputed where used: cheaper than writing every vector
    score = clusters.silhouette(assigned) if exact_silhouette else clusters.silhouette_squared(assigned)
    davies = clusters.davies_bouldin(assigned, found.frame(vectors), k)
    metrics = score.withColumn("one", F.lit(1)).join(davies.withColumn("one", F.lit(1)), "one").drop("one").withColumn("cluster_count", F.lit(k))
    return Distribution(
        found, assigned, metrics, clusters.cluster_sizes(assigned, k), clusters.outliers(assigned, threshold),
        clusters.density_stats(clusters.local_density(vectors)), O.dimension_stats(vectors),
    )


def anomalies(coll: Collection, centrality: int = clusters.CENTRALITY, k: int | None = None, iterations: int = 30) -> DataFrame:
    """Rows with signs of poisoning, highest score first; empty for fewer than ten vectors."""
    vectors = coll.vectors()
    n = vectors.count()
    if n < 10:
        return vectors.select("id", F.lit(0.0).alias("anomaly_score"), F.array().cast("array<string>").alias("reasons")).limit(0)
    found = clusters.kmeans(vectors, k or clusters.auto_k(n, 15), iterations)
    return clusters.anomaly_scores(coll, found.centroids, centrality).orderBy(F.desc("anomaly_score"), "id")


# ---------------------------------------------------------------- chunk quality


@dataclass(frozen=True)
class ChunkQuality:
    field: str
    issues: DataFrame
    breakdown: DataFrame
    summary: DataFrame
    histogram: DataFrame


def chunk_quality(
    coll: Collection, field: str | None = None, low: int = chunks.MIN_LENGTH, high: int = chunks.MAX_LENGTH,
    source: str | None = None, bins: int = 20, isolation: bool = True,
) -> ChunkQuality:
    """Length, boundary, isolation and overlap issues of text chunks with a score of 100 less the
    issues per 100 chunks. ``source`` keeps chunks of different sources apart when looking for overlap."""
    spark = coll.df.sparkSession
    field = field or chunks.content_field(coll)
    if field is None:
        raise ValueError("No text content field found. Name one.")
    rows = chunks.texts(coll, field, *([source] if source else []))
    facts = cut(chunks.facts(rows, low, high, source))
    parts = [facts.select("id", F.explode("issues").alias("i"), "preview").select("id", "i.issue", "i.detail", "preview")]
    if isolation:
        parts.append(chunks.isolation_issues(coll, facts.select("id", "preview")))
    lengths = facts.select("len")
    s = O.moments(lengths, "len").first()
    if not s.n:
        parts = [p.limit(0) for p in parts]
    issues = cut(reduce(DataFrame.unionByName, parts))
    names = ["too_short", "too_long", "broken_boundary", "orphan", "high_overlap"]
    every = spark.createDataFrame([(i,) for i in names], "issue string")
    counts = issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    breakdown = every.join(counts, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"))
    total = issues.count()
    score = max(0.0, min(100.0, 100.0 - total / s.n * 100.0)) if s.n else 100.0
    median = O.percentiles(lengths, "len", [0.5], s.n)[0]
    summary = spark.createDataFrame(
        [(field, s.n, score, grade_of(score), float(s["mean"] or 0), float(median), int(s["min"] or 0), int(s["max"] or 0), float(s["std"] or 0))],
        "content_field string, n bigint, quality_score double, grade string, mean double, median double, min bigint, max bigint, std double",
    )
    return ChunkQuality(field, issues, breakdown, summary, O.histogram(lengths, "len", bins))


# ---------------------------------------------------------------- distance health


@dataclass(frozen=True)
class DistanceHealth:
    summary: DataFrame
    histogram: DataFrame
    recommendations: list[str]


def distance_health(
    coll: Collection, pairs: int = distances.SAMPLE_PAIRS, k: int = 10, approximate: DataFrame | None = None, bins: int = 30
) -> DistanceHealth:
    """Spread of distances, effective dimensions and recall. ``approximate (src, dst)`` are neighbours
    of a search to be judged; by default those of the cell index with four probes."""
    spark = coll.df.sparkSession
    vectors = coll.vectors()
    n = vectors.count()
    columns = (
        "n bigint, mean double, std double, min double, max double, median double, discrimination_score double, "
        "effective_dims bigint, actual_dims bigint, recall_k int, recall_at_k double, samples_tested bigint, overall string"
    )
    if n < 2:
        empty = spark.createDataFrame([(n, *[0.0] * 6, 0, 0, None, None, None, "insufficient_data")], columns)
        return DistanceHealth(empty, O.histogram(spark.createDataFrame([], "d double"), "d", bins), [M.TOO_FEW])
    dist = cut(distances.strided_pairs(vectors, pairs, n))
    s = dist.agg(
        F.count("dist").alias("n"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"), F.min("dist").alias("min"),
        F.max("dist").alias("max"), distances.discrimination(F.min("dist"), F.max("dist"), F.avg("dist")).alias("score"),
    ).first()
    median = O.percentiles(dist, "dist", [0.5], s.n)[0]
    dims = O.effective_dimensions(O.dimension_stats(vectors)).first()
    r = None
    if n >= 50:
        near = approximate if approximate is not None else knn(vectors, k, probes=4)
        r = distances.recall(vectors, near, k, n).first()
    advice = []
    if s.score < 0.3:
        advice.append(M.UNIFORM)
    if dims.actual_dims > 0 and dims.effective_dims < dims.actual_dims // 3:
        advice.append(M.FEW_DIMENSIONS.format(dims.effective_dims, dims.actual_dims))
    if r is not None and r.recall_at_k < 0.9:
        advice.append(M.LOW_RECALL.format(k, r.recall_at_k * 100))
    good_recall = r is None or r.recall_at_k > 0.9
    overall = "healthy" if s.score > 0.5 and good_recall else "moderate" if s.score > 0.3 else "unhealthy"
    summary = spark.createDataFrame(
        [(s.n, s["mean"], s["std"], s["min"], s["max"], median, s.score, dims.effective_dims, dims.actual_dims,
          None if r is None else k, None if r is None else r.recall_at_k, None if r is None else r.samples_tested, overall)],
        columns,
    )
    return DistanceHealth(summary, O.histogram(dist, "dist", bins), advice)


# ---------------------------------------------------------------- performance


def performance(collections: list[Collection]) -> DataFrame:
    """Estimated sizes: 4 bytes a dimension, half as much again for the index, 200 bytes of metadata
    a row, a tenth more on disk."""
    d = F.coalesce(F.col("vector_dimensions"), F.lit(0)).cast("bigint")
    raw = F.col("count") * d * 4
    memory = raw + F.expr("(count * coalesce(vector_dimensions, 0) * 4) div 2") + F.col("count") * 200
    return (
        collection_info(collections)
        .withColumn("estimated_memory_bytes", memory)
        .select(
            "name", F.col("count").alias("vector_count"), F.col("vector_dimensions").alias("dimensions"), "estimated_memory_bytes",
            F.expr("estimated_memory_bytes + estimated_memory_bytes div 10").alias("estimated_storage_bytes"),
            F.expr("CASE WHEN count > 0 THEN estimated_memory_bytes div count ELSE 0L END").alias("bytes_per_vector"),
        )
    )


def performance_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.sum("vector_count").alias("total_vectors"), F.sum("estimated_memory_bytes").alias("total_memory_bytes"),
        F.sum("estimated_storage_bytes").alias("total_storage_bytes"),
    )


def recommendations(metrics: DataFrame) -> DataFrame:
    """``(category, priority, message, potential_savings)``; savings are of the collection's own memory."""
    dims, n, own = F.col("dimensions"), F.col("vector_count"), F.col("estimated_memory_bytes")
    factor = F.when(dims > 1536, 4).otherwise(2)
    none = F.lit(None).cast("string")
    wide = metrics.where(dims > 768).select(
        F.lit("dimensionality").alias("category"), F.when(dims > 1536, "high").otherwise("medium").alias("priority"),
        F.format_string(M.WIDE, "name", dims).alias("message"),
        F.format_string(M.WIDE_SAVINGS, factor, X.format_bytes(F.floor(own / factor).cast("bigint"))).alias("potential_savings"),
    )
    large = metrics.where(n > 100_000).select(
        F.lit("scaling").alias("category"), F.when(n > 1_000_000, "high").otherwise("medium").alias("priority"),
        F.format_string(M.LARGE, "name", X.format_count(n)).alias("message"),
        none.alias("potential_savings"),
    )
    total = performance_totals(metrics)
    memory = total.where(F.col("total_memory_bytes") > 8 * 1024**3).select(
        F.lit("memory").alias("category"), F.lit("high").alias("priority"),
        F.format_string(M.MEMORY, X.format_bytes(F.col("total_memory_bytes"))).alias("message"),
        none.alias("potential_savings"),
    )
    index = total.where(F.col("total_vectors") > 10_000).select(
        F.lit("indexing").alias("category"), F.lit("low").alias("priority"),
        F.lit(M.INDEX).alias("message"), none.alias("potential_savings"),
    )
    return reduce(DataFrame.unionByName, [wide, large, memory, index])


# ---------------------------------------------------------------- health


@dataclass(frozen=True)
class Health:
    summary: DataFrame
    collections: DataFrame
    issues: DataFrame


HEALTH_TIME_FIELDS = ("created_at", "updated_at", "timestamp", "_creationTimeUnix", "createdAt")  # fixed values
HEALTH_TEXT_FIELDS = ("text", "content", "body")  # fixed values
PENALTY = {"critical": 25, "error": 15, "warning": 5, "info": 1}  # fixed values


def collection_health(coll: Collection, as_of: datetime, sample_rows: int | None = None) -> tuple[tuple, list[tuple]]:
    """Facts and issues of one collection from one scan; ``sample_rows`` looks at the first rows by id
    only and scales the counts up."""
    seen = coll if sample_rows is None else coll.with_df(coll.df.orderBy("id").limit(sample_rows))
    norm = V.norm(F.col("vector"))
    time_fields = [f for f in HEALTH_TIME_FIELDS if f in coll.fields]
    text_fields = [f for f in HEALTH_TEXT_FIELDS if f in coll.fields]
    epochs = {f: times.epoch_micros(coll.field(f), coll.types[f]) for f in time_fields}
    total = F.count(F.lit(1)) * len(coll.fields)
    filled = F.coalesce(F.sum(coll.filled_count()), F.lit(0))
    facts = seen.df.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dims"),
        F.coalesce(F.try_divide(filled.cast("double"), total), F.lit(1.0)).alias("completeness"),
        F.count_if(orphans.empty_content(coll)).alias("orphans"),
        F.count_if(F.col("vector").isNull()).alias("missing"),
        F.count(norm).alias("norms"), F.stddev_pop(norm).alias("std"),
        F.skewness(norm).alias("skewness"), F.kurtosis(norm).alias("kurtosis"),
        *[F.count(epochs[f]).alias(f"time_{f}") for f in time_fields],
        *[F.count(coll.field(f)).alias(f"text_{f}") for f in text_fields],
        *[F.count_if(X.byte_length(coll.field(f)) < 50).alias(f"short_{f}") for f in text_fields],
    ).first()
    if sample_rows is None:
        n, width = facts.rows, facts.dims
    else:
        n, width = coll.df.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dims = width if width and width > 0 else 0
    scale = n / facts.rows if facts.rows else 0.0
    issues: list[tuple] = []

    def add(severity, name, affected, *values):
        category, message, advice = M.HEALTH[name]
        issues.append((coll.name, severity, category, message.format(*values), affected, advice))

    c = facts.completeness
    if c < 0.8:
        add("warning" if c < 0.5 else "info", "completeness", int((1 - c) * n), c * 100)
    if facts.orphans:
        e = int(facts.orphans * scale)
        add("warning", "empty", e, e)
    if facts.missing:
        e = int(facts.missing * scale)
        add("error", "missing", e, e)
    if dims > 1536:
        add("info", "wide", None, dims)
    if n > 100_000:
        add("info", "large", None, n)
    if facts.rows > 10:
        if facts.norms >= 10 and facts["std"] > 0:
            m = facts.norms
            bc = (facts.skewness**2 + 1) / (facts.kurtosis + 3.0 * (m - 1) ** 2 / (max(1, m - 2) * max(1, m - 3)))
            if bc > 0.6:
                add("warning", "mixed", None, bc)
        if facts.norms >= 20:
            ratio = _discrimination(seen)
            if ratio is not None and ratio < 0.3:
                add("warning", "distance", None, ratio)
        field = next((f for f in time_fields if facts[f"time_{f}"] >= 5), None)
        if field:
            days = seen.df.select(times.whole_days(epochs[field], as_of).alias("d")).where("d IS NOT NULL")
            (age,) = staleness.ranked(days.groupBy("d").agg(F.count(F.lit(1)).alias("n")), "d", [facts[f"time_{field}"] // 2])
            if age > 180:
                add("info", "stale", None, age, field)
        field = next((f for f in text_fields if facts[f"text_{f}"] >= 5), None)
        if field:
            share = facts[f"short_{field}"] / facts[f"text_{field}"]
            if share > 0.3:
                add("warning", "short", int(share * n), share * 100)
    row = (coll.name, n, dims or None, n * dims * 4 + n * 200, c, facts.orphans, facts.missing)
    return row, issues


def _discrimination(coll: Collection, pairs: int = distances.SAMPLE_PAIRS) -> float | None:
    """(max - min) / mean distance over evenly strided pairs of the whole collection; pairs of unequal widths have no distance."""
    d = distances.strided_pairs(coll.vectors(), pairs).agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.avg("dist").alias("mean")).first()
    return (d.hi - d.lo) / d.mean if d.mean else None


def health(collections: list[Collection], as_of: datetime | None = None, sample_rows: int | None = None, count_duplicates: bool = False) -> Health:
    """Score and grade over collections, with the facts and issues behind them.

    ``count_duplicates`` fills ``duplicate_count`` by running duplicate detection (0 otherwise).
    """
    spark = collections[0].df.sparkSession
    moment = as_of or datetime.now(timezone.utc)
    results = [collection_health(c, moment, sample_rows) for c in collections]
    surplus = [0] * len(collections)
    if count_duplicates:
        for i, c in enumerate(collections):
            totals = find_duplicates(c).totals.agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("s"))
            surplus[i] = totals.first().s
    facts = spark.createDataFrame(
        [(*row[:6], d) for (row, _), d in zip(results, surplus)],
        "name string, vector_count bigint, dimensions int, estimated_storage_bytes bigint, metadata_completeness double, orphan_count bigint, duplicate_count bigint",
    )
    issues = spark.createDataFrame([i for _, found in results for i in found], ISSUE)
    return Health(health_summary(facts, issues, moment), facts, issues)


def health_summary(facts: DataFrame, issues: DataFrame, as_of: datetime) -> DataFrame:
    """100 less the penalties of issues and of low completeness, cut to 0..100 and truncated."""
    weight = reduce(lambda w, s: w.when(F.col("severity") == s, PENALTY[s]), PENALTY, F)
    by_issue = issues.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("issue_count"))
    c = F.col("metadata_completeness")
    by_fill = facts.agg(
        F.coalesce(F.sum(F.when(c < 0.5, 10).when(c < 0.8, 5).otherwise(0)), F.lit(0)).alias("q"),
        F.coalesce(F.sum("vector_count"), F.lit(0)).alias("total_vectors"),
        F.coalesce(F.sum("estimated_storage_bytes"), F.lit(0)).alias("estimated_storage_bytes"),
    )
    both = by_issue.withColumn("one", F.lit(1)).join(by_fill.withColumn("one", F.lit(1)), "one")
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("p") - F.col("q"))).cast("int")
    return both.select(
        score.alias("score"), grade(score).alias("grade"), "total_vectors", "estimated_storage_bytes", "issue_count",
        F.lit(as_of.isoformat()).alias("analyzed_at"),
    )


def global_issues(issues: DataFrame) -> DataFrame:
    """The overall issue list: messages prefixed with their collection."""
    return issues.withColumn("message", F.concat(F.lit("["), F.col("collection"), F.lit("] "), F.col("message")))


# ---------------------------------------------------------------- overlays and projections


def overlay_staleness(ages: DataFrame) -> DataFrame:
    """``(id, mode, value, label)``: age relative to the oldest record (at least one day)."""
    oldest = max(ages.agg(F.max("age_days")).first()[0] or 0.0, 1.0)
    ratio = F.least(F.col("age_days") / F.lit(oldest), F.lit(1.0))
    return ages.select("id", F.lit("staleness").alias("mode"), ratio.alias("value"), F.round("age_days", 1).cast("string").alias("label"))


def overlay_duplicates(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Value = number of the group in (kind, first id) order."""
    numbered = O.with_ordinal(groups.select("kind", "first_id", "group_id"), "kind", "first_id", name="g")
    return members.join(numbered, ["kind", "first_id"]).select(
        "id", F.lit("duplicates").alias("mode"), F.col("g").cast("double").alias("value"), F.col("group_id").alias("label")
    )


def overlay_anomalies(found: DataFrame) -> DataFrame:
    return found.select("id", F.lit("anomaly").alias("mode"), F.col("anomaly_score").alias("value"), F.array_join("reasons", ";").alias("label"))


def overlay_models(norm_rows: DataFrame, groups: clusters.NormGroups | None) -> DataFrame:
    """Every record of a model group, not only its sample ids."""
    g = F.lit(0) if groups is None else groups.group_of(F.col("norm"))
    return norm_rows.select("id", F.lit("model-groups").alias("mode"), g.cast("double").alias("value"), F.concat(F.lit("Group #"), g.cast("string")).alias("label"))


def normalised_distance(hits: DataFrame, column: str = "dist") -> DataFrame:
    """Min-max normalised distance of search hits: null stays null, equal distances give 0."""
    span = hits.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = span.lo, span.hi
    d = F.col(column)
    if lo is None or lo == hi:
        value = F.when(d.isNotNull(), F.lit(0.0))
    else:
        value = (d - F.lit(lo)) / F.lit(hi - lo)
    return hits.withColumn("normalised", value)


def attach_coordinates(hits: DataFrame, coords: DataFrame) -> DataFrame:
    """Hits with ``x, y, z``; hits without coordinates lie at the origin."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("x", "y", "z")}
    return hits.join(coords.select("id", "x", "y", "z"), "id", "left").select(*hits.columns, *zero.values())


def vectors_with_projection(coll: Collection, method: str = "umap", limit: int | None = None, offset: int = 0, epochs: int | None = None) -> DataFrame:
    """A page of the collection with its coordinates; fewer than four embedded rows lie at the origin."""
    rows = coll.df.orderBy("id").offset(offset).limit(limit) if limit is not None else coll.df
    return layout.project_collection(coll.with_df(rows), method, epochs)




def search_text(coll: Collection, texts: DataFrame, k: int = 20, field: str | None = None, encode=hashing_encoder) -> DataFrame:
    """``(query, id, rank, dist)`` for query texts (columns ``query``, ``text``) by cosine distance.

    The stored vectors are searched when ``field`` is None, so ``encode`` must be the model behind
    them; otherwise the text of ``field`` is encoded as well.
    """
    queries = encode(texts.select("query", "text"), "text").select("query", "vector")
    if field is None:
        rows = coll.vectors()
    else:
        rows = encode(coll.df.select("id", coll.field(field).alias("text")).where("text IS NOT NULL"), "text").select("id", "vector")
    return search(rows, queries, k, "cosine", exclude_self=False)


def export_collection(
    collections: list[Collection], name: str, data_type: str, fmt: str, path: str, as_of: datetime,
    include_vectors: bool = False, limit: int | None = None,
) -> DataFrame:
    """Write an export and return its manifest. ``data_type``: vectors, orphans, duplicates, outliers
    or health_report; the name ``*`` reports on all collections. Analyses run with their defaults."""
    if data_type == "health_report":
        chosen = collections if name in ("", "*") else [find_collection(collections, name)]
        report = health(chosen, as_of)
        rows = export.health_rows(report.collections, report.issues, report.summary)
        counted = report.collections
    else:
        coll = find_collection(collections, name)
        if data_type == "vectors":
            rows = export.vector_rows(coll, include_vectors, limit)
        elif data_type == "orphans":
            rows = export.orphan_rows(find_orphans(coll))
        elif data_type == "duplicates":
            found = find_duplicates(coll)
            rows = export.duplicate_rows(found.groups, duplicates.member_lists(found.members))
        elif data_type == "outliers":
            rows = export.outlier_rows(distribution(coll).outliers, coll)
        else:
            raise ValueError(f"unknown export '{data_type}'")
        counted = rows
    export.write(rows, path, fmt)
    return export.manifest(counted, name, data_type, fmt, as_of)
