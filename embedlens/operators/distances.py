"""Distance health: evenly strided pair samples, discrimination, recall of an approximate search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.functions import vectors as V
from embedlens.operators.ordering import with_ordinal
from embedlens.operators.pairs import search
from embedlens.session import cut

SAMPLE_PAIRS = 10_000  # fixed value: default
RECALL_QUERIES = 50  # fixed value
BROADCAST_PAIRS = 1_000_000


def pair_of(t: Column, n: int) -> tuple[Column, Column]:
    """(i, j) of the t-th pair in the order (0,1), (0,2), ..., (n-2,n-1).

    Row i starts at t = i*(2n-i-1)/2. The square root finds i up to rounding; a step down or up
    makes it exact.
    """
    starts = lambda i: (i * (2 * n - 1 - i) / 2).cast("bigint")
    guess = F.floor(((2 * n - 1) - F.sqrt(F.pow(F.lit(2.0 * n - 1), 2) - 8.0 * t)) / 2).cast("bigint")
    i = F.when(starts(guess) > t, guess - 1).when(starts(guess + 1) <= t, guess + 1).otherwise(guess)
    return i, t - starts(i) + i + 1


def strided_pairs(vectors: DataFrame, max_pairs: int = SAMPLE_PAIRS, n: int | None = None) -> DataFrame:
    """``(t, id_a, id_b, dist)``: every step-th pair of rows in id order, at most ``max_pairs``;
    all pairs when there are no more than that. Pairs are computed, not enumerated."""
    order = with_ordinal(vectors.select("id"), "id", name="o")  # ids only: no vector is moved
    n = order.count() if n is None else n
    total = n * (n - 1) // 2
    step = max(1, total // max_pairs) if total else 1
    m = min(max_pairs, total)
    t = (F.col("id") * step).alias("t")
    i, j = pair_of(F.col("t"), max(n, 2))
    wanted = vectors.sparkSession.range(m).select(t).select("t", i.alias("i"), j.alias("j"))
    a = order.select(F.col("o").alias("i"), F.col("id").alias("id_a"))
    b = order.select(F.col("o").alias("j"), F.col("id").alias("id_b"))
    pairs = cut(wanted.join(a, "i").join(b, "j").select("t", "id_a", "id_b"))
    ends = pairs.select("t", F.col("id_a").alias("id"), F.lit(0).alias("end")).unionAll(
        pairs.select("t", F.col("id_b").alias("id"), F.lit(1).alias("end"))
    )
    # 2 * max_pairs short rows, a number the caller sets
    ends = F.broadcast(ends) if m <= BROADCAST_PAIRS else ends
    met = vectors.select("id", "vector").join(ends, "id").groupBy("t").agg(
        F.min_by("id", "end").alias("id_a"), F.max_by("id", "end").alias("id_b"),
        F.min_by("vector", "end").alias("va"), F.max_by("vector", "end").alias("vb"),
    )
    return met.select("t", "id_a", "id_b", V.euclidean(F.col("va"), F.col("vb")).alias("dist"))


def discrimination(lo: Column, hi: Column, mean: Column) -> Column:
    """(max - min) / mean, clamped to 0..2 and halved."""
    ratio = F.coalesce(F.try_divide(hi - lo, mean), F.lit(0.0))
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), ratio)) / 2.0


def recall_queries(vectors: DataFrame, n: int) -> DataFrame:
    """Up to 50 evenly spaced rows in id order, as ``(query, vector)``."""
    picked = min(RECALL_QUERIES, n)
    step = max(1, n // max(picked, 1))
    order = with_ordinal(vectors.select("id"), "id", name="o")
    hit = order.where((F.col("o") % step == 0) & (F.col("o") < step * picked)).select("id")
    return vectors.join(F.broadcast(hit), "id").select(F.col("id").alias("query"), "vector")  # at most fifty ids


def recall(vectors: DataFrame, approximate: DataFrame, k: int, n: int) -> DataFrame:
    """``(k, recall_at_k, samples_tested)`` of ``approximate (src, dst)`` against exact neighbours.

    Queries are the same evenly spaced rows on both sides; a query without approximate neighbours
    counts as tested with recall 0.
    """
    queries = recall_queries(vectors, n)
    exact = search(vectors, queries, k).select(F.col("query").alias("src"), F.col("id").alias("dst"))
    hits = exact.join(approximate.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    found = hits.groupBy("src").agg(F.count(F.lit(1)).alias("h"))
    per_query = exact.select("src").distinct().join(found, "src", "left")
    return per_query.agg(
        F.lit(k).alias("k"),
        F.avg(F.coalesce("h", F.lit(0)) / F.lit(float(k))).alias("recall_at_k"),
        F.count(F.lit(1)).alias("samples_tested"),
    )
