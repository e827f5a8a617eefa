"""Global order without a global window: ordinals, exact order statistics, histograms, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlens.session import cut

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number within it below
_BINS = 4096


def _placed(df: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """Rows in key order over range partitions, numbered ``_at`` within each, and the number of a row's partition.

    The sorted rows are checkpointed, because a range shuffle that runs twice may cut its ranges differently."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return cut(ordered.withColumn("_at", F.monotonically_increasing_id())), F.shiftright("_at", _LOCAL_BITS)


def _carry(placed: DataFrame, part: Column, rows: list[tuple], schema: str) -> DataFrame:
    """What each partition starts from, joined to its rows: one row per partition is broadcast."""
    starts = placed.sparkSession.createDataFrame(rows, f"_part bigint, {schema}")
    return placed.join(F.broadcast(starts), part == F.col("_part"))


def with_ordinal(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """Number rows 0..n-1 in key order.

    One range shuffle sorts the rows; the number is the row's place in its partition plus the rows of
    earlier partitions (one count per partition, broadcast).
    """
    placed, part = _placed(df, *keys)
    counts = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, start = [], 0
    for p, n in counts:  # one row per partition
        rows.append((p, start))
        start += n
    local = F.col("_at") - F.shiftleft(part, _LOCAL_BITS)
    joined = _carry(placed, part, rows, "_start bigint")
    return joined.withColumn(name, F.col("_start") + local).drop("_at", "_part", "_start")


def running_total(df: DataFrame, key: str, n: str, name: str = "upto") -> DataFrame:
    """Adds the sum of ``n`` over all rows up to this one in the order of ``key`` (different in each row): totals of range
    partitions are carried over, sums inside them are windows of one partition each."""
    placed, part = _placed(df, key)
    totals = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.sum(n).alias("n")).collect())
    rows, start = [], 0
    for p, total in totals:
        rows.append((p, start))
        start += total
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy("_at"))
    return _carry(placed, part, rows, "_start bigint").withColumn(name, F.col("_start") + inside).drop("_at", "_part", "_start")


def gap_runs(df: DataFrame, key: str, gap: float, name: str = "run") -> DataFrame:
    """Numbers the runs of rows between which ``key`` never grows by more than ``gap``, in its order. A run may go on over range
    partitions: each carries over the last key and the number of runs that ended before it."""
    placed, part = _placed(df, key)
    placed = placed.withColumn("_part", part)
    inside = Window.partitionBy("_part").orderBy("_at")
    broken = placed.withColumn("_new", (F.coalesce(F.col(key) - F.lag(key).over(inside), F.lit(0)) > gap).cast("bigint"))
    seen = broken.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("_new").alias("n")).collect()
    rows, before, last = [], 0, None
    for r in sorted(seen, key=lambda r: r["_part"]):  # one row per partition
        before += last is not None and r.lo - last > gap
        rows.append((r["_part"], before))
        before, last = before + r.n, r.hi
    starts = placed.sparkSession.createDataFrame(rows, "_part bigint, _start bigint")
    run = F.col("_start") + F.sum("_new").over(inside)
    return broken.join(F.broadcast(starts), "_part").withColumn(name, run).drop("_at", "_part", "_start", "_new")


def value_at_ranks(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """Exact values at 0-based ranks of the sorted column, by repeated histograms.

    Every pass counts rows in at most 4096 bins per rank and keeps the bin that holds the rank, until
    the bin has one value. Nothing is sorted and no pass moves more than the bin counts. Infinite values
    and NaN (the greatest) are counted apart; a span too narrow to be cut holds at most 4096 different
    numbers, which are counted singly.
    """
    value = F.col(column).cast("double")
    base = df.where(F.col(column).isNotNull()).select(value.alias("v"))
    infinite = float("inf")
    low, high, nan = F.col("v") == -infinite, F.col("v") == infinite, F.isnan("v")
    finite = F.when(~(low | high | nan), F.col("v"))
    first = base.agg(
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count_if(low).alias("low"), F.count(finite).alias("n"), F.count_if(high).alias("high")
    ).first()
    edges = [(first.low, -infinite), (first.low + first.n, None), (first.low + first.n + first.high, infinite)]
    placed = [next((v for upto, v in edges if r < upto), float("nan")) for r in ranks]
    found = iter(_finite_at_ranks(base.where(finite.isNotNull()), first.lo, first.hi, [r - first.low for r, v in zip(ranks, placed) if v is None]))
    return [next(found) if v is None else v for v in placed]


def _finite_at_ranks(base: DataFrame, low: float, high: float, ranks: list[int]) -> list[float]:
    spans = [(low, high, r) for r in ranks]
    while any(lo != hi for lo, hi, _ in spans):
        open_spans = sorted({(lo, hi) for lo, hi, _ in spans if lo != hi})
        # spans are bins of earlier passes: equal or disjoint, so a row is in at most one
        tag = F
        for i, (lo, hi) in enumerate(open_spans):
            slot = F.lit(i * _BINS) + bin_of(F.col("v"), lo, hi, _BINS)
            tag = tag.when(F.col("v").between(lo, hi), slot)
        counted = (
            base.groupBy(tag.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .where("slot IS NOT NULL")
            .collect()
        )
        bins = {}
        for row in sorted(counted, key=lambda r: r.slot):
            bins.setdefault(open_spans[row.slot // _BINS], []).append(row)
        for (lo, hi), rows in bins.items():
            if len(rows) == 1 and (rows[0].lo, rows[0].hi) == (lo, hi):  # bins of no width
                single = base.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
                bins[(lo, hi)] = single.select("n", F.col("v").alias("lo"), F.col("v").alias("hi")).orderBy("lo").collect()
        spans = [_descend(bins[(lo, hi)], r) if lo != hi else (lo, hi, r) for lo, hi, r in spans]
    return [lo for lo, _, _ in spans]


def _descend(bins, rank):
    for row in bins:
        if rank < row.n:
            return row.lo, row.hi, rank
        rank -= row.n
    raise ValueError("rank beyond the last row")


def percentile_ranks(n: int, shares: list[float]) -> list[int]:
    """Index floor(p*n), at most n-1."""
    return [min(int(p * n), n - 1) for p in shares]


def percentiles(df: DataFrame, column: str, shares: list[float], n: int | None = None) -> list[float]:
    n = df.where(F.col(column).isNotNull()).count() if n is None else n
    return value_at_ranks(df, column, percentile_ranks(n, shares)) if n else [0.0] * len(shares)


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std, min, max, skewness and excess kurtosis (population); shape is 0 at zero spread."""
    c = F.col(column).cast("double")
    flat = F.stddev_pop(c) == 0
    return df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.when(flat, 0.0).otherwise(F.coalesce(F.skewness(c), F.lit(0.0))).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.coalesce(F.kurtosis(c), F.lit(0.0))).alias("kurtosis"),
    )


def bin_of(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin number; the last bin is closed. Halves keep the widest spans finite."""
    width = (hi - lo) / bins
    if width == 0:
        return F.lit(0)
    if width == float("inf"):
        v, lo, width = v / 2, lo / 2, (hi / 2 - lo / 2) / bins
    return F.least(F.floor((v - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))


def histogram(df: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """Equal-width histogram ``(bin, min, max, count)`` with empty bins; one bin when all values agree."""
    spark = df.sparkSession
    v = F.col(column).cast("double")
    rows = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(v)
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), rows.cast("bigint").alias("n")).first()
    schema = T.StructType([
        T.StructField("bin", T.IntegerType()), T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()), T.StructField("count", T.LongType()),
    ])
    if not span.n or bins <= 0:
        return spark.createDataFrame([], schema)
    if span.lo == span.hi:
        return spark.createDataFrame([(0, span.lo, span.hi, span.n)], schema)
    width = (span.hi - span.lo) / bins
    counted = (
        df.where(v.isNotNull()).groupBy(bin_of(v, span.lo, span.hi, bins).alias("bin")).agg(rows.cast("bigint").alias("count"))
    )
    frame = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(span.lo) + F.col("id") * F.lit(width)).alias("min"),
        (F.lit(span.lo) + (F.col("id") + 1) * F.lit(width)).alias("max"),
    )
    return frame.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def bimodality(skewness: Column, kurtosis: Column, n: Column) -> Column:
    """Bimodality coefficient, clamped to 0..1."""
    size = n.cast("double")
    spread = F.try_divide(3 * (size - 1) * (size - 1), (size - 2) * (size - 3))
    # a zero denominator makes the coefficient infinite (clamped to 1), an infinite spread makes it 0
    bc = F.coalesce(F.try_divide(skewness * skewness + 1, kurtosis + spread), F.lit(1.0))
    return F.when(spread.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bc)))


def bimodality_unclamped(skewness: Column, kurtosis: Column, n: Column) -> Column:
    """The health check's variant: small denominators are lifted to one and nothing is clamped."""
    size = n.cast("double")
    below = F.greatest(F.lit(1.0), size - 2) * F.greatest(F.lit(1.0), size - 3)
    return F.try_divide(skewness * skewness + 1, kurtosis + 3 * (size - 1) * (size - 1) / below)


def model_confidence(bc: Column) -> Column:
    """How far the coefficient lies above that of a uniform distribution (fixed value 0.555)."""
    return F.when(bc > 0.555, F.least(F.lit(1.0), (bc - 0.555) / 0.445)).otherwise(0.0)


def dimension_stats(vectors: DataFrame) -> DataFrame:
    """Per-dimension mean, std, min, max, variance and share of the total variance."""
    cells = vectors.select(F.posexplode("vector").alias("dim", "v"))
    per_dim = cells.groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"),
        F.max("v").alias("max"), F.var_pop("v").alias("variance"),
    )
    total = F.sum("variance").over(Window.partitionBy())  # one row per vector dimension: small
    return per_dim.withColumn("variance_ratio", F.coalesce(F.try_divide(F.col("variance"), total), F.lit(0.0)))


def effective_dimensions(dims: DataFrame, share: float = 0.9) -> DataFrame:
    """Fewest dimensions, by variance, that hold ``share`` of it. One row per vector dimension: small."""
    rows = dims.agg(F.reverse(F.array_sort(F.collect_list("variance"))).alias("vs"))
    target = F.aggregate("vs", F.lit(0.0), lambda a, v: a + v) * share
    # running total and the number of dimensions taken before it reaches the target
    state = F.aggregate(
        "vs",
        F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("n")),
        lambda a, v: F.when(a["cum"] >= target, a).otherwise(F.struct((a["cum"] + v).alias("cum"), (a["n"] + 1).alias("n"))),
    )
    return rows.select(state["n"].cast("bigint").alias("effective_dims"), F.size("vs").cast("bigint").alias("actual_dims"))
