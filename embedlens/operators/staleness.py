"""Ages of records: field detection, percentiles, dead zones.

Ages are counted in whole hours, so everything about their distribution comes from an hour histogram:
one row per distinct hour (under nine thousand a year), however many records there are.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import times
from embedlens.operators.clusters import first_ids
from embedlens.operators.ordering import gap_runs, percentile_ranks, running_total, with_ordinal
from embedlens.sources.collections import Collection

STALE_DAYS = 90  # fixed value: default
ZONE_GAP_DAYS = 30.0  # fixed value
ZONE_MIN_SIZE = 3  # fixed value
FEW_VALUES = 10_000_000  # distinct whole numbers that one task puts in order
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.99)  # fixed values


def timestamp_field(coll: Collection) -> str | None:
    """First candidate field that holds a point in time in any row."""
    present = [f for f in times.TIMESTAMP_FIELDS if f in coll.fields]
    if not present:
        return None
    found = coll.df.agg(*[
        F.coalesce(F.bool_or(times.epoch_micros(coll.field(f), coll.types[f]).isNotNull()), F.lit(False)).alias(f)
        for f in present
    ]).first()
    return next((f for f in present if found[f]), None)


def record_ages(coll: Collection, field: str, as_of: datetime) -> DataFrame:
    """``(id, age_hours, age_days)`` of records with a usable timestamp."""
    epoch = times.epoch_micros(coll.field(field), coll.types[field])
    aged = coll.df.select("id", times.age_hours(epoch, as_of).alias("age_hours")).where("age_hours IS NOT NULL")
    return aged.withColumn("age_days", F.col("age_hours") / 24.0)


def hour_counts(ages: DataFrame) -> DataFrame:
    """``(age_hours, n)``; bounded by the hours the data spans."""
    return ages.groupBy("age_hours").agg(F.count(F.lit(1)).alias("n"))


def _few(counts: DataFrame, value: str) -> bool:
    """Do whole numbers span so little that one task can hold all of them, whatever the number of rows?"""
    span = counts.agg((F.max(value) - F.min(value)).alias("s")).first().s
    return span is None or span <= FEW_VALUES


def ranked(counts: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """Values at 0-based ranks, read off running counts ``(value, n)`` of whole numbers.

    Hours of a thousand years fit one window; dates in a wrong unit spread beyond and are summed over range partitions."""
    if _few(counts, value):
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value)))
    else:
        upto = running_total(counts, value, "n")
    return list(upto.agg(*[F.min(F.when(F.col("upto") > r, F.col(value))).alias(f"r{i}") for i, r in enumerate(ranks)]).first())


def age_percentiles(ages: DataFrame, shares: tuple = PERCENTILES, n: int | None = None) -> list[float]:
    """Ages in days at index floor(p*n)."""
    n = ages.count() if n is None else n
    if not n:
        return [0.0] * len(shares)
    return [h / 24.0 for h in ranked(hour_counts(ages), "age_hours", percentile_ranks(n, list(shares)))]


def dead_zones(ages: DataFrame, stale_days: float = STALE_DAYS) -> DataFrame:
    """Runs of stale ages without a gap over 30 days and with at least three records:
    ``(zone, count, min_age_days, max_age_days, mean_age_days, sample_ids)``."""
    stale = ages.where(F.col("age_days") > stale_days)
    hours = hour_counts(stale)
    limit = ZONE_GAP_DAYS * 24.0
    if few := _few(hours, "age_hours"):
        by_age = Window.orderBy("age_hours")
        gap = F.col("age_hours") - F.lag("age_hours").over(by_age)
        runs = hours.withColumn("gap", gap).withColumn("run", F.sum((F.coalesce("gap", F.lit(0)) > limit).cast("int")).over(by_age))
    else:
        runs = gap_runs(hours, "age_hours", limit)
    zones = (
        runs.groupBy("run")
        .agg(
            F.sum("n").alias("count"), F.min("age_hours").alias("lo"), F.max("age_hours").alias("hi"),
            (F.sum(F.col("n") * F.col("age_hours")) / F.sum("n") / 24.0).alias("mean_age_days"),
        )
        .where(F.col("count") >= ZONE_MIN_SIZE)
    )
    zones = zones.withColumn("zone", F.row_number().over(Window.orderBy("run")) - 1) if few else with_ordinal(zones, "run", name="zone").withColumn("zone", F.col("zone").cast("int"))
    zone_of_hour = runs.join(zones.select("run", "zone"), "run").select("age_hours", "zone")
    inside = stale.join(zone_of_hour, "age_hours")
    samples = first_ids(inside, "zone", ("age_hours", "id"))
    return zones.join(samples, "zone").select(
        "zone", "count", (F.col("lo") / 24.0).alias("min_age_days"), (F.col("hi") / 24.0).alias("max_age_days"),
        "mean_age_days", "sample_ids",
    )
