"""Orphan records: without a vector, with missing fields, with empty content, or stale."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.functions import times
from embedlens.functions.values import is_content_name
from embedlens.sources.collections import Collection

REASONS = ("missing_vector", "missing_metadata", "empty_content", "stale")  # fixed values, first match wins


def classify(
    coll: Collection,
    required: tuple[str, ...] = (),
    content: str | None = None,
    stale_days: int | None = None,
    timestamp: str | None = None,
    as_of: datetime | None = None,
    has_metadata=None,
) -> DataFrame:
    """Orphans as ``(id, reason, missing_fields, last_updated, metadata)``; healthy rows are left out.

    ``has_metadata`` tells rows whose metadata is an object at all; a row without one is an orphan
    only if fields are required.
    """
    has_object = F.lit(True) if has_metadata is None else has_metadata
    text_list = "array<string>"
    absent = F.array_compact(F.array(*[F.when(coll.is_empty(f), F.lit(f)) for f in required])) if required else F.array().cast(text_list)
    everything = F.array(*[F.lit(f) for f in required]).cast(text_list)
    blank = coll.is_empty(content) if content else F.lit(False)
    old = F.lit(False)
    last = F.lit(None).cast("string")
    if timestamp and timestamp in coll.fields:
        last = coll.field(timestamp).cast("string")
        if stale_days is not None and as_of is not None:
            # integers are seconds here, never milliseconds
            epoch = times.epoch_micros(coll.field(timestamp), coll.types[timestamp], millis=False)
            old = F.coalesce(times.whole_days(epoch, as_of) > stale_days, F.lit(False))
    one = lambda name: F.array(F.lit(name)).cast(text_list)
    verdict = (
        F.when(F.col("vector").isNull(), F.struct(F.lit(REASONS[0]).alias("reason"), one("vector").alias("missing_fields")))
        .when(~has_object & F.lit(bool(required)), F.struct(F.lit(REASONS[1]).alias("reason"), everything.alias("missing_fields")))
        .when(has_object & (F.size(absent) > 0), F.struct(F.lit(REASONS[1]).alias("reason"), absent.alias("missing_fields")))
        .when(has_object & blank, F.struct(F.lit(REASONS[2]).alias("reason"), one(content or "").alias("missing_fields")))
        .when(has_object & old, F.struct(F.lit(REASONS[3]).alias("reason"), one(timestamp or "").alias("missing_fields")))
    )
    return (
        coll.df.withColumn("_v", verdict)
        .where("_v IS NOT NULL")
        .select("id", "_v.reason", "_v.missing_fields", last.alias("last_updated"), coll.metadata_json().alias("metadata"))
    )


def by_reason(found: DataFrame) -> DataFrame:
    """``(reason, n)`` for every reason, zero included."""
    every = found.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    counts = found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def empty_content(coll: Collection):
    """Some field named like content is empty although the row has a vector."""
    names = [f for f in coll.fields if is_content_name(f)]
    test = F.lit(False)
    for name in names:
        test = test | coll.is_empty(name)
    return test & F.col("vector").isNotNull()


def completeness(coll: Collection) -> DataFrame:
    """``(rows, filled, completeness, orphan_count, missing_vector_count)``; 1.0 without fields."""
    total = F.count(F.lit(1)) * len(coll.fields)
    filled = F.coalesce(F.sum(coll.filled_count()), F.lit(0)).cast("bigint")
    return coll.df.agg(
        F.count(F.lit(1)).alias("rows"),
        filled.alias("filled"),
        F.coalesce(F.try_divide(filled.cast("double"), total), F.lit(1.0)).alias("completeness"),
        F.count_if(empty_content(coll)).alias("orphan_count"),
        F.count_if(F.col("vector").isNull()).alias("missing_vector_count"),
    )
