"""Exports: CSV or JSON files of vectors, orphans, duplicates, outliers and health reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.functions import text as X
from embedlens.functions import vectors as V
from embedlens.sources.collections import Collection


def vector_rows(coll: Collection, include_vectors: bool = False, limit: int | None = None) -> DataFrame:
    """``id[, vector], metadata`` of the whole collection; with a limit, of its first rows by id."""
    rows = coll.df if limit is None else coll.df.orderBy("id").limit(limit)
    columns = [V.vector_text(F.col("vector")).alias("vector")] if include_vectors else []
    return rows.select(F.col("id").cast("string").alias("id"), *columns, coll.metadata_json().alias("metadata"))


def orphan_rows(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").cast("string").alias("id"), "reason", F.array_join("missing_fields", ";").alias("missing_fields"),
        F.coalesce("last_updated", F.lit("")).alias("last_updated"), "metadata",
    )


def duplicate_rows(groups: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per group and part; groups of up to a thousand members have part 0 only."""
    return groups.join(lists, ["kind", "first_id"]).select(
        "group_id", F.col("kind").alias("type"), "similarity", "part", "vector_ids", "sample_metadata"
    )


def outlier_rows(found: DataFrame, coll: Collection) -> DataFrame:
    meta = coll.df.select("id", coll.metadata_json().alias("metadata"))
    return found.join(meta, "id").select(F.col("id").cast("string").alias("id"), "distance_to_cluster", "outlier_score", "metadata")


def health_rows(facts: DataFrame, issues: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per collection and a SUMMARY row of the same eight columns."""
    line = F.concat(F.lit("["), F.initcap("severity"), F.lit("] "), F.col("message"))
    # issues are a handful per collection, kept in their order of detection
    numbered = issues.withColumn("i", F.monotonically_increasing_id())
    joined = numbered.groupBy(F.col("collection").alias("name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda s: s["t"]), "; ").alias("issues")
    )
    rows = facts.join(joined, "name", "left").select(
        F.col("name").alias("collection"), F.col("vector_count").cast("string").alias("vector_count"),
        F.coalesce(F.col("dimensions").cast("string"), F.lit("")).alias("dimensions"),
        F.col("estimated_storage_bytes").cast("string").alias("storage_bytes"),
        X.percent(F.col("metadata_completeness"), 1).alias("completeness"), F.col("orphan_count").cast("string").alias("orphans"),
        F.col("duplicate_count").cast("string").alias("duplicates"), F.coalesce("issues", F.lit("")).alias("issues"),
    )
    blank = F.lit("")
    total = summary.select(
        F.lit("SUMMARY").alias("collection"), F.col("total_vectors").cast("string").alias("vector_count"), blank.alias("dimensions"),
        F.col("estimated_storage_bytes").cast("string").alias("storage_bytes"), blank.alias("completeness"), blank.alias("orphans"),
        blank.alias("duplicates"), F.format_string("Score: %d (%s)", "score", "grade").alias("issues"),
    )
    return rows.unionByName(total)


def write(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write files in parallel. CSV fields are quoted where needed, quotes doubled."""
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format '{fmt}'")


def manifest(rows: DataFrame, collection: str, data_type: str, fmt: str, as_of: datetime) -> DataFrame:
    """``(format, data_type, record_count, filename)`` of an export."""
    stamp = as_of.strftime("%Y%m%d_%H%M%S")
    everything = data_type == "health_report" and collection in ("", "*")
    name = f"health_report_{stamp}.{fmt}" if everything else f"{collection}_{data_type}_{stamp}.{fmt}"
    return rows.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(fmt).alias("format"), F.lit(data_type).alias("data_type"), "record_count", F.lit(name).alias("filename")
    )
