"""Collections derived from the given tables, for the registered queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlens.session import cut
from embedlens.sources.collections import Collection

AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)
TEXT_FIELDS = ("label", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vector, label``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def plain(spark, sf_dir) -> Collection:
    return Collection(embeddings(spark, sf_dir), ("label",), "plain")


def text_collection(spark, sf_dir) -> Collection:
    """Vectors with texts, either side possibly missing; no timestamps."""
    e, d = embeddings(spark, sf_dir), table(spark, sf_dir, "documents")
    rows = e.join(d, e["id"] == d["doc_id"], "full").select(F.coalesce("id", "doc_id").alias("id"), "vector", *TEXT_FIELDS)
    return Collection(rows, TEXT_FIELDS, "text_collection")


def collection(spark, sf_dir) -> Collection:
    """``text_collection`` with a creation time from the events."""
    c = text_collection(spark, sf_dir)
    v = table(spark, sf_dir, "events").select("event_id", "ts")
    rows = c.df.join(v, c.df["id"] == v["event_id"], "left")
    created = F.col("ts") - F.make_dt_interval((F.col("id") % 4 * 100).cast("int"))
    return Collection(rows.select(*c.df.columns, created.alias("created_at")), (*TEXT_FIELDS, "created_at"), "collection")


def collection_dup(spark, sf_dir) -> Collection:
    """Vectors with exact copies of every tenth record and near, contradicting copies of the next."""
    base = text_collection(spark, sf_dir).df.where("vector IS NOT NULL")
    exact = base.where("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000)
    moved = F.transform("vector", lambda x, i: F.when(i == 0, x + 0.05).otherwise(x))
    near = base.where("id % 10 = 1").withColumn("id", F.col("id") + 2_000_000).withColumn("vector", moved)
    near = near.withColumn("label", F.col("label") + 1)
    # written once, as a stored collection would be
    return Collection(cut(base.unionByName(exact).unionByName(near)), TEXT_FIELDS, "collection_dup")


def collection_mixed(spark, sf_dir) -> Collection:
    """Two embedding models: vectors of odd labels are twice as long."""
    scale = F.when(F.col("label") % 2 == 0, 1.0).otherwise(2.0)
    rows = embeddings(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x * scale))
    return Collection(rows, ("label",), "collection_mixed")


def chunk_collection(spark, sf_dir) -> Collection:
    d = table(spark, sf_dir, "documents")
    return Collection(d.select(F.col("doc_id").alias("id"), F.lit(None).cast("array<double>").alias("vector"), "text", "lang", "source"), ("text", "lang", "source"), "chunks")


def json_collection(spark, sf_dir) -> Collection:
    """Documents with JSON metadata whose property ``f`` takes every kind of empty value."""
    kind = F.col("doc_id") % 8
    doc = (
        F.when(kind == 0, '{"f":null}').when(kind == 1, '{"f":"  "}').when(kind == 2, '{"f":[]}').when(kind == 3, '{"f":{}}')
        .when(kind == 4, '{"f":"[]"}').when(kind == 5, "{}").when(kind == 6, '{"f":0}')
        .otherwise(F.to_json(F.struct(F.col("source").alias("f"))))
    )
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("array<double>").alias("vector"), doc.alias("metadata"))
    return Collection.of_json(d, "metadata", ("f",), "json")


def points(spark, sf_dir) -> DataFrame:
    """Each vector's first three elements as a point."""
    return embeddings(spark, sf_dir).select("id", *[F.col("vector")[i].alias(c) for i, c in enumerate("xyz")])


def by_label(spark, sf_dir) -> DataFrame:
    """``id, vector, cluster``: labels as a given clustering."""
    return embeddings(spark, sf_dir).select("id", "vector", F.col("label").alias("cluster"))
