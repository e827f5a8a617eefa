"""Stored projections: one folder per collection, id set, method and parameters, published by a manifest row written last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlens.sources.collections import Collection, id_fingerprint
from embedlens.sources.layouts import read_table


def projection_key(coll: Collection, method: str, n_neighbors: int | None = None, min_dist: float | None = None, perplexity: float | None = None) -> str:
    """Key with parameters in fixed precision: min_dist in thousandths, perplexity in tenths."""
    ids = id_fingerprint(coll.df).first()
    millis = None if min_dist is None else int(min_dist * 1000)
    tenths = None if perplexity is None else int(perplexity * 10)
    return "-".join(str(p) for p in (coll.name, ids.n, f"{ids.id_hash & (2**64 - 1):016x}", method, n_neighbors, millis, tenths))


def stored_projection(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The projection published under the key (an empty one too), or none."""
    table = read_table(spark, f"{path}/manifest")
    row = None if table is None else table.where(F.col("cache_key") == key).orderBy("folder").first()
    return None if row is None else spark.read.parquet(f"{path}/data/{row.folder}")


def projection(coll: Collection, path: str, method: str, compute: Callable[[], DataFrame], **params) -> DataFrame:
    """The stored projection of this id set and these parameters, computed and stored if missing.

    Rows go to a folder of their own; the manifest row that makes it known is written after them, as one file. A run that fails on the way
    leaves nothing that a reader would see, and of two runs at once readers agree on one."""
    spark, key = coll.df.sparkSession, projection_key(coll, method, **params)
    found = stored_projection(spark, path, key)
    if found is None:
        folder = uuid.uuid4().hex
        compute().write.parquet(f"{path}/data/{folder}")
        spark.createDataFrame([(key, folder)], "cache_key string, folder string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        found = stored_projection(spark, path, key)
    return found
