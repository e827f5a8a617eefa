"""Duplicate groups: exact vectors, near vectors and equal texts, as one cascade.

A group may hold a third of the collection, so groups are kept tidy: one row per group and one row
per member, never a list of all members in one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.functions import text as X
from embedlens.functions import vectors as V
from embedlens.operators.components import components
from embedlens.operators.pairs import copy_members, same_value, similar_links
from embedlens.session import cut
from embedlens.sources.collections import Collection

THRESHOLD = 0.98  # fixed value: default cosine similarity of near duplicates
IDS_PER_ROW = 1000  # member ids joined into one export cell


def exact_members(vectors: DataFrame) -> DataFrame:
    """``(kind, first_id, id)`` of rows that share their exact vector with another row."""
    return copy_members(vectors).select(F.lit("exact").alias("kind"), F.col("rep").alias("first_id"), "id")


def near_members(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(kind, first_id, id)``: connected components of the graph of similar rows."""
    found = components(similar_links(vectors, threshold))
    return found.select(F.lit("near_duplicate").alias("kind"), F.col("component").alias("first_id"), "id")


def text_members(coll: Collection, field: str, taken: DataFrame | None = None) -> DataFrame:
    """``(kind, first_id, id)`` of rows with equal normalised text, rows without vectors included."""
    rows = coll.df.select("id", X.normal_form(coll.field(field)).alias("form")).where("form IS NOT NULL")
    if taken is not None:
        rows = rows.join(taken.select("id"), "id", "left_anti")
    return same_value(rows, F.col("form")).select(F.lit("text_hash").alias("kind"), F.col("rep").alias("first_id"), "id")


def duplicate_members(
    coll: Collection,
    threshold: float = THRESHOLD,
    exact: bool = True,
    near: bool = True,
    text_field: str | None = None,
) -> DataFrame:
    """Members of all groups. Each stage leaves out what an earlier stage has grouped."""
    stages: list[DataFrame] = []
    vectors = coll.vectors()

    def remaining(rows: DataFrame) -> DataFrame:
        return reduce(lambda r, s: r.join(s.select("id"), "id", "left_anti"), stages, rows)

    if exact:
        stages.append(exact_members(vectors))
    if near:
        stages.append(near_members(remaining(vectors), threshold))
    if text_field:
        taken = reduce(DataFrame.unionByName, stages) if stages else None
        stages.append(text_members(coll, text_field, taken))
    if not stages:
        kind = coll.df.schema["id"].dataType.simpleString()
        return coll.df.sparkSession.createDataFrame([], f"kind string, first_id {kind}, id {kind}")
    return cut(reduce(DataFrame.unionByName, stages))


def duplicate_groups(coll: Collection, members: DataFrame) -> DataFrame:
    """``(group_id, kind, first_id, size, similarity, sample_metadata)``, one row per group.

    The mean similarity over all pairs of a near group comes from the sum of its unit vectors:
    sum over pairs of u_i.u_j = (|sum u|^2 - sum |u_i|^2) / 2. No pair is formed.
    """
    sizes = members.groupBy("kind", "first_id").agg(F.count(F.lit(1)).alias("size"))
    near = members.where("kind = 'near_duplicate'").join(coll.vectors(), "id")
    cells = near.select("first_id", F.posexplode(V.unit(F.col("vector"))).alias("d", "x"))
    per_dim = cells.groupBy("first_id", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = per_dim.groupBy("first_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    total = total.select(F.lit("near_duplicate").alias("kind"), "first_id", "ss", "qq")
    m = F.col("size").cast("double")
    mean = F.when(F.col("kind") == "near_duplicate", (F.col("ss") - F.col("qq")) / (m * (m - 1))).otherwise(1.0)
    sample = coll.df.select(F.col("id").alias("first_id"), coll.metadata_json().alias("sample_metadata"))
    return (
        sizes.join(total, ["kind", "first_id"], "left")
        .withColumn("similarity", mean)
        .join(sample, "first_id")
        .select(
            F.concat_ws("_", F.col("kind"), F.col("first_id").cast("string")).alias("group_id"),
            "kind", "first_id", "size", "similarity", "sample_metadata",
        )
    )


def duplicate_totals(members: DataFrame) -> DataFrame:
    """Rows beyond the first of each group, by kind: ``(kind, groups, surplus)``."""
    return members.groupBy("kind").agg(
        F.count_if(F.col("id") == F.col("first_id")).alias("groups"),
        F.count_if(F.col("id") != F.col("first_id")).alias("surplus"),
    )


def member_lists(members: DataFrame, per_row: int = IDS_PER_ROW) -> DataFrame:
    """Member ids joined by ``;``. A group above ``per_row`` members spreads over numbered parts, so
    that no cell grows with the group; smaller groups are part 0 alone. The part is the first 32 bits of the id's MD5, as text,
    modulo the number of parts."""
    sizes = members.groupBy("kind", "first_id").agg(F.count(F.lit(1)).alias("size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / per_row)).cast("int")
    digest = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    placed = members.join(sizes, ["kind", "first_id"]).withColumn("part", (digest % parts).cast("int"))
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ";")
    return placed.groupBy("kind", "first_id", "part").agg(ids.alias("vector_ids"))


def keep_first(coll: Collection, members: DataFrame, chosen: DataFrame | None = None) -> Collection:
    """The collection without the later members of the chosen groups (all groups by default)."""
    surplus = members.where("id <> first_id")
    if chosen is not None:
        surplus = surplus.join(chosen, ["kind", "first_id"], "left_semi")
    return delete_ids(coll, surplus.select("id"))


def delete_ids(coll: Collection, ids: DataFrame) -> Collection:
    """The collection without the given ids."""
    return coll.with_df(coll.df.join(ids.select("id"), "id", "left_anti"))
