"""Connected components by alternating star contraction with split hubs.

Each round replaces links by links to the smallest neighbour, first for larger then for smaller
neighbours, until nothing changes; rounds grow with the logarithm of the longest chain. The smallest
neighbour of a node is a minimum over a window of its links. A node with more than one in ``HUBS`` of all links, and
more than ``HUBS``, is a hub: there are fewer than twice ``HUBS`` of them whatever the data. Its minimum is found from
partial minima of tasks and broadcast, and its links stay where they are. Of the other nodes none holds
more, so windows are small and dealt evenly. Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.session import cut

HUBS = 1000


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def hub_nodes(links: DataFrame, n: int, hubs: int = HUBS) -> DataFrame | None:
    """``(u)`` of nodes with too many of the ``n`` links for one task, if there are any; fewer than 2 * ``hubs`` ids."""
    most = max(hubs, n // hubs)
    if n <= most:
        return None
    found = _both(links).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("u").collect()
    return links.sparkSession.createDataFrame(found, links.select("u").schema) if found else None


def with_least(rows: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``rows`` (u, v) with ``m``: the smallest v of each u."""
    least = F.min("v").over(Window.partitionBy("u"))
    if hubs is None:
        return rows.withColumn("m", least)
    ids = F.broadcast(hubs)
    of_hubs = F.broadcast(rows.join(ids, "u").groupBy("u").agg(F.min("v").alias("m")))
    return rows.join(of_hubs, "u").unionByName(rows.join(ids, "u", "left_anti").withColumn("m", least))


def _large_star(links: DataFrame, hubs: DataFrame | None) -> DataFrame:
    linked = with_least(_both(links), hubs).where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame, hubs: DataFrame | None) -> DataFrame:
    # a node has no more smaller neighbours here than it had links before, so hubs are among those of the round's links
    linked = with_least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), hubs)
    # the smallest neighbour itself keeps its link to the node; every other one is linked to it
    return linked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _state(links: DataFrame):
    return links.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")
    ).first()


def components(links: DataFrame, a: str = "a", b: str = "b", hubs: int = HUBS) -> DataFrame:
    """``(id, component)`` for every id that occurs in a link; component = its smallest id."""
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = cut(now)
    seen = _state(now)
    while True:
        hub = hub_nodes(now, seen["n"], hubs)
        now = cut(_small_star(_large_star(now, hub), hub))
        state = _state(now)
        if state == seen:
            break
        seen = state
    member = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    root = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return member.unionAll(root)
