"""Groups of rows worked on inside tasks, a batch of many groups at a time.

``blocked`` cuts groups above ``block`` rows into blocks and sends each pair of blocks to a task of its own, so a
task never holds more than two blocks of one group; smaller groups stay whole. ``per_group`` reads the rows of a
partition in order and hands whole groups to a function without one Spark group per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, key: str, member: str, block: int, more: DataFrame | None = None) -> DataFrame:
    """``rows`` of groups of two and more, with columns ``left`` and ``right`` (block numbers); sorted into groups.

    The size of each group is counted with map-side partial sums, then joined back. ``more``: columns by ``member``
    that are joined to what is left."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = rows.join(sizes, key)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64(F.col(member), F.lit(17)), blocks).cast("int")).otherwise(F.lit(0))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, F.col("own")).alias("left"), F.greatest(i, F.col("own")).alias("right")),
    )
    paired = (
        both.withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("pair", F.explode(pairs))
        .select("*", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))
        .drop("pair", "blocks", "n")
    )
    if more is not None:
        paired = paired.join(more, member)
    return paired.repartition(key, "left", "right").sortWithinPartitions(key, "left", "right")


def per_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], None]) -> Iterator[None]:
    """Call ``work`` with runs of whole groups of sorted batches; yield after each call."""
    held: list[pa.RecordBatch] = []

    def last_key(batch, at):
        return tuple(batch.column(batch.schema.get_field_index(k))[at].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        final = last_key(batch, batch.num_rows - 1)
        lo, hi = 0, batch.num_rows - 1
        if last_key(batch, 0) == final:
            lo = 0
        else:  # first row of the last group: keys are sorted, so rows of it are a suffix
            while lo < hi:
                mid = (lo + hi) // 2
                if last_key(batch, mid) == final:
                    hi = mid
                else:
                    lo = mid + 1
        if lo == 0 and held and last_key(held[-1], held[-1].num_rows - 1) == final:
            held.append(batch)
            continue
        whole = held + ([batch.slice(0, lo)] if lo else [])
        if whole:
            work(pa.Table.from_batches(whole))
            yield
        held = [batch.slice(lo)]
    if held:
        work(pa.Table.from_batches(held))
        yield
