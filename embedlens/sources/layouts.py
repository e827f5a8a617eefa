"""Stored layouts: rows in id order or along a space-filling curve, with the value ranges of every file.

A page or a box opens only the files whose ranges match, however large the collection: the manifest, one row per file, tells which.
Publishing is atomic. Data go to a folder of their own first; the manifest's rows follow in one file, which appears whole
or not at all. Readers take the rows of the latest version, so a write that fails on the way leaves the old state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
FILE_ROWS = 1_000_000
CURVE_BITS = 16  # of each axis
_MANIFEST = "version long, folder string, file string, n long, first string, last string, " + ", ".join(f"{a}_lo double, {a}_hi double" for a in AXES)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or none if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def curve(rows: DataFrame) -> Column:
    """Place along the curve: the bits of the three scaled coordinates in turn. Null coordinates count as the smallest."""
    box = rows.agg(*[f(F.when(~F.isnan(a), F.col(a))).alias(f"{a}{i}") for a in AXES for i, f in enumerate((F.min, F.max))]).first()
    key = F.lit(0).cast("long")
    top = (1 << CURVE_BITS) - 1
    for place, a in enumerate(AXES):
        low, high = box[f"{a}0"] or 0.0, box[f"{a}1"] or 0.0
        step = F.floor((F.col(a) - low) / F.lit((high - low) or 1.0) * top)
        step = F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(step.cast("long"), F.lit(0))))
        for bit in range(CURVE_BITS):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + place))
    return key


def _latest(spark: SparkSession, path: str):
    """Manifest rows of the current version (a row per file), in order."""
    table = read_table(spark, f"{path}/manifest")
    if table is None:
        return []
    now = table.agg(F.max(F.struct("version", "folder")).alias("m")).first().m
    rows = table.where((F.col("version") == now.version) & (F.col("folder") == now.folder)).collect()
    return sorted(rows, key=lambda r: r.file)


def publish(rows: DataFrame, path: str, by: str = "id", file_rows: int = FILE_ROWS) -> int:
    """Store ``rows`` in the order of ``id``, or along the curve of x, y, z (``by="space"``); the new version's number."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    files = max(1, -(-rows.count() // file_rows))
    key = F.col("id") if by == "id" else curve(rows)
    placed = rows.withColumn("_key", key).repartitionByRange(files, "_key").sortWithinPartitions("_key", "id").drop("_key")
    data = f"{path}/data/{folder}"
    placed.write.parquet(data)
    stored = spark.read.parquet(data).withColumn("_file", F.col("_metadata.file_path"))
    spatial = set(AXES) <= set(rows.columns)
    ranges = [f(a if spatial else F.lit(None).cast("double")).cast("double").alias(f"{a}_{n}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    each = stored.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("id").cast("string").alias("first"), F.max("id").cast("string").alias("last"), *ranges)
    version = max((r.version for r in _latest(spark, path)), default=0) + 1
    head = [F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.col("_file").alias("file")]
    listed = each.select(*head, *each.columns[1:])
    none = spark.createDataFrame([(version, folder, None, 0, None, None, *[None] * 6)], _MANIFEST)  # of an empty collection
    (listed if files > 1 or stored.limit(1).count() else none).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


@dataclass(frozen=True)
class Layout:
    """The current version of a stored layout; ``files`` are its manifest rows."""

    spark: SparkSession
    path: str
    files: list

    @staticmethod
    def open(spark: SparkSession, path: str) -> Layout:
        rows = _latest(spark, path)
        if not rows:
            raise FileNotFoundError(f"no layout was published at {path}")
        return Layout(spark, path, rows)

    @property
    def schema(self):
        return self.spark.read.parquet(f"{self.path}/data/{self.files[0].folder}").schema

    def _read(self, files: list) -> DataFrame:
        whole = self.schema
        return self.spark.read.schema(whole).parquet(*[f.file for f in files]) if files else self.spark.createDataFrame([], whole)

    def _in_order(self) -> list:
        kind = type(self.schema["id"].dataType).__name__
        value = (lambda f: int(f.first)) if kind in ("ByteType", "ShortType", "IntegerType", "LongType") else (lambda f: f.first.encode())
        return sorted((f for f in self.files if f.n), key=value)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` .. ``offset + limit`` in id order; only the files that hold them are opened."""
        chosen, before, skip = [], 0, None
        for f in self._in_order():
            if before + f.n > offset and before < offset + limit:
                skip = before if skip is None else skip
                chosen.append(f)
            before += f.n
        return self._read(chosen).orderBy("id").offset(offset - (skip or 0)).limit(limit)

    def page_after(self, limit: int, cursor=None) -> DataFrame:
        """The ``limit`` rows that follow the cursor in id order."""
        chosen, sure = [], 0
        for f in self._in_order():
            last = f.last.encode() if isinstance(cursor, str) else int(f.last) if cursor is not None else None
            mark = cursor.encode() if isinstance(cursor, str) else cursor
            if mark is not None and last <= mark:
                continue
            chosen.append(f)
            first = f.first.encode() if isinstance(cursor, str) else int(f.first) if cursor is not None else None
            sure += f.n if mark is None or first > mark else 0
            if sure >= limit:
                break
        rows = self._read(chosen)
        return (rows if cursor is None else rows.where(F.col("id") > F.lit(cursor))).orderBy("id").limit(limit)

    def box(self, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
        """Rows inside a box, edges included."""
        meets = [f for f in self.files if f.n and all(f[f"{a}_lo"] is not None and f[f"{a}_lo"] <= h and f[f"{a}_hi"] >= lo for a, lo, h in zip(AXES, low, high))]
        inside = F.lit(True)
        for a, lo, h in zip(AXES, low, high):
            inside = inside & F.col(a).between(lo, h)
        return self._read(meets).where(inside)
