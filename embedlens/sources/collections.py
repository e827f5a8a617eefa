"""A collection: one DataFrame of records with an id, a vector and metadata fields."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlens.functions import values


@dataclass(frozen=True)
class Collection:
    """Columns ``id`` and ``vector`` plus the metadata columns named in ``fields``."""

    df: DataFrame
    fields: tuple[str, ...] = ()
    name: str = "collection"

    @classmethod
    def of(cls, df: DataFrame, id_col: str, vector_col: str | None = None, name: str = "collection") -> "Collection":
        """Any table as a collection: every column but the id and the vector is metadata."""
        fields = tuple(c for c in df.columns if c not in (id_col, vector_col))
        vector = F.col(vector_col).cast("array<double>") if vector_col else F.lit(None).cast("array<double>")
        return cls(df.select(F.col(id_col).alias("id"), vector.alias("vector"), *map(_q, fields)), fields, name)

    @classmethod
    def of_json(cls, df: DataFrame, metadata: str, fields: tuple[str, ...], name: str = "collection") -> "Collection":
        """A table with a JSON text column: each named property becomes a VARIANT field."""
        doc = F.try_parse_json(F.col(metadata))
        cols = [F.try_variant_get(doc, f"$['{f}']", "variant").alias(f) for f in fields]
        return cls(df.select("id", F.col("vector").cast("array<double>").alias("vector"), *cols), tuple(fields), name)

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}

    def field(self, name: str) -> Column:
        return _q(name)

    def is_empty(self, name: str) -> Column:
        """Emptiness of a field; a field the collection does not have is empty in every row."""
        return values.is_empty(_q(name), self.types[name]) if name in self.fields else F.lit(True)

    def filled_count(self) -> Column:
        return reduce(lambda a, b: a + b, [(~self.is_empty(f)).cast("int") for f in self.fields], F.lit(0))

    def metadata_json(self) -> Column:
        """The metadata document as JSON text, keys sorted, nulls kept."""
        if not self.fields:
            return F.lit("{}")
        doc = F.struct(*[_q(f).alias(f) for f in sorted(self.fields)])
        return F.to_json(doc, {"ignoreNullFields": "false"})

    def vectors(self) -> DataFrame:
        """Records with an embedding, id and vector only: the scan never reads the metadata."""
        return self.df.where("vector IS NOT NULL").select("id", "vector")

    def with_df(self, df: DataFrame) -> "Collection":
        return replace(self, df=df)


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def json_properties(df: DataFrame, metadata: str) -> list[str]:
    """Property names of a JSON text column, sorted (a schema-sized list)."""
    keys = F.explode(F.map_keys(F.from_json(F.col(metadata), "map<string,variant>"))).alias("k")
    return sorted(r.k for r in df.select(keys).distinct().collect())


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Offset page in id order."""
    return df.orderBy("id").offset(offset).limit(limit)


def page_after(df: DataFrame, limit: int, cursor=None) -> DataFrame:
    """Keyset page: rows with an id after the cursor, in id order. The filter reaches the scan."""
    rows = df if cursor is None else df.where(F.col("id") > F.lit(cursor))
    return rows.orderBy("id").limit(limit)


def next_cursor(page_df: DataFrame, limit: int) -> DataFrame:
    """The cursor after a page: its last id, null when the page is not full."""
    return page_df.agg(F.when(F.count(F.lit(1)) == limit, F.max("id")).alias("next_cursor"))


def vector_widths(coll: Collection) -> DataFrame:
    """Rows per vector width; more than one row means mixed widths."""
    return coll.vectors().groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))


def collection_info(collections: list[Collection]) -> DataFrame:
    """name, count, dimensions and properties of each collection; one scan of the vector column each."""
    def one(c: Collection) -> DataFrame:
        return c.df.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("vector")).alias("dims")).select(
            F.lit(c.name).alias("name"),
            "count",
            F.when(F.col("dims") > 0, F.col("dims")).alias("vector_dimensions"),
            F.array(*[F.lit(f) for f in sorted(c.fields)]).cast("array<string>").alias("properties"),
        )

    return reduce(DataFrame.unionByName, [one(c) for c in collections])


def find_collection(collections: list[Collection], name: str) -> Collection:
    for c in collections:
        if c.name == name:
            return c
    raise KeyError(f"collection '{name}' not found")


def id_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of the id set: row count and xor of id hashes."""
    key = values.id_hash(F.col("id"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(key), F.lit(0)).alias("id_hash"))
