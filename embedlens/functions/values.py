"""Emptiness, equality and text of metadata values, by column type.

Metadata fields are ordinary columns. JSON metadata becomes VARIANT columns, so that the text
``"[]"`` and an empty list stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: the Unicode white space characters
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTENT_WORDS = ("text", "content", "body")  # fixed values: parts of a name that mark a content field


def trimmed(text: Column) -> Column:
    """Text without white space at either end; plain ``trim`` would strip spaces only."""
    return F.trim(text, F.lit(SPACE))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it. Without this a
    JSON text would be parsed again at every mention of a field."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_empty(value: Column, dtype: T.DataType) -> Column:
    """True for null, blank text, an empty list and an empty object."""
    if isinstance(dtype, T.StringType):
        return value.isNull() | (trimmed(value) == "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return value.isNull() | (F.size(value) == 0)
    if isinstance(dtype, T.VariantType):
        def empty_variant(v):
            kind = F.schema_of_variant(v)
            blank = trimmed(F.try_variant_get(v, "$", "string")) == ""
            return v.isNull() | kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>") | ((kind == "STRING") & blank)

        return bind(value, empty_variant)
    return value.isNull()


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A text form under which two values of one field are equal or not."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def is_content_name(name: str) -> bool:
    return any(word in name.lower() for word in CONTENT_WORDS)


def is_vector_name(name: str) -> bool:
    return "vector" in name.lower() or "embedding" in name.lower()


def id_hash(c: Column) -> Column:
    """60 bits of the MD5 of an id's text: the same number on any SQL engine."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
