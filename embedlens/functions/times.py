"""Timestamps in metadata: points in time as epoch microseconds, and ages at a given moment."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlens.functions.values import bind

# fixed values: field names tried in this order
TIMESTAMP_FIELDS = (
    "created_at", "updated_at", "timestamp", "_creationTimeUnix", "createdAt", "updatedAt", "date",
    "created", "modified", "lastModified", "last_modified", "time", "datetime",
)
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
INTEGER = r"^[+-]?\d{1,19}$"
MILLIS_ABOVE = 1_000_000_000_000  # fixed value: larger integers are milliseconds
SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def as_of_micros(as_of: datetime) -> int:
    moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * SECOND + delta.microseconds


def _from_integer(n: Column, millis: bool) -> Column:
    seconds = F.when(n > MILLIS_ABOVE, F.floor(n / 1000).cast("bigint")).otherwise(n) if millis else n
    return F.try_multiply(seconds, F.lit(SECOND))


def _from_text(text: Column, millis: bool) -> Column:
    # patterns first: a failing cast costs far more than a failing match
    zoned = F.when(text.rlike(RFC3339), F.unix_micros(F.upper(text).try_cast("timestamp")))
    number = F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    return F.coalesce(zoned, _from_integer(number, millis))


def epoch_micros(value: Column, dtype: T.DataType, millis: bool = True) -> Column:
    """Epoch microseconds of a metadata value, null where it is no point in time."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), value)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.StringType):
        return _from_text(value, millis)
    if isinstance(dtype, T.IntegralType):
        return _from_integer(value.cast("bigint"), millis)
    if isinstance(dtype, T.FractionalType):
        return _from_integer(value.try_cast("bigint"), False)
    if isinstance(dtype, T.VariantType):
        def of_variant(v):
            kind = F.schema_of_variant(v)
            return (
                F.when(kind == "STRING", _from_text(F.try_variant_get(v, "$", "string"), millis))
                .when(kind == "BIGINT", _from_integer(F.try_variant_get(v, "$", "bigint"), millis))
                .when(
                    kind.startswith("DECIMAL") | (kind == "DOUBLE"),
                    _from_integer(F.try_variant_get(v, "$", "double").try_cast("bigint"), False),
                )
            )

        return bind(value, of_variant)
    return F.lit(None).cast("bigint")


def whole(micros: Column, step: int) -> Column:
    """Whole steps in a duration, truncated toward zero."""
    size = F.floor(F.abs(micros) / F.lit(step)).cast("bigint")
    return F.when(micros < 0, -size).otherwise(size)


def age_hours(epoch: Column, as_of: datetime) -> Column:
    return whole(F.lit(as_of_micros(as_of)) - epoch, HOUR)


def age_days(epoch: Column, as_of: datetime) -> Column:
    """Age in fractional days, counted in whole hours."""
    return age_hours(epoch, as_of) / F.lit(24.0)


def whole_days(epoch: Column, as_of: datetime) -> Column:
    return whole(F.lit(as_of_micros(as_of)) - epoch, DAY)
