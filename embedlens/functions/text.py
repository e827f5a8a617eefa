"""Text expressions: normal form, length class, sentence boundary, preview, overlap, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embedlens.functions.values import trimmed

STARTS_LOWER = r"^\p{IsLowercase}"
ENDS_CLOSED = r"""[.!?"')\]]$"""  # fixed value: characters that end a sentence


def normal_form(text: Column) -> Column:
    """Trimmed, lower-cased text; null when nothing is left. Equal forms are text duplicates."""
    form = F.lower(trimmed(text))
    return F.when(form != "", form)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def broken_boundary(text: Column) -> Column:
    t = trimmed(text)
    return t.rlike(STARTS_LOWER) & ~t.rlike(ENDS_CLOSED)


def preview(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def high_overlap(prev: Column, text: Column, share: float) -> Column:
    """Longest suffix of ``prev`` equal to a prefix of ``text``, when above ``share`` of the longer one.

    A qualifying overlap is longer than ``lowest`` characters, so it starts where the first ``lowest``
    characters of ``text`` occur in ``prev``. The first occurrence is tried; only for periodic text,
    where there is a second one close by, the remaining lengths are tried in turn.
    """
    size = F.length(prev)
    shorter = F.least(size, F.length(text))
    longer = F.greatest(size, F.length(text))
    lowest = (F.floor(longer * share) + 1).cast("int")
    must = F.left(text, lowest)
    agrees = lambda n: F.right(prev, n) == F.left(text, n)
    first = F.call_function("locate", must, prev, size - shorter + 1)
    n = size - first + 1
    second = F.call_function("locate", must, prev, first + 1)
    later = F.when(
        second > 0,
        F.array_max(F.filter(F.sequence(lowest, F.greatest(lowest, size - second + 1)), agrees)),
    )
    return F.when((lowest <= shorter) & (first > 0), F.when(agrees(n), n).otherwise(later))


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(n >= gb, F.format_string("%.1f GB", n / F.lit(float(gb))))
        .when(n >= mb, F.format_string("%.1f MB", n / F.lit(float(mb))))
        .when(n >= kb, F.format_string("%.1f KB", n / F.lit(float(kb))))
        .otherwise(F.format_string("%d bytes", n))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(share: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)
