import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows from (doc_id, text) pairs, in several partitions."""

    def build(pairs, parts=3):
        rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long_text = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long_text, "en", None, 9), (5, "one two three four five six", None, "a", 3),
        (5, "one two three four five six", None, "a", 3), (None, "one two three four five six", "en", "a", 3), (6, "One two three four five six", "de", "b", -1),
        (7, "é" * 70 + " ü" * 30, "fr", "b", 130), (8, "x", "fr", "b", 1), (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    clash = "n_words kept key node group row data tag doc score label shard bin n left right found text_ row_".split()
    for c in clash:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def sf(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
