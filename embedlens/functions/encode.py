"""A default text encoder: hashed word counts as unit vectors. Any function of the same shape will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 256


def hashing_encoder(rows: DataFrame, text: str, dims: int = DIMS) -> DataFrame:
    """Adds ``vector``, an ``array<double>`` of ``dims`` elements and length one; zero without words."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(rows.withColumn("_words", words))
    counts = vector_to_array("_tf")
    norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
    sized = counted.withColumn("_counts", counts).withColumn("_norm", norm)
    unit = F.transform(F.arrays_zip("_counts", F.array_repeat("_norm", dims).alias("n")), lambda p: F.coalesce(F.try_divide(p["_counts"], p["n"]), F.lit(0.0)))
    return sized.withColumn("vector", unit).drop("_words", "_tf", "_counts", "_norm")
