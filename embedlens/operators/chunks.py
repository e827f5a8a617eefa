"""Text chunk quality: content field, length, boundary, isolation and overlap issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlens.functions import text as X
from embedlens.functions.values import is_content_name
from embedlens.operators.ordering import with_ordinal
from embedlens.operators.pairs import lone_rows
from embedlens.sources.collections import Collection

CONTENT_FIELDS = ("text", "content", "body", "chunk", "passage", "document")  # fixed values, tried in order
MIN_LENGTH, MAX_LENGTH = 50, 5000  # fixed values: default bounds in bytes
OVERLAP_SHARE = 0.8  # fixed value
ISOLATED_BELOW = 0.5  # fixed value: cosine similarity
SPARSE = 16  # mean distance of ids from which they are numbered anew
RUN_ROWS = 65_536  # rows of one source that are put in order together


def _text(coll: Collection, field: str) -> Column:
    """The field as text; other types hold no chunk."""
    dtype = coll.types[field]
    if isinstance(dtype, T.StringType):
        return coll.field(field)
    if isinstance(dtype, T.VariantType):
        value = coll.field(field)
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.lit(None).cast("string")


def content_field(coll: Collection) -> str | None:
    """First well-known field with text in any row; else the first field, in name order, that is
    named like content."""
    present = [f for f in CONTENT_FIELDS if f in coll.fields]
    named = next((f for f in sorted(coll.fields) if is_content_name(f)), None)
    if any(f != named for f in present):  # else the answer is the same without a look at the texts
        found = coll.df.agg(*[F.coalesce(F.bool_or(_text(coll, f) != ""), F.lit(False)).alias(f) for f in present]).first()
        for f in present:
            if found[f]:
                return f
    return named


def texts(coll: Collection, field: str, *keep: str) -> DataFrame:
    return coll.df.select("id", *[coll.field(k) for k in keep], _text(coll, field).alias("text")).where("text IS NOT NULL")


def _length_issue(low: int, high: int) -> Column:
    n = X.byte_length(F.col("text"))
    return (
        F.when(n < low, F.struct(F.lit("too_short").alias("issue"), F.format_string(f"%d chars (min: {low})", n).alias("detail")))
        .when(n > high, F.struct(F.lit("too_long").alias("issue"), F.format_string(f"%d chars (max: {high})", n).alias("detail")))
    )


def _boundary_issue() -> Column:
    issue = F.struct(F.lit("broken_boundary").alias("issue"), F.lit("Starts lowercase and ends without punctuation").alias("detail"))
    return F.when(X.broken_boundary(F.col("text")), issue)


def _listed(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select("id", found.alias("f"), X.preview(F.col("text")).alias("preview")).where("f IS NOT NULL").select(
        "id", "f.issue", "f.detail", "preview"
    )


def length_issues(rows: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    return _listed(rows, _length_issue(low, high))


def boundary_issues(rows: DataFrame) -> DataFrame:
    return _listed(rows, _boundary_issue())


def isolation_issues(coll: Collection, previews: DataFrame) -> DataFrame:
    """Vectors less than 0.5 similar to every other one; rows that ``previews`` (id, preview) lacks have an empty preview."""
    vectors = coll.vectors()
    if len(vectors.limit(2).collect()) < 2:
        return previews.limit(0).select("id", F.lit("orphan").alias("issue"), F.lit("").alias("detail"), F.lit("").alias("preview"))
    lone = lone_rows(vectors, ISOLATED_BELOW)
    return lone.join(previews.select("id", F.col("preview").alias("p")), "id", "left").select(
        "id", F.lit("orphan").alias("issue"),
        F.lit(f"Max similarity to other chunks < {ISOLATED_BELOW}").alias("detail"), F.coalesce("p", F.lit("")).alias("preview"),
    )


def with_previous(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Adds ``prev``: the text before each row in id order (within ``source`` when given).

    A source may hold a third of all rows, so no window spans a whole source. Ids are cut into
    stretches of at most 65 536 rows; the last row of each stretch is repeated as the head of the
    next one. Ids that are not integers, or integers far apart, are numbered first.
    """
    whole = isinstance(rows.schema["id"].dataType, T.IntegralType)
    if whole:  # sparse numbers would give a stretch per row
        wide = (F.max("id").cast("double") - F.min("id")) / F.count(F.lit(1))
        whole = (rows.agg(wide.alias("w")).first().w or 0.0) <= SPARSE
    if not whole:
        keys = ([source] if source else []) + ["id"]
        order = with_ordinal(rows.select(*keys), *keys, name="_n").select("id", "_n")
        rows = rows.join(order, "id")
    else:
        rows = rows.withColumn("_n", F.col("id").cast("bigint"))
    part = [source] if source else []
    rows = rows.withColumn("_run", F.floor(F.col("_n") / RUN_ROWS).cast("bigint"))
    last = rows.groupBy(*part, "_run").agg(F.max_by(F.struct("_n", "text"), "_n").alias("tail"))
    following = Window.partitionBy(*part).orderBy("_run")  # one short row per stretch
    nexts = rows.select(*part, "_run").distinct().withColumn("_next", F.lead("_run").over(following))
    nexts = nexts.where("_next IS NOT NULL").select(*[F.col(c).alias(f"{c}_of") for c in [*part, "_run"]], "_next")
    same = F.col("_run") == F.col("_run_of")
    for c in part:  # rows without a source are a source of their own
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    heads = last.join(nexts, same).select(
        *part, F.col("_next").alias("_run"), F.col("tail._n").alias("_n"), F.col("tail.text").alias("text"), F.lit(True).alias("_head")
    )
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy(*part, "_run").orderBy("_n")
    return both.withColumn("prev", F.lag("text").over(within)).where("NOT _head").drop("_n", "_run", "_head")


def _overlap_issue() -> Column:
    """Of a chunk that repeats over 80 % of the chunk before: the longest suffix of the one before that
    begins this one, relative to the longer text (in characters)."""
    share = F.col("n") / F.greatest(F.length("prev"), F.length("text"))
    detail = F.concat(F.format_string("%.0f", F.bround(share * 100, 0)), F.lit("% overlap with previous chunk"))
    return F.when(F.col("n").isNotNull(), F.struct(F.lit("high_overlap").alias("issue"), detail.alias("detail")))


def _met(rows: DataFrame, source: str | None) -> DataFrame:
    return with_previous(rows, source).withColumn("n", X.high_overlap(F.col("prev"), F.col("text"), OVERLAP_SHARE))


def overlap_issues(rows: DataFrame, source: str | None = None) -> DataFrame:
    return _listed(_met(rows, source), _overlap_issue())


def facts(rows: DataFrame, low: int, high: int, source: str | None = None) -> DataFrame:
    """``(id, len, issues, preview)`` of each chunk, ``issues`` being array<struct<issue, detail>>: texts are put in order once and read no further."""
    issues = F.array_compact(F.array(_length_issue(low, high), _boundary_issue(), _overlap_issue()))
    return _met(rows, source).select("id", X.byte_length(F.col("text")).alias("len"), issues.alias("issues"), X.preview(F.col("text")).alias("preview"))
