"""Similar vectors with conflicting metadata.

Metadata are compared by a 128-bit fingerprint, so no text is shuffled. Rows with the same vector
and the same metadata are one *signature*: the smallest id stands for them and carries their number.

Pairs of vectors are decided where they are compared: vectors travel with their signatures and row counts. A
block task returns the number of contradictions and its ``max_results`` best ones, not its pairs. Copies of one
vector are counted from group sizes: all pairs less those with equal metadata.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.functions import values
from embedlens.functions import vectors as V
from embedlens.operators.pairs import best_k, collapse_copies, copy_members, ids_of, matches, result_schema, similar
from embedlens.session import cut
from embedlens.sources.collections import Collection

THRESHOLD = 0.85  # fixed value: default similarity
MAX_RESULTS = 100  # fixed value: default length of the list
SIGNATURES = 256  # of one vector that travel together


def _compared(coll: Collection) -> list[str]:
    return [f for f in sorted(coll.fields) if not values.is_vector_name(f)]


def _canonical(coll: Collection, field: str) -> Column:
    """Text under which values agree; all empty values agree."""
    value = values.comparable(coll.field(field), coll.types[field])
    return F.when(~coll.is_empty(field), value)


def differences(a: Column, b: Column, fields: list[str]) -> Column:
    """``array<struct<field, value_a, value_b>>`` of the fields whose canonical texts differ."""
    each = [
        F.when(
            ~a[f].eqNullSafe(b[f]),
            F.struct(F.lit(f).alias("field"), a[f].alias("value_a"), b[f].alias("value_b")),
        )
        for f in fields
    ]
    return F.array_compact(F.array(*each))


def _fingerprint(coll: Collection, fields: list[str]) -> list[Column]:
    # a mark tells an empty value from any text, and keeps fields apart
    marked = [F.coalesce(F.concat(F.lit("="), _canonical(coll, f)), F.lit("-")) for f in fields] or [F.lit("-")]
    return [F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit(1), *marked).alias("h2")]


class Contradictions:
    """Contradictions of one collection; ``pairs`` and ``total`` share one comparison of vectors."""

    def __init__(self, coll: Collection, threshold: float = THRESHOLD, max_results: int = MAX_RESULTS):
        self.coll, self.fields, self.max_results = coll, _compared(coll), max_results
        # zero vectors are similar to nothing, so they cannot contradict
        rows = coll.df.where(F.col("vector").isNotNull() & (V.squared_norm(F.col("vector")) > 0))
        rows = rows.select("id", "vector", *_fingerprint(coll, self.fields))
        members = copy_members(rows)
        copied = rows.select("id", "h1", "h2").join(members, "id")
        self.signatures = cut(
            copied.groupBy(F.col("rep").alias("v"), "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
        )
        self.copied = self.signatures.groupBy("v").agg(
            F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("k"), F.min("id").alias("first")
        )
        self.found = cut(_compare(self._heads(collapse_copies(rows, members)), threshold, max_results))

    def _heads(self, distinct: DataFrame) -> DataFrame:
        """``(id, v, vector, n, ids, h1s, h2s, ms)``: a vector ``v`` with about ``SIGNATURES`` of its signatures, smallest id first.

        A vector whose copies differ in very many ways is several heads, spread over blocks by their first ids."""
        parts = F.ceil(F.col("k") / SIGNATURES)
        own = F.sort_array(F.collect_list(F.struct("id", "h1", "h2", "m"))).alias("s")
        groups = self.signatures.join(self.copied.select("v", "k"), "v").groupBy("v", F.pmod(F.xxhash64("h1", "h2"), parts).alias("part")).agg(own)
        kind = groups.schema["s"].dataType.simpleString()
        one = F.array(F.struct("id", "h1", "h2", F.lit(1).cast("bigint").alias("m"))).cast(kind)
        known = groups.select(F.col("v").alias("id"), "s")
        heads = distinct.join(known, "id", "left").select(F.col("id").alias("v"), "vector", F.coalesce("s", one).alias("s"))
        lists = [F.col(f"s.{c}").alias(f"{c}s") for c in ("id", "h1", "h2", "m")]
        total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["m"]).alias("n")
        return heads.select(F.col("s")[0]["id"].alias("id"), "v", "vector", total, *lists)

    def total(self) -> DataFrame:
        """``(contradictions)``: row pairs at or above the threshold whose metadata differ."""
        counted = self.found.where(F.col("kind") == COUNT).select(F.col("weight").alias("c"))
        # among copies of one vector: (n^2 - sum m^2) / 2 row pairs differ
        inside = self.copied.select(((F.col("n") * F.col("n") - F.col("same")) / 2).cast("bigint").alias("c"))
        return counted.unionAll(inside).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("contradictions"))

    def _listed(self, most: int) -> DataFrame:
        """``(a, b, similarity, row_pairs)``: enough signature pairs for a list of ``most``.

        Among copies, every vector with two signatures has a pair that starts with its smallest id. So only pairs of the
        ``most`` vectors of smallest ids can be listed, and of each only its ``most`` first pairs, which lie among its
        first most + 1 signatures.
        """
        near = self.found.where(F.col("kind") == LISTED).select("a", "b", "similarity", F.col("weight").alias("row_pairs"))
        few = self.copied.where("k > 1").orderBy("first").limit(most).select("v")
        first = best_k(self.signatures.join(F.broadcast(few), "v") if most <= 100_000 else self.signatures.join(few, "v"), most + 1, "v", ("id",))
        own = first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "m"))).alias("s"))
        pairs = F.flatten(F.transform("s", lambda a, i: F.transform(
            F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b"), (a["m"] * b["m"]).alias("row_pairs")))))
        inside = own.select(F.explode(F.slice(pairs, 1, most)).alias("p")).select("p.a", "p.b", F.lit(1.0).alias("similarity"), "p.row_pairs")
        return near.unionByName(inside)

    def pairs(self, max_results: int | None = None) -> DataFrame:
        """``(vector_a_id, vector_b_id, similarity, row_pairs, differences)``, most similar first.

        Each id stands for its signature, ``row_pairs`` for the rows behind both.
        """
        most = self.max_results if max_results is None else max_results
        top = cut(self._listed(most).orderBy(F.desc("similarity"), "a", "b").limit(most))
        ids = top.select(F.col("a").alias("id")).unionAll(top.select(F.col("b").alias("id"))).distinct()
        meta = F.struct(*[_canonical(self.coll, f).alias(f) for f in self.fields]) if self.fields else F.struct(F.lit(0).alias("none"))
        ids = F.broadcast(ids) if most <= 100_000 else ids  # at most 2 * most ids
        known = cut(self.coll.df.join(ids, "id").select("id", meta.alias("meta")))
        a = known.select(F.col("id").alias("a"), F.col("meta").alias("ma"))
        b = known.select(F.col("id").alias("b"), F.col("meta").alias("mb"))
        return (
            top.join(a, "a").join(b, "b")
            .select(
                F.col("a").alias("vector_a_id"), F.col("b").alias("vector_b_id"), "similarity", "row_pairs",
                differences(F.col("ma"), F.col("mb"), self.fields).alias("differences"),
            )
            .orderBy(F.desc("similarity"), "vector_a_id", "vector_b_id")
        )


COUNT, LISTED = 0, 1


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    column = column.combine_chunks()
    lens = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)])


class _Best:
    """The ``most`` pairs of greatest similarity, then smallest ids, met so far; the last of them bounds what can still come in."""

    def __init__(self, most: int):
        self.most, self.rows = most, [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]

    def add(self, a, b, sim, weight) -> None:
        low, high = np.minimum(a, b), np.maximum(a, b)
        rows = [np.concatenate(x) for x in zip(self.rows, (low, high, sim, weight))]
        order = np.lexsort((rows[1], rows[0], -rows[2]))[: self.most]
        self.rows = [x[order] for x in rows]

    def admits(self, sim: float, least: int) -> bool:
        if len(self.rows[0]) < self.most:
            return self.most > 0
        return (-sim, least) <= (-self.rows[2][-1], self.rows[0][-1])


def _compare(heads: DataFrame, threshold: float, most: int) -> DataFrame:
    """Per block task: a COUNT row and its best LISTED pairs, ``most`` at most. Pairs never leave a task."""
    kind = heads.schema["id"].dataType.simpleString()
    fields = result_schema(heads, ["a", "b"], [("kind", pa.int32()), ("similarity", pa.float64()), ("weight", pa.int64())])

    def kernel(key, table):
        left, right, _, found = matches(key, table, threshold)
        sides = []
        for side in (left, right):
            ids, at = _flat(side["ids"])
            sides.append({"ids": ids, "at": at, "m": _flat(side["ms"])[0], "h": [_flat(side[h])[0] for h in ("h1s", "h2s")], "n": side["n"].to_numpy(), "v": ids_of(side["v"])})
        # numbers for ids and signatures that both sides share
        pool, rank = np.unique(np.concatenate([s["ids"] for s in sides]), return_inverse=True)
        marks = np.rec.fromarrays([np.concatenate([s["h"][i] for s in sides]) for i in (0, 1)])
        _, code = np.unique(marks, return_inverse=True)
        cut_at = len(sides[0]["ids"])
        for s, own in zip(sides, (slice(None, cut_at), slice(cut_at, None))):
            s["rank"], s["code"], s["size"] = rank[own], code.reshape(-1)[own], np.diff(s["at"])
        one, two = sides
        weight_of = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        count, best = 0, _Best(most)
        for i, j, sim in found:
            other = one["v"][i] != two["v"][j]  # heads of one vector are counted from their sizes
            i, j, sim = i[other], j[other], sim[other]
            plain = (one["size"][i] == 1) & (two["size"][j] == 1)
            a, b = one["at"][i[plain]], two["at"][j[plain]]
            differ = one["code"][a] != two["code"][b]
            a, b = a[differ], b[differ]
            weight = one["m"][a] * two["m"][b]
            count += int(weight.sum())
            best.add(one["rank"][a], two["rank"][b], sim[plain][differ], weight)
            i, j, sim = i[~plain], j[~plain], sim[~plain]
            count += int((one["n"][i] * two["n"][j]).sum())
            for row in np.unique(i):  # less the row pairs of equal metadata
                own = slice(one["at"][row], one["at"][row + 1])
                weight_of[one["code"][own]] = one["m"][own]
                partners = j[i == row]
                size = two["size"][partners]
                at = np.repeat(two["at"][partners] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                count -= int((weight_of[two["code"][at]] * two["m"][at]).sum())
                weight_of[one["code"][own]] = 0
            for x in np.lexsort((j, i, -sim)):
                if not best.admits(sim[x], min(one["rank"][one["at"][i[x]]], two["rank"][two["at"][j[x]]])):
                    if best.rows[2][-1] > sim[x]:
                        break
                    continue
                a = np.arange(one["at"][i[x]], min(one["at"][i[x] + 1], one["at"][i[x]] + most + 2))
                b = np.arange(two["at"][j[x]], min(two["at"][j[x] + 1], two["at"][j[x]] + most + 2))
                a, b = np.repeat(a, len(b)), np.tile(b, len(a))
                differ = one["code"][a] != two["code"][b]
                a, b = a[differ], b[differ]
                best.add(one["rank"][a], two["rank"][b], np.full(len(a), sim[x]), one["m"][a] * two["m"][b])
        a, b, sim, weight = best.rows
        size = len(a)
        columns = [pa.array(pool[a]), pa.array(pool[b]), pa.array(np.full(size, LISTED, "int32")), pa.array(sim), pa.array(weight)]
        listed = pa.table(columns, names=fields.names).cast(fields) if size else fields.empty_table()
        total = pa.table([pa.nulls(1, fields.field(n).type) if n in "ab" else pa.array([{"kind": COUNT, "weight": count}.get(n, 0)]) for n in fields.names], names=fields.names)
        yield from (listed, total.cast(fields))

    return similar(heads, threshold, kernel, f"a {kind}, b {kind}, kind int, similarity double, weight long")
