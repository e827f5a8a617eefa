"""Removal of repeated substrings of ``LENGTH`` bytes, exact, from a sparse suffix array.

Every byte string of ``LENGTH`` = 100 bytes that also starts earlier (smaller doc_id, or same document and earlier start)
marks its bytes as removed.

1. Anchors. In each window of 100 bytes the 40-byte gram with the least hash (leftmost if tied) is its anchor, so equal
   windows have equal anchors at equal places. The windows of one anchor are a run of neighbouring starts; about
   3 % of all positions are anchors. A map task sends (anchor hash, run hash, place) in column blobs to buckets of
   hashes, for equal runs in its batch only the earliest: the others are covered already.
2. In a bucket, of all equal runs the earliest stays and all windows of the others are covered. Anchors with
   different runs, which is where repeated passages begin and end, are open.
3. For open runs the texts are read by a join. Suffixes that start at the anchors, and the bytes before them read
   backwards, are sorted by deep-shallow sorting; the common prefixes of neighbours decide for each window of
   each run, on real bytes, which have equal content. The earliest stays, the others are covered.
   Anchors with more than ``HOT`` different runs aren't brought to one task: each of their windows is keyed by 128 bits of hash, the
   earliest place of each key is a grouped minimum, and windows that start later are covered.
4. Covered stretches of each document are merged and cut from its text.

Buckets are as many as the size of the input asks for. A passage that a third of all documents share costs a bucket one
entry per map batch, plus one per distinct run at its two ends. Null text counts as empty, null doc_id as the smallest
id. Rows of one doc_id and one text count once, and each gets the result; other texts under the same doc_id count as
other documents, told apart and ordered by 128 bits of hash of the text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import kernels
from embedlens.llm.suffix_sort import deep_shallow_order, neighbour_lcp
from embedlens.session import cut

LENGTH, GRAM = 100, 40
BUCKET_BYTES = 24_000_000
OPEN_PER_BUCKET = 60_000
HOT = 60_000
_SPAN = 1 << 18
_NULL_ID = -(1 << 63)

#: doc_id, 128-bit text key, first start, number of starts, anchor's place, gram hash, run hash
RUN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("tag2", "<i8"), ("at", "<u4"), ("n", "u1"), ("off", "u1"), ("gram", "<u8"), ("run", "<u8")])
#: a document is a doc_id and a text; texts of one doc_id are told apart, and ordered, by 128 bits of hash
KEY = ["doc", "tag", "tag2"]
COVER = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("tag2", "<i8"), ("at", "<u4"), ("end", "<u4")])


def pack(rows: np.ndarray) -> bytes:
    """Columns one after another, which compress better than rows."""
    return np.int64(len(rows)).tobytes() + b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    counts = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
    out, at = np.empty(sum(counts), kind), 0
    for blob, n in zip(blobs, counts):
        off = 8
        for c in kind.names:
            out[c][at : at + n] = np.frombuffer(blob, kind[c], n, off)
            off += n * kind[c].itemsize
        at += n
    return out


def _powers() -> tuple[np.ndarray, np.ndarray]:
    step = np.full(_SPAN + 2 * LENGTH, kernels._STEP)
    back = np.full(_SPAN + 2 * LENGTH, np.uint64(pow(int(kernels._STEP), -1, 1 << 64)))
    step[0] = back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


def anchored_runs(data: np.ndarray, offs: np.ndarray, power: np.ndarray, back: np.ndarray):
    """(text, start, number of starts, anchor - start, gram hash, run hash) of all runs of texts laid end to end."""
    grams = LENGTH - GRAM + 1
    out = []
    for base in range(0, len(data) - LENGTH + 1, _SPAN):
        part = data[base : base + _SPAN + LENGTH - 1]
        n = len(part)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(kernels._BYTE[part] * power[:n], out=sums[1:])
        gram = kernels.mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        low = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < grams:
            low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.arange(len(at))
        text = np.searchsorted(offs, base + starts, "right") - 1
        good = base + starts + LENGTH <= offs[text + 1]
        new = good.copy()
        new[1:] &= (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.flatnonzero(good & ~np.append(good[1:] & ~new[1:], False)) + 1
        ends = stop - 1 + LENGTH
        run = kernels.mix((sums[ends] - sums[first]) * back[first] + (stop - first).astype(np.uint64))
        out.append((text[first], base + first - offs[text[first]], stop - first, at[first] - first, gram[at[first]], run))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(c) for c in zip(*out)]


def _order(rows: np.ndarray) -> list[np.ndarray]:
    """Sort keys of documents, least significant first."""
    return [rows[c] for c in reversed(KEY)]


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] != b["doc"]) | (a["tag"] != b["tag"]) | (a["tag2"] != b["tag2"])


def split_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of (gram, run, place); True for those that are the earliest of their kind or at its place."""
    rows = rows[np.lexsort((rows["at"], *_order(rows), rows["run"], rows["gram"]))]
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = (rows["run"][1:] != rows["run"][:-1]) | (rows["gram"][1:] != rows["gram"][:-1])
    lead = rows[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(rows) else rows
    earliest = ~_differ(rows, lead) & (rows["at"] == lead["at"])
    return rows, new, earliest


def covers(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), COVER)
    for c in (*KEY, "at"):
        out[c] = rows[c]
    out["end"] = rows["at"].astype(np.int64) + rows["n"] - 1 + LENGTH
    return out


def merge(rows: np.ndarray) -> np.ndarray:
    """Stretches of each document that overlap or touch, joined."""
    rows = rows[np.lexsort((rows["at"], *_order(rows)))]
    if len(rows) < 2:
        return rows
    other = _differ(rows[1:], rows[:-1])
    group = np.append(0, np.cumsum(other))
    reach = np.maximum.accumulate(rows["end"].astype(np.int64) + group * (1 << 33)) - group * (1 << 33)
    new = np.append(True, other | (rows["at"][1:] > reach[:-1]))
    first = np.flatnonzero(new)
    out = rows[first]
    out["end"] = reach[np.append(first[1:], len(rows)) - 1]
    return out


def by_document(rows: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Rows by the bucket of their document; texts of one doc_id go to different ones."""
    key = kernels.mix(rows["doc"].astype(np.uint64) ^ rows["tag"].astype(np.uint64)) % np.uint64(buckets)
    return by_bucket(rows, key, buckets)


def by_bucket(rows: np.ndarray, key: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(buckets + 1, dtype=np.uint64))
    return [(b, rows[order[cuts[b] : cuts[b + 1]]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


_BLOBS = "bucket int, kind string, data binary"


def _blobs(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.string()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _take(table: pa.Table, kind: str, dtype: np.dtype) -> np.ndarray:
    kinds = table.column("kind").to_pylist()
    data = table.column("data")
    return unpack([data[i].as_py() for i, k in enumerate(kinds) if k == kind], dtype)


def documents(docs: DataFrame, *keep: str) -> DataFrame:
    """``row`` (the columns to keep but for text, and whether text is null), ``doc``, ``tag``, ``tag2`` (which of the texts of a doc_id) and ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.struct(F.struct(F.col("doc_id"), *(F.col(f"`{c}`") for c in keep if c not in ("doc_id", "text"))).alias("own"), F.col("text").isNull().alias("absent")).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"),
        F.xxhash64(text).alias("tag"),
        F.xxhash64(F.lit(1), text).alias("tag2"),
        text.alias("text"),
    )


def anchor_blobs(rows: DataFrame, buckets: int) -> DataFrame:
    """Runs by bucket of their anchor, and stretches that copies in the same batch cover."""

    def work(batches):
        power, back = _powers()
        for batch in batches:
            key = [batch.column(i).to_numpy() for i in range(3)]
            parts = []
            for lo, _, data, offs in kernels.slices(batch.column(3)):
                text, at, n, off, gram, run = anchored_runs(data, offs, power, back)
                got = np.empty(len(at), RUN)
                for c, values in zip(KEY, key):
                    got[c] = values[lo + text]
                got["at"], got["n"], got["off"], got["gram"], got["run"] = at, n, off, gram, run
                parts.append(got)
            runs, new, earliest = split_equal(np.concatenate(parts) if parts else np.empty(0, RUN))
            out = [(b, "runs", pack(r)) for b, r in by_bucket(runs[new], runs["gram"][new] % np.uint64(buckets), buckets)]
            own = runs[~earliest]
            if len(own):
                out += [(b, "cover", pack(r)) for b, r in by_document(merge(covers(own)), buckets)]
            yield _blobs(out)

    return rows.select(*KEY, "text").mapInArrow(work, _BLOBS)


def resolve_runs(blobs: DataFrame, buckets: int) -> DataFrame:
    """By bucket of documents: covered stretches, and the runs that are still open, those of hot anchors apart."""
    most = HOT

    def work(table: pa.Table) -> pa.Table:
        out = []
        cover = _take(table, "cover", COVER)
        runs, new, earliest = split_equal(_take(table, "runs", RUN))
        if len(runs):
            kinds = runs[new]
            same = np.zeros(len(kinds), bool)
            equal = kinds["gram"][1:] == kinds["gram"][:-1]
            same[1:] |= equal
            same[:-1] |= equal
            kinds = kinds[same]
            _, gram, count = np.unique(kinds["gram"], return_inverse=True, return_counts=True)
            hot = count[gram] > most
            for kind, own in (("open", kinds[~hot]), ("hot", kinds[hot])):
                out += [(b, kind, pack(r)) for b, r in by_document(own, buckets)]
            cover = np.concatenate([cover, covers(runs[~earliest])])
        if len(cover):
            out += [(b, "cover", pack(r)) for b, r in by_document(merge(cover), buckets)]
        return pa.Table.from_batches([_blobs(out)])

    return blobs.groupBy("bucket").applyInArrow(work, _BLOBS)


def per_document(blobs: DataFrame, kind: str, dtype: np.dtype) -> DataFrame:
    """``doc, tag, tag2, data``: the rows of each document in one blob; stretches are merged."""

    def work(table: pa.Table) -> pa.Table:
        rows = _take(table, kind, dtype)
        rows = merge(rows) if dtype == COVER else rows[np.lexsort((rows["at"], *_order(rows)))]
        new = np.append(True, _differ(rows[1:], rows[:-1]))[: len(rows)]
        cuts = np.append(np.flatnonzero(new), len(rows))
        first = rows[cuts[:-1]]
        data = [pack(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table({c: pa.array(first[c]) for c in KEY} | {"data": pa.array(data, pa.binary())})

    return blobs.where(F.col("kind") == kind).groupBy("bucket").applyInArrow(work, "doc long, tag long, tag2 long, data binary")


def open_contexts(open_: DataFrame, buckets: int) -> DataFrame:
    """Open runs with the bytes of their windows, by bucket of their anchor."""

    def work(batches):
        for batch in batches:
            raw, offs = kernels.text_bytes(batch.column(1))
            runs, pieces = [], []
            for i, blob in enumerate(batch.column(0)):
                own = unpack([blob.as_py()], RUN)
                runs.append(own)
                text = raw[offs[i] : offs[i + 1]]
                bytes_ = np.zeros((len(own), 2 * LENGTH), np.uint8)
                for j, (at, n) in enumerate(zip(own["at"].tolist(), own["n"].tolist())):
                    bytes_[j, : n + LENGTH - 1] = text[at : at + n + LENGTH - 1]
                pieces.append(bytes_)
            if not runs:
                continue
            runs, pieces = np.concatenate(runs), np.concatenate(pieces)
            place = np.arange(len(runs))
            out = []
            for b, own in by_bucket(place, runs["gram"] % np.uint64(buckets), buckets):
                out += [(b, "runs", pack(runs[own])), (b, "bytes", pieces[own].tobytes())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out[::2]], pa.int32()), pa.array([x[2] for x in out[::2]], pa.binary()), pa.array([x[2] for x in out[1::2]], pa.binary())],
                ["bucket", "runs", "bytes"],
            )

    # row is not used here, but with it the texts' shuffle is the one that cut_out reads as well
    return open_.select("data", "text", "row").mapInArrow(work, "bucket int, runs binary, bytes binary")


def covered_windows(runs: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Stretches of open runs whose windows start earlier in another run, by sorted suffixes on both sides of anchors."""
    n, off = len(runs), runs["off"].astype(np.int64)
    total = runs["n"].astype(np.int64) + LENGTH - 1
    column = np.arange(LENGTH)
    right_len = np.minimum(total - off, LENGTH)
    right = np.take_along_axis(pieces, np.minimum(off[:, None] + column, 2 * LENGTH - 1), 1)
    right[column[None, :] >= right_len[:, None]] = 0
    left = np.take_along_axis(pieces, np.maximum(off[:, None] - 1 - column[: LENGTH - GRAM], 0), 1)
    left[column[None, : LENGTH - GRAM] >= off[:, None]] = 0
    classes = []
    for rows, lens in ((right, right_len), (left, off)):
        order = deep_shallow_order(rows, lens)
        classes.append((order, neighbour_lcp(rows, lens, order)))
    spot = runs["at"].astype(np.int64) + off
    _, rank = np.unique(np.rec.fromarrays([*(runs[c] for c in KEY), spot]), return_inverse=True)
    hit = np.zeros((n, LENGTH - GRAM + 1), bool)
    for o in range(LENGTH - GRAM + 1):
        own = np.flatnonzero((o <= off) & (o > off - runs["n"]))
        if len(own) < 2:
            continue
        sides = []
        for (order, lcp), need in zip(classes, (LENGTH - o, o)):
            side = np.empty(n, np.int64)
            side[order] = np.cumsum(lcp < need)
            sides.append(side[own])
        key = sides[0] * (n + 1) + sides[1]
        place = np.lexsort((rank[own], key))
        key, own = key[place], own[place]
        new = np.append(True, key[1:] != key[:-1])
        lead = rank[own[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        hit[own[rank[own] > lead], o] = True
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    out = np.empty(len(row), COVER)
    for c in KEY:
        out[c] = runs[c][row]
    out["at"], out["end"] = spot[row] - high, spot[row] - low + LENGTH
    return out


def resolve_open(contexts: DataFrame, buckets: int) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        runs = unpack([b.as_py() for b in table.column("runs")], RUN)
        pieces = np.frombuffer(b"".join(b.as_py() for b in table.column("bytes")), np.uint8).reshape(-1, 2 * LENGTH)
        return pa.Table.from_batches([_blobs([(b, "cover", pack(r)) for b, r in by_document(merge(covered_windows(runs, pieces)), buckets)])])

    return contexts.groupBy("bucket").applyInArrow(work, _BLOBS)


def hot_windows(hot: DataFrame) -> DataFrame:
    """``h1, h2, doc, tag, tag2, at``: each window of runs of hot anchors with 128 bits of hash."""

    def work(batches):
        power, back = (p[: 2 * LENGTH] for p in _powers())
        column = np.arange(LENGTH - GRAM + 1)
        for batch in batches:
            raw, offs = kernels.text_bytes(batch.column(1))
            for i, blob in enumerate(batch.column(0)):
                runs, text = unpack([blob.as_py()], RUN), raw[offs[i] : offs[i + 1]]
                for lo in range(0, len(runs), 4096):
                    own = runs[lo : lo + 4096]
                    at, inside = own["at"].astype(np.int64)[:, None] + column, column < own["n"][:, None]
                    place = np.minimum(own["at"].astype(np.int64)[:, None] + np.arange(2 * LENGTH), len(text) - 1)
                    hashes = []
                    for values in (kernels._BYTE, kernels.stream(9, 256)):
                        sums = np.zeros((len(own), 2 * LENGTH + 1), np.uint64)
                        np.cumsum(values[text[place]] * power, axis=1, out=sums[:, 1:])
                        hashes.append(kernels.mix((sums[:, column + LENGTH] - sums[:, column]) * back[column])[inside])
                    n = own["n"]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(h.view(np.int64)) for h in hashes), *(pa.array(np.repeat(own[c], n)) for c in KEY), pa.array(at[inside])],
                        ["h1", "h2", *KEY, "at"],
                    )

    return hot.select("data", "text").mapInArrow(work, "h1 long, h2 long, doc long, tag long, tag2 long, at long")


def resolve_hot(hot: DataFrame, buckets: int) -> DataFrame:
    """Covered stretches of hot anchors' runs; no task holds an anchor."""

    def work(batches):
        for batch in batches:
            own = np.empty(len(batch), COVER)
            for k, c in enumerate([*KEY, "at"]):
                own[c] = batch.column(k).to_numpy()
            own["end"] = own["at"] + LENGTH
            yield _blobs([(b, "cover", pack(r)) for b, r in by_document(merge(own), buckets)])

    windows, place = hot_windows(hot), F.struct(*KEY, "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(first, ["h1", "h2"]).where(place > F.col("first")).select(*KEY, "at").mapInArrow(work, _BLOBS)


def repeated_stretches(rows: DataFrame) -> DataFrame:
    """``doc, tag, tag2, data``: merged covered stretches of each document that has any."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    found = cut(resolve_runs(anchor_blobs(rows, buckets), buckets))
    # an open blob holds 8 bytes and RUN.itemsize bytes a run
    sizes = found.where("kind <> 'cover'").groupBy("kind").agg(F.sum(F.octet_length("data")).alias("n"))
    sizes = {r["kind"]: r["n"] for r in sizes.collect()}  # at most two rows
    cover = found.where("kind = 'cover'")
    if "open" in sizes:
        opened = per_document(found, "open", RUN).join(rows, KEY)
        sorts = max(8, -(-sizes["open"] // (RUN.itemsize * OPEN_PER_BUCKET)))
        cover = cover.unionAll(resolve_open(open_contexts(opened, sorts), buckets))
    if "hot" in sizes:
        cover = cover.unionAll(resolve_hot(per_document(found, "hot", RUN).join(rows, KEY), buckets))
    return per_document(cover, "cover", COVER)


def cut_out(rows: DataFrame) -> DataFrame:
    """``row, n_bytes, n_removed, n_spans, kept_sha256, kept`` from ``row, text, data``.

    The digest is of the bytes that stay; ``kept`` is them as text, without bytes of a character that was cut in the middle."""

    def work(batches):
        for batch in batches:
            raw, offs = kernels.text_bytes(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            for i, blob in enumerate(batch.column(2)):
                text = raw[offs[i] : offs[i + 1]]
                blob = blob.as_py()
                removed = spans = 0
                if blob is None:
                    kept = text.tobytes()
                else:
                    own, at, parts = unpack([blob], COVER), 0, []
                    for a, b in zip(own["at"].tolist(), own["end"].tolist()):
                        parts.append(text[at:a])
                        removed, spans, at = removed + b - a, spans + 1, b
                    kept = b"".join(p.tobytes() for p in [*parts, text[at:]])
                for column, value in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    kind = f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return rows.select("row", "text", "data").mapInArrow(work, kind)


def remove_repeats(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per row of ``docs``: columns ``keep`` (doc_id), sizes, removed bytes and runs, digest of what stays, the text that stays."""
    rows = documents(docs, *keep)
    out = cut_out(rows.join(repeated_stretches(rows), KEY, "left"))
    return out.select("row.own.*", *(F.col(c) for c in out.columns[1:]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated substrings cut from ``text`` and ``n_chars`` (if there) counted anew; other columns as they were.

    A null text stays null."""
    rows = documents(docs, *docs.columns)
    out = cut_out(rows.join(repeated_stretches(rows), KEY, "left"))
    text = F.when(~F.col("row.absent"), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.own.`{c}`") for c in docs.columns))
