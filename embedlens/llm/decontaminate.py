"""Benchmark decontamination by latent semantic retrieval.

1. Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased, hashed to ``TERMS`` terms. Document
   frequencies of terms are counted over all passages (``PASSAGE`` words each) of all texts.
2. Randomised SVD of the TF-IDF matrix of all passages of all texts. Each passage is added with a random sign to one of ``SKETCH`` random rows; tasks
   sum what they read, ranges of terms are summed by Spark, and the driver, which gets ``SKETCH`` x ``TERMS`` numbers whatever the input, takes the
   ``RANK`` strongest right singular directions V. Words that occur in the same passages have like rows in V.
3. Items above 64 words are looked for as passages of 64 words. A passage's image is q + ``LATENT`` V V'q: its own words, and words that occur where they do.
   Every window of 16, 32 and 64 words of every text (half overlapping) is scored by its cosine with the images of the passages whose length asks for that
   window, in blocks of a matrix product; q is held in the span of its slice's passages, V V'q in the corpus' directions.
   Windows at ``COSINE`` or more are candidates for the passage's item.
4. A candidate is checked on words: the longest common subsequence of the item and the text around the window, as a
   share of the item. At ``EXACT`` or more it is a match; from ``PARAPHRASE`` on it is if the item's answer (its last sentence,
   at most ``ANSWER`` words) is found there as well.
5. Items with fewer than ``LEAST`` words match where all of their words follow one another, and only there.

Texts are not shuffled unless matches of several slices exceed ``FOUND_BYTES``: matches are found where the text is read. The benchmark is read in
slices of ``ITEMS`` passages, which bounds the span, and one pass over the documents searches ``SLICES`` of them, which bounds what tasks are sent. If there is
more than one slice, matches are written by a 128-bit fingerprint of the text and joined to the rows at the end. Items of a single word are not looked for, as they would match anything. Null texts have no words; null item_id is not looked for; repeated items count once.
Repeated rows are judged each. Extra columns are ignored, or kept by ``remove_contaminated``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import kernels
from embedlens.session import cut

TERMS, PASSAGE = 1 << 15, 32
SKETCH, RANK, LATENT, RANGES = 128, 64, 2.0, 16
SLOTS = 4096
BLOCK, SCALES = 8, (2, 4, 8)
COSINE = 0.35
EXACT, PARAPHRASE, ANSWER, ANSWER_SHARE = 0.8, 0.6, 8, 0.8
LEAST, ITEMS, SLICES, FOUND_BYTES = 6, 256, 8, 16_000_000
LONGEST = SCALES[-1] * BLOCK

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def slice_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of each text's first word (n + 1 numbers)."""
    clean = np.where(_WORD[data], kernels.lower_ascii(data), np.uint8(32))
    starts, ends, firsts = kernels.word_bounds(clean, offs)
    return kernels.hash_runs(clean, starts, ends), firsts


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return slice_words(data, np.array([0, len(data)]))[0]


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) & (TERMS - 1)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def _cut(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each run of ``size`` words inside texts, and for each text its first run (n + 1 numbers)."""
    runs = -(-np.diff(firsts) // size)
    at = np.concatenate([[0], np.cumsum(runs)])
    inner = np.arange(int(at[-1])) - np.repeat(at[:-1], runs)
    return np.repeat(firsts[:-1], runs) + inner * size, at


def _padded(words: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Terms of each run of at most ``size`` words as a row, filled up with ``TERMS``."""
    lens = np.diff(np.append(begin, len(words)))
    out = np.full((len(begin), size), TERMS, np.int32)
    inside = np.arange(size) < lens[:, None]
    out[inside] = _terms(words)
    return out


def term_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and the number of passages, over all texts."""

    def work(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, _, data, offs in kernels.slices(batch.column(0)):
                words, firsts = slice_words(data, offs)
                begin, _ = _cut(firsts, PASSAGE)
                rows = np.sort(_padded(words, begin, PASSAGE), axis=1)
                new = np.ones(rows.shape, bool)
                new[:, 1:] = rows[:, 1:] != rows[:, :-1]
                total += np.bincount(rows[new], minlength=TERMS + 1)[:TERMS]
                n += len(begin)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "counts"])

    def fold(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            n += int(np.sum(batch.column(0).to_numpy()))
            for b in batch.column(1):
                total += np.frombuffer(b.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "counts"])

    kind = "n long, counts binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(work, kind)
    got = parts.repartition(16).mapInArrow(fold, kind).collect()  # at most 16 sums
    return sum((np.frombuffer(r["counts"], np.int64) for r in got), np.zeros(TERMS, np.int64)), sum(r["n"] for r in got)


def tfidf_rows(words: np.ndarray, begin: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of unit-length TF-IDF rows; row i is the words from begin[i] on."""
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
    key, count = np.unique(row * TERMS + _terms(words), return_counts=True)
    row, term = key // TERMS, key % TERMS
    value = count * idf[term]
    norm = np.sqrt(np.bincount(row, value * value, len(begin)))
    return row, term, value / np.maximum(norm[row], 1e-12)


def idf_of(frequencies: tuple[np.ndarray, int]) -> np.ndarray:
    counts, n = frequencies
    return np.log((n + 1) / (counts + 1)) + 0.1


def latent_directions(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Strongest right singular directions (``TERMS`` x at most ``RANK``) of the TF-IDF matrix of all passages, from a random sketch of its rows.

    Row and sign of a passage come from its doc_id, text and place in it, so they don't depend on partitions."""
    width = TERMS // RANGES

    def work(batches):
        total = np.zeros(SKETCH * TERMS, np.float32)
        for batch in batches:
            seeds = batch.column(0).to_numpy().view(np.uint64)
            for lo, _, data, offs in kernels.slices(batch.column(1)):
                words, firsts = slice_words(data, offs)
                begin, at = _cut(firsts, PASSAGE)
                if not len(begin):
                    continue
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                drawn = kernels.mix(seeds[lo + text] + (np.arange(len(begin)) - at[text]).astype(np.uint64))
                place = ((drawn >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64)
                sign = 1 - 2 * (drawn & np.uint64(1)).astype(np.int64)
                row, term, value = tfidf_rows(words, begin, idf)
                np.add.at(total, place[row] * TERMS + term, (sign[row] * value).astype(np.float32))
        parts = total.reshape(SKETCH, RANGES, width).transpose(1, 0, 2)
        for k in range(RANGES):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([parts[k].tobytes()], pa.binary())], ["part", "data"])

    def fold(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums.setdefault(k, np.zeros(SKETCH * width))
                sums[k] += np.frombuffer(b.as_py(), np.float32)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "data"])

    kind = "part int, data binary"
    rows = docs.select(F.xxhash64("doc_id", F.col("text").cast("string")).alias("seed"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(work, kind).repartition(RANGES, "part").mapInArrow(fold, kind).collect()  # RANGES rows
    sketch = np.zeros((SKETCH, RANGES, width))
    for r in got:
        sketch[:, r["part"]] = np.frombuffer(r["data"], np.float32).reshape(SKETCH, width)
    sketch = sketch.reshape(SKETCH, TERMS)
    square, left = np.linalg.eigh(sketch @ sketch.T)
    use = np.argsort(-square)[:RANK]
    use = use[square[use] > 1e-9 * max(square.max(), 1e-300)]
    return (sketch.T @ left[:, use] / np.sqrt(square[use])).astype(np.float32)


def directions(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All right singular directions of the passages' TF-IDF matrix (terms of them x rank), and the row of each term, the last for others."""
    begin = np.concatenate([[0], np.cumsum([len(w) for w in passages])])[:-1].astype(np.int64)
    row, term, value = tfidf_rows(np.concatenate(passages or [np.zeros(0, np.uint64)]), begin, idf)
    used, column = np.unique(term, return_inverse=True)
    slot = np.full(TERMS + 1, len(used), np.int32)
    slot[used] = np.arange(len(used))
    rows = np.zeros((len(passages), len(used)))
    rows[row, column] = value
    _, size, v = np.linalg.svd(rows, full_matrices=False)
    v = v[size > 1e-6 * size.max(initial=0)]
    return np.vstack([v.T, np.zeros((1, len(v)))]).astype(np.float32), slot


@dataclass
class Index:
    ids: np.ndarray
    numbers: np.ndarray  # of items in the benchmark
    words: list[np.ndarray]
    answers: list[np.ndarray]
    short: dict[int, dict[bytes, list[int]]]  # by number of words: items by their words
    owner: np.ndarray  # item of each passage
    offset: np.ndarray  # first word of each passage in its item
    scale: np.ndarray  # of each passage
    images: list[np.ndarray]  # per scale: rank x passages
    members: list[np.ndarray]  # per scale: places of its passages
    slot: np.ndarray  # row of each term in ``weighted``
    member: np.ndarray  # of each item: how many of its words' hashes have each of ``SLOTS`` values
    latent: np.ndarray  # terms x corpus directions, idf times direction
    weighted: np.ndarray  # terms of passages x rank, idf times direction
    square: np.ndarray  # squared idf


def answer_of(text: str) -> str:
    """The last sentence, at most ``ANSWER`` words of it."""
    sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
    return " ".join((sentences[-1] if sentences else "").split()[-ANSWER:])


def passages_of(n: int) -> list[int]:
    """First words of the passages of an item of ``n`` words; the last one ends with the item."""
    return [*range(0, n - LONGEST, LONGEST), n - LONGEST] if n > LONGEST else [0]


def weighted_space(idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Corpus directions as windows meet them: a row per term, times its idf, and one of zeros."""
    return np.vstack([space * idf[:, None].astype(np.float32), np.zeros((1, space.shape[1]), np.float32)])


def build(items: list[tuple[int, int, str, int, int]], idf: np.ndarray, space: np.ndarray, latent: np.ndarray) -> Index:
    """The index of a slice of items, each with its passages from one number to another, over the corpus' statistics and directions."""
    words = [item_words(t) for _, _, t, _, _ in items]
    short: dict[int, dict[bytes, list[int]]] = {}
    cuts = []
    for i, (own, (*_, lo, hi)) in enumerate(zip(words, items)):
        if len(own) < LEAST:
            short.setdefault(len(own), {}).setdefault(own.tobytes(), []).append(i)
        else:
            cuts += [(i, at) for at in passages_of(len(own))[lo:hi]]
    owner, offset = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))
    passages = [words[i][at : at + LONGEST] for i, at in cuts]
    v, slot = directions(passages, idf)
    scale = np.searchsorted(np.array(SCALES[:-1]) * BLOCK, [len(w) for w in passages])
    images, members = [], []
    for s in range(len(SCALES)):
        own = np.flatnonzero(scale == s)
        q, p = np.zeros((len(own), v.shape[1]), np.float32), np.zeros((len(own), space.shape[1]), np.float32)
        if len(own):
            begin = np.concatenate([[0], np.cumsum([len(passages[i]) for i in own])])[:-1].astype(np.int64)
            row, term, value = tfidf_rows(np.concatenate([passages[i] for i in own]), begin, idf)
            np.add.at(q, row, v[slot[term]] * value[:, None].astype(np.float32))
            np.add.at(p, row, space[term] * value[:, None].astype(np.float32))
        # of q + LATENT V V'q, for orthonormal V
        length = np.sqrt((q * q).sum(axis=1) + (2 * LATENT + LATENT * LATENT) * (p * p).sum(axis=1))
        images.append(np.ascontiguousarray((np.hstack([q, LATENT * p]) / np.maximum(length, 1e-9)[:, None]).T))
        members.append(own)
    known = np.flatnonzero(slot[:TERMS] < len(v) - 1)
    weighted = v.copy()
    weighted[slot[known]] *= idf[known, None].astype(np.float32)
    ids, numbers = (np.array([t[k] for t in items], np.int64) for k in (1, 0))
    member = np.zeros((len(items), SLOTS), np.float32)
    for i, own in enumerate(words):
        member[i] = np.bincount(_slots(own), minlength=SLOTS)
    answers = [item_words(answer_of(t)) for _, _, t, _, _ in items]
    return Index(ids, numbers, words, answers, short, owner, offset, scale, images, members, slot, member, latent, weighted, np.append(idf * idf, 0).astype(np.float32))


def _word_sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` of each block's words, and a block of zeros."""
    sums = np.zeros((len(rows) + 1, table.shape[1]), np.float32)
    for lo in range(0, len(rows), 2048):
        for j in range(BLOCK):
            sums[lo : min(lo + 2048, len(rows))] += table[rows[lo : lo + 2048, j]]
    return sums


def candidates(index: Index, words: np.ndarray, firsts: np.ndarray, cosine: float = COSINE) -> list[tuple[int, int, int, float]]:
    """(text, first word of the window, passage, cosine) of windows that may hold a passage."""
    begin, runs = _cut(firsts, BLOCK)
    if not len(begin):
        return []
    terms = _padded(words, begin, BLOCK)
    sums = [_word_sums(index.weighted, index.slot[terms]), _word_sums(index.latent, terms)]
    square = np.append(index.square[terms].sum(axis=1), 0).astype(np.float32)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(runs))
    out = []
    for s, blocks in enumerate(SCALES):
        if not len(index.members[s]):
            continue
        at = np.arange(len(begin))
        at = at[(at - runs[text]) % max(1, blocks // 2) == 0]
        windows, norm = [np.zeros((len(at), own.shape[1]), np.float32) for own in sums], np.zeros(len(at), np.float32)
        stop = runs[text[at] + 1]
        for j in range(blocks):
            part = np.where(at + j < stop, at + j, len(begin))
            for window, own in zip(windows, sums):
                window += own[part]
            norm += square[part]
        norm = np.sqrt(np.maximum(norm, 1e-12))
        for lo in range(0, len(at), 8192):
            at_, rank = slice(lo, lo + 8192), windows[0].shape[1]
            score = windows[0][at_] @ index.images[s][:rank]
            score += windows[1][at_] @ index.images[s][rank:]
            score /= norm[at_, None]
            w, i = np.nonzero(score >= cosine)
            out += zip(text[at[lo + w]].tolist(), begin[at[lo + w]].tolist(), index.members[s][i].tolist(), score[w, i].tolist())
    return out


def places(item: np.ndarray) -> dict[int, int]:
    """Bits of the places of each word of an item."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(n: int, where: dict[int, int], text: np.ndarray, least: float = 0.0) -> int:
    """Length of the longest common subsequence of an item of ``n`` words and a text, by whole rows of bits; 0 if it can't reach ``least``."""
    hits = list(filter(None, map(where.get, text.tolist())))
    if len(hits) < least:
        return 0
    full = row = (1 << n) - 1
    for hit in hits:
        both = row & hit
        row = (row + both | row - both) & full
    return n - row.bit_count()


def short_matches(index: Index, words: np.ndarray, firsts: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) of items below ``LEAST`` words whose words follow one another in a text."""
    out = set()
    for n, known in index.short.items():
        heads = np.unique([np.frombuffer(k, np.uint64)[0] for k in known])
        at = np.flatnonzero(np.isin(words[: max(0, len(words) - n + 1)], heads))
        text = np.searchsorted(firsts, at, "right") - 1
        inside = at + n <= firsts[text + 1]
        for t, a in zip(text[inside].tolist(), at[inside].tolist()):
            out |= {(t, i) for i in known.get(words[a : a + n].tobytes(), ())}
    return out


def regions(index: Index, words: np.ndarray, firsts: np.ndarray, asked: list[tuple[int, int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last around each candidate's window; an empty region where too few words can be the item's.

    An item's words count where their hash value is in the region, so a count is never too low. Regions of long items are left as they are."""
    text, at, passage = (np.array([a[k] for a in asked], np.int64) for k in range(3))
    item = index.owner[passage]
    n = np.array([len(w) for w in index.words], np.int64)[item]
    begin = at - index.offset[passage]
    lo = np.maximum(firsts[text], begin - n)
    hi = np.maximum(lo, np.minimum(firsts[text + 1], begin + np.maximum(np.array(SCALES)[index.scale[passage]] * BLOCK, n) + n))
    slots = _slots(words)
    short = np.flatnonzero(n <= LONGEST)
    for part in range(0, len(short), 8192):
        own = short[part : part + 8192]
        size = hi[own] - lo[own]
        which = np.repeat(np.arange(len(own)), size)
        place = np.arange(int(size.sum())) + np.repeat(lo[own] - (np.cumsum(size) - size), size)
        key = item[own][which] * SLOTS + slots[place]
        inside = index.member.ravel()[key] > 0
        seen, first = np.unique(which[inside] * SLOTS + slots[place[inside]], return_index=True)
        most = np.bincount(seen // SLOTS, index.member.ravel()[key[inside][first]], len(own))
        few = own[most < PARAPHRASE * n[own]]
        hi[few] = lo[few]
    return lo, hi


def matches(index: Index, words: np.ndarray, firsts: np.ndarray) -> dict[int, dict[int, tuple[float, float]]]:
    """text -> item -> (share of the item found in order, cosine) of what is contaminated."""
    out: dict[int, dict[int, tuple[float, float]]] = {}
    for text, item in short_matches(index, words, firsts):
        out.setdefault(text, {})[item] = (1.0, 1.0)
    known: dict[int, tuple[dict, dict]] = {}
    tried: dict[tuple[int, int], list[int]] = {}
    asked = candidates(index, words, firsts)
    for (text, at, passage, cosine), lo, hi in zip(asked, *(side.tolist() for side in regions(index, words, firsts, asked))):
        item = int(index.owner[passage])
        own = index.words[item]
        n = len(own)
        begin = at - int(index.offset[passage])
        if lo == hi:
            continue
        if n > LONGEST:  # passages of one copy ask for about the same region
            near = tried.setdefault((text, item), [])
            if any(abs(begin - b) <= n // 4 for b in near):
                if item in out.get(text, {}):
                    share, best = out[text][item]
                    out[text][item] = (share, max(best, cosine))
                continue
            near.append(begin)
        region = words[lo:hi]
        if item not in known:
            known[item] = places(own), places(index.answers[item])
        share = common_subsequence(n, known[item][0], region, PARAPHRASE * n) / n
        if share < PARAPHRASE:
            continue
        if share < EXACT:
            answer = index.answers[item]
            if not len(answer) or common_subsequence(len(answer), known[item][1], region) < ANSWER_SHARE * len(answer):
                continue
        found = out.setdefault(text, {})
        found[item] = max(found.get(item, (0.0, 0.0)), (share, cosine))
    return out


def benchmark_slices(benchmark: DataFrame):
    """Lists of (number, item_id, text, first passage, passage after the last) with at most ``ITEMS`` passages, in order of item_id, one after another."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held, free = [], ITEMS
    for number, r in enumerate(rows.distinct().orderBy("item_id", "text").toLocalIterator()):
        n, lo = len(item_words(r["text"])), 0
        n = len(passages_of(n)) if n > 1 else 0
        while lo < n:
            hi = min(n, lo + free)
            held.append((number, r["item_id"], r["text"], lo, hi))
            free, lo = free - (hi - lo), hi
            if not free:
                yield held
                held, free = [], ITEMS
    if held:
        yield held


_FOUND = "array<struct<item_id: bigint, share: double, cosine: double>>"


def _marked(rows: DataFrame, index: Index) -> DataFrame:
    """``row_, found_`` with the matches of a single slice of items."""

    def work(batches):
        for batch in batches:
            found = [[] for _ in range(len(batch))]
            for lo, _, data, offs in kernels.slices(batch.column(1)):
                words, firsts = slice_words(data, offs)
                for text, own in matches(index, words, firsts).items() if len(words) else ():
                    found[lo + text] = [{"item_id": int(index.ids[i]), "share": s, "cosine": c} for i, (s, c) in sorted(own.items())]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["row_", "found_"])

    return rows.select("row_", "text_").mapInArrow(work, f"row_ {rows.schema['row_'].dataType.simpleString()}, found_ {_FOUND}")


def _matched(rows: DataFrame, indexes: list[Index]) -> DataFrame:
    """``key_, number, item_id, best``: the matches of some slices of items by fingerprint of the text."""

    def work(batches):
        for batch in batches:
            out = []
            for lo, _, data, offs in kernels.slices(batch.column(1)):
                words, firsts = slice_words(data, offs)
                found = [(index, text, own) for index in indexes for text, own in matches(index, words, firsts).items()] if len(words) else ()
                for index, text, own in found:
                    key = batch.column(0)[lo + text].as_py()
                    out += [(key, int(index.numbers[i]), int(index.ids[i]), s, c) for i, (s, c) in own.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["key_", "number", "item_id", "share", "cosine"])

    found = rows.select("key_", "text_").mapInArrow(work, "key_ string, number long, item_id long, share double, cosine double")
    return found.groupBy("key_", "number", "item_id").agg(F.max(F.struct("share", "cosine")).alias("best"))


def _searched(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """``row_`` (columns ``keep``) and ``found_`` of each row."""
    row, text = F.struct(*(F.col(f"`{c}`") for c in keep)), F.col("text").cast("string")
    rows = docs.select(row.alias("row_"), text.alias("text_"), F.md5(text.cast("binary")).alias("key_"))
    slices = benchmark_slices(benchmark)
    items, after = next(slices, None), next(slices, None)
    if items is None:
        return rows.select("row_", F.array().cast(_FOUND).alias("found_"))
    idf = idf_of(term_frequencies(docs))
    space = latent_directions(docs, idf)
    latent = weighted_space(idf, space)
    if after is None:
        return _marked(rows, build(items, idf, space, latent))
    found = [cut(_matched(rows, [build(own, idf, space, latent) for own in some])) for some in batched(chain((items, after), slices), SLICES)]
    found = reduce(DataFrame.unionAll, found).groupBy("key_", "number", "item_id").agg(F.max("best").alias("best"))
    small = found.count() * 100 <= FOUND_BYTES
    found = found.groupBy("key_").agg(F.sort_array(F.collect_list(F.struct("number", "item_id", "best"))).alias("all_"))
    found = found.select("key_", F.transform("all_", lambda f: F.struct(f.item_id.alias("item_id"), f.best.share.alias("share"), f.best.cosine.alias("cosine"))).alias("found_"))
    joined = rows.select("row_", "key_").join(F.broadcast(found) if small else found, "key_", "left")
    return joined.select("row_", F.coalesce("found_", F.array().cast(_FOUND)).alias("found_"))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, found``: array of (item_id, share, cosine), empty if clean; a row per row of ``docs``."""
    return _searched(docs, benchmark, ["doc_id"]).select("row_.*", F.col("found_").alias("found"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as they were."""
    return _searched(docs, benchmark, docs.columns).where(F.size("found_") == 0).select("row_.*")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, share``: a row per row of ``docs``."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.size("found").cast("long").alias("n_items"),
        F.transform("found", lambda f: f.item_id).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f.share)), F.lit(0.0)).alias("share"),
    )
