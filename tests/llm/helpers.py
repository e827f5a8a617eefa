"""Brute-force versions that share no code with the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size=5):
    words = WORD.findall(lower_ascii(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_components(docs, percent=85):
    """doc_id -> smallest doc_id linked to it, over all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeated_bytes(docs, length=100):
    """doc_id -> (bytes, removed, spans, digest, kept bytes)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        cut = [False] * len(data)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                cut[at : at + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, c in zip(data, cut) if not c)
        spans = sum(c and not p for p, c in zip([False, *cut], cut))
        out[i] = (len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def base_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


# ---------------------------------------------------------------- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelling_words(docs):
    """word -> occurrences, from (doc_id, text)."""
    seen = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_rows(docs):
    """word -> (form, root, n, n_near, form_n), comparing all pairs of words."""
    words = spelling_words(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


# ---------------------------------------------------------------- nearest neighbours


def nearest_rows(rows, asked, k=10):
    """query -> [(id, distance)], from (id, vector) rows, by comparing all."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if asked(i)}:
        far = {}
        for i, v in good:
            for own, w in good:
                if own == q and i != q and len(v) == len(w):
                    far[i] = min(far.get(i, math.inf), math.dist(v, w))
        out[q] = sorted(far.items(), key=lambda e: (e[1], e[0]))[:k]
    return out


# ---------------------------------------------------------------- phrases


def phrase_rows(docs, least=10, cover=50, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang), counting every phrase by itself."""
    count, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower_ascii(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    chosen = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in chosen.items():
        if len(words) == 3:
            covered |= {(lang, part) for part in (words[:2], words[1:]) if 100 * a >= cover * count[lang, part]}
    out = {}
    for (lang, words), a in chosen.items():
        if (lang, words) in covered:
            continue
        cuts = [(count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((10**6 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return [
        (lang, i + 1, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, rows in out.items() for i, (score, a, phrase, l, r) in enumerate(sorted(rows)[:first])
    ]
