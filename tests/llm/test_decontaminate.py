import random

import numpy as np
from helpers import lcs

from embedlens.llm import decontaminate

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]


def leaky(seed=0):
    rng = random.Random(seed)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(100 + i, " ".join(say(rng.randint(8, 60))) + ". " + " ".join(say(6)) + ".") for i in range(30)]
    docs, leaks = [], set()
    for d in range(120):
        text = say(rng.randint(0, 300))
        kind, (item, own) = d % 4, rng.choice(items)
        passage = own.split()
        if kind == 1:
            leaks.add((d, item))
        elif kind == 2:  # one word in six is another one, the answer stays
            passage = [rng.choice(WORDS) if k % 6 == 3 and k < len(passage) - 6 else w for k, w in enumerate(passage)]
            leaks.add((d, item))
        else:
            passage = []
        at = rng.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + [w.upper() for w in passage] + text[at:])))
    return docs, items, leaks


def test_finds_planted_passages_and_paraphrases(spark, docs_of):
    docs, items, leaks = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs_of(docs), bench).collect()
    got = {(r.doc_id, i) for r in rows for i in r.item_ids}
    assert len(rows) == 120 and got <= leaks and len(got & leaks) >= 0.95 * len(leaks)
    assert all(r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids) for r in rows)
    kept = decontaminate.remove_contaminated(docs_of(docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_slices_of_items_give_the_same(spark, docs_of, monkeypatch):
    docs, items, leaks = leaky(1)
    monkeypatch.setattr(decontaminate, "ITEMS", 11)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, i) for r in decontaminate.contamination(docs_of(docs), bench).collect() for i in r.item_ids}
    assert got <= leaks and len(got) >= 0.95 * len(leaks)


def test_subsequence_by_bits():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        where = decontaminate.places(np.array(a))
        assert decontaminate.common_subsequence(len(a), where, np.array(b)) == lcs(a, b)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "one two"), (2, None), (3, "x"), (1, "one two three four five six")], "item_id long, text string")
    got = [(r.doc_id, r.contaminated) for r in decontaminate.contamination(odd, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (3, False), (4, False), (5, True), (5, True), (None, True), (6, True), (7, False), (8, False), (None, False)], key=str)
    assert decontaminate.contamination(odd, bench.where("1 = 0")).where("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns


def test_items_of_any_length(spark, docs_of):
    """Items of hundreds of words are found whole or with a fifth of the words replaced, items of few words word for word."""
    rng = random.Random(5)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    sizes = [2, 3, 5, 65, 130, 400, 700, 1100, 2000]
    items = [(n, say(n)) for n in sizes]
    docs = [(n, say(200) + own + say(200)) for n, own in items]
    docs += [(10_000 + n, say(50) + [rng.choice(WORDS) if k % 5 == 2 and k < n - 8 else w for k, w in enumerate(own)] + say(90)) for n, own in items if n > 5]
    docs += [(20_000 + n, own[:-1] + ["other"] + own[-1:]) for n, own in items if n < 6] + [(30_000 + n, say(1000)) for n in range(5)]
    docs += [(40_000, items[2][1][:3]), (40_001, items[2][1][3:])]  # not one text
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs_of([(i, " ".join(w)) for i, w in docs], 1), bench).collect()}
    assert all(n in got[n] for n in sizes)
    assert all(10_000 + n in got and n in got[10_000 + n] for n in sizes if n > 5)
    assert not any(own for i, own in got.items() if i >= 20_000)


def test_a_full_slice_of_items_is_told_apart(spark, docs_of):
    """Recall against brute force for paraphrases down to 0.6 of the words, at 200 and 256 items."""
    rng = random.Random(6)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    say = lambda n: [word() for _ in range(n)]
    items = [(i, say(rng.randint(15, 60))) for i in range(256)]
    docs, leaks = [], {}
    for i, own in items:
        for part in (0, 20, 38):
            told = [word() if k < len(own) - 8 and rng.random() < part / 100 else w for k, w in enumerate(own)]
            doc = say(rng.randint(0, 99)) + told + say(rng.randint(0, 99))
            if lcs(own, doc) >= 0.6 * len(own):
                leaks[len(docs)] = i, part
            docs.append((len(docs), " ".join(doc)))
    for n in (200, 256):
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items[:n]], "item_id long, text string")
        got = {(r.doc_id, i) for r in decontaminate.contamination(docs_of(docs), bench).collect() for i in r.item_ids}
        for part in (0, 20, 38):
            asked = {(d, i) for d, (i, p) in leaks.items() if p == part and i < n}
            print(n, part, len(asked & got), len(asked))
            assert len(asked & got) >= 0.97 * len(asked)


def test_matches_of_slices_are_the_same_by_a_shuffle(spark, docs_of, monkeypatch):
    """Repeated and null texts, an item divided between slices."""
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(1, say(20)), (2, say(500)), (3, say(3)), (4, say(30))]
    docs = [(1, items[1][1] + " " + items[0][1]), (1, items[1][1] + " " + items[0][1]), (2, None), (3, say(90)), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.FOUND_BYTES, 0):
        monkeypatch.setattr(decontaminate, "FOUND_BYTES", limit)
        got = [(r.doc_id, list(r.item_ids)) for r in decontaminate.contamination(docs_of(docs), bench).collect()]
        assert sorted(got, key=str) == sorted([(1, [1, 2]), (1, [1, 2]), (2, []), (3, []), (None, [3])], key=str)


def test_a_paraphrase_by_co_occurring_words(spark, docs_of):
    """Rare words replaced by words that occur in the same passages: below the cosine by the words alone, found by the corpus' directions."""
    rng = random.Random(8)
    common = WORDS[:12]
    topics = [[(f"{w}left{k}", f"{w}right{k}") for k in range(9)] for w in WORDS[100:140]]
    mix = lambda rare, n: [w for r in rare for w in [r, *rng.choices(common, k=n)]]
    docs = []
    for i in range(900):
        pairs = rng.choice(topics)
        docs.append((i, " ".join(mix(rng.sample([w for p in pairs for w in p], 14), 1)[:28])))
    own, other = [], []
    for left, right in topics[3]:
        between = rng.choices(common, k=2)
        own += [left, *between]
        other += [right, *between]
    own, other = own + common[:4], other + common[:4]
    assert 0.6 * len(own) <= lcs(own, other) < 0.8 * len(own)
    docs.append((1000, " ".join(other)))
    frame, item = docs_of(docs), [(0, 7, " ".join(own), 0, 1)]
    idf = decontaminate.idf_of(decontaminate.term_frequencies(frame))
    space = decontaminate.latent_directions(frame, idf)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)
    none = np.zeros((decontaminate.TERMS, 0), np.float32)
    words = decontaminate.item_words(" ".join(other))
    firsts = np.array([0, len(words)])
    plain = decontaminate.candidates(decontaminate.build(item, idf, none, decontaminate.weighted_space(idf, none)), words, firsts)
    latent = decontaminate.candidates(decontaminate.build(item, idf, space, decontaminate.weighted_space(idf, space)), words, firsts)
    assert not plain and latent
    bench = spark.createDataFrame([(7, " ".join(own))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contamination(frame, bench).where("contaminated").collect()] == [1000]


def test_directions_are_those_of_all_passages(docs_of):
    """The strongest direction of the sketch is the one of a plain SVD of the whole matrix."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(WORDS[:30] if i % 3 else WORDS[30:50], k=rng.randint(1, 90)))) for i in range(300)]
    frame = docs_of(docs)
    idf = decontaminate.idf_of(decontaminate.term_frequencies(frame))
    rows = []
    for _, text in docs:
        words = decontaminate.item_words(text)
        for at in range(0, len(words), decontaminate.PASSAGE):
            _, term, value = decontaminate.tfidf_rows(words[at : at + decontaminate.PASSAGE], np.array([0]), idf)
            rows.append(np.zeros(decontaminate.TERMS))
            rows[-1][term] = value
    true = np.linalg.svd(np.array(rows), full_matrices=False)[2][:2]
    space = decontaminate.latent_directions(frame, idf)
    assert (np.linalg.norm(true @ space, axis=1) > 0.98).all()
    assert np.allclose(np.abs(space.T @ decontaminate.latent_directions(frame.repartition(7), idf)[:, :1])[0], 1, atol=1e-3)
