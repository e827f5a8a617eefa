import random

import numpy as np
from helpers import repeated_bytes

from embedlens.llm import substring_dedup, suffix_sort


def test_orders_suffixes():
    rng = random.Random(1)
    for _ in range(150):
        alphabet = b"abz"[: rng.randint(1, 3)]
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 80))]
        if len(texts) > 3:
            texts[1], texts[2] = texts[0][:40], texts[0]
        rows, lens = np.zeros((len(texts), 60), np.uint8), np.array([len(t) for t in texts])
        for i, t in enumerate(texts):
            rows[i, : len(t)] = np.frombuffer(t, np.uint8)
        order = suffix_sort.deep_shallow_order(rows, lens)
        assert [texts[i] for i in order] == sorted(texts)
        assert [texts[i] for i in suffix_sort.blind_trie_order(texts)] == sorted(texts)
        lcp = suffix_sort.neighbour_lcp(rows, lens, order)
        for k in range(1, len(texts)):
            a, b = texts[order[k - 1]], texts[order[k]]
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == same


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(400)) for _ in range(6)]
    docs = []
    for i in range(50):
        text = "".join(
            rng.choice(base)[rng.randint(0, 200) : rng.randint(150, 400)] if rng.random() < 0.6 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))
            for _ in range(rng.randint(0, 6))
        )
        docs.append((i * 37 % 1000, "und " * rng.randint(1, 200) if rng.random() < 0.1 else text))
    return docs


def test_against_all_windows(docs_of, monkeypatch):
    docs = passages(3)
    expected = repeated_bytes(docs)
    rows = substring_dedup.remove_repeats(docs_of(docs, 5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {i: e[:4] for i, e in expected.items()}
    assert sum(e[1] > 0 for e in expected.values()) > 20


def test_hot_anchors_are_not_brought_together(docs_of, monkeypatch):
    """A passage in all documents with other neighbours in each: its anchors go by windows, with the same result."""
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    hot, split = [], substring_dedup.resolve_hot
    monkeypatch.setattr(substring_dedup, "resolve_hot", lambda runs, buckets: hot.append(runs.count()) or split(runs, buckets))
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = say(300)
    docs = [(i, say(rng.randint(0, 150)) + shared + say(rng.randint(0, 150))) for i in range(60)] + [(1000 + i, t) for i, t in passages(3)]
    expected = repeated_bytes(docs)
    rows = substring_dedup.remove_repeats(docs_of(docs, 5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {i: e[:4] for i, e in expected.items()}
    assert hot[0] >= 60


def test_odd_rows(odd, none):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == 11 and substring_dedup.remove_repeats(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == 0 and by[1].kept == "" and by[2].n_removed == 0
    assert by[4].n_removed > 100_000  # the text has a period of 997 words
    left = substring_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.where("text IS NULL").count() == 2


def test_many_texts_under_null_ids(spark):
    """Texts of null ids with equal 32-bit hashes and different lengths, among hundreds of thousands: each is a document of its own."""
    from pyspark.sql import functions as F

    text = F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(2)), F.repeat(F.lit("z"), F.pmod("id", F.lit(50)).cast("int")))
    rows = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    twins = rows.groupBy(F.hash("text").alias("h")).agg(F.collect_set("text").alias("texts")).where(F.size("texts") > 1).collect()
    assert any(len({len(t) for t in r.texts}) > 1 for r in twins)
    got = substring_dedup.remove_repeats(rows)
    assert got.where("n_removed > 0").count() == 0
    # copies of the twins under an id of their own are cut, whichever text came first
    some = [t for r in twins for t in r.texts]
    more = rows.unionByName(spark.createDataFrame([(7, t) for t in some], "doc_id long, text string"))
    cut = {(r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(more).where("doc_id = 7").select("n_bytes", "n_removed").collect()}
    assert cut and all(a == b for a, b in cut)
