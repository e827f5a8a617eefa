import random

import pytest
from helpers import phrase_rows

from embedlens.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(r) for r in frame.collect())


def texts(seed, n=200):
    """Few words, fixed phrases inside longer ones, pieces of every length, two languages and none."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "É", "f", "g-h", "É\x1f", "über"]
    fixed = [["new", "york"], ["new", "york", "city"], ["to", "be", "or", "not", "to", "be", "that", "is", "all"], ["a"] * 5]
    out = []
    for i in range(n):
        said = []
        for _ in range(rng.randrange(0, 30)):
            said += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(words)]
            said[-1:] = [said[-1] + rng.choice(["", "", "", ".", ",", "\n", " \t", "\x0b"])] if said else []
        out.append((" ".join(said).title() if i % 5 else " ".join(said), ["en", "de", None][i % 3]))
    return out


def frame_of(spark, docs, parts=5):
    return spark.createDataFrame([(t, lang, "clash", "clash") for t, lang in docs], "text string, lang string, a string, word string").repartition(parts)


@pytest.mark.parametrize("slice_bytes,hot", [(8_000_000, 0.002), (50, 0.002), (300, 0.9)])
def test_against_counting_each_phrase(spark, monkeypatch, slice_bytes, hot):
    monkeypatch.setattr(phrases, "HOT_SHARE", hot)
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    docs = texts(4)
    expected = sorted(phrase_rows(docs, least=4))
    assert len(expected) > 100 and any(len(r[2].split()) == 2 for r in expected)
    assert rows_of(phrases.collocations(frame_of(spark, docs), least=4)) == expected
    few = phrases.collocations(frame_of(spark, docs), least=4, first=7)
    assert rows_of(few) == [r for r in expected if r[1] <= 7]


def test_paths_are_longest_phrases_of_one_weight(spark):
    docs = [("to be or not to see that is all", "en")] * 12 + [("what is all that", "en")] * 5 + [("x " * 700 + " ".join(f"w{i}" for i in range(700)), "en")] * 11
    edges, nodes, words = phrases.graph(frame_of(spark, docs))
    name = {r.a: r.word for r in words.collect()}
    got = {(" ".join(name[w] for w in r.words), r.n) for r in phrases.paths(edges, nodes).collect()}
    assert ("to be or not to see that is all", 12) in got
    assert ("x w0 w1 " + " ".join(f"w{i}" for i in range(2, 700)), 11) in {(p.replace("x x", "x"), n) for p, n in got}
    assert rows_of(phrases.collocations(frame_of(spark, docs))) == sorted(phrase_rows(docs))


def test_a_node_of_many_batches(spark):
    """One pair of words with more followers than a batch holds."""
    docs = [(f"un deux m{i % 700}. un deux", "fr") for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = rows_of(phrases.collocations(frame_of(spark, docs, 2), least=4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(phrase_rows(docs, least=4))


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real = phrases._hashes

    def poor(data, starts, ends, text, langs, seed):
        words = real(data, starts, ends, text, langs, seed)
        return words if seed else words % 7 + 100_000

    poor.__module__ = "__main__"  # travels to the workers by value
    monkeypatch.setattr(phrases, "_hashes", poor)
    docs = texts(5, 60)
    assert rows_of(phrases.collocations(frame_of(spark, docs), least=4)) == sorted(phrase_rows(docs, least=4))


def test_exact_beyond_64_bits(spark):
    a = 3_037_000_500
    row = spark.createDataFrame([(a, a, a + 1)], "a long, l long, r long")
    assert row.select(phrases._score(row.a, row.l, row.r)).first()[0] == 10**6 * a * a // (a * (a + 1))


def test_odd_rows(odd, none):
    assert phrases.collocations(none).count() == 0
    docs = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert rows_of(phrases.collocations(odd, least=2)) == sorted(phrase_rows(docs, least=2))
