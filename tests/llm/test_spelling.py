import random

import pytest
from helpers import SF, one_edit, spelling_rows, spelling_words

from embedlens.llm import spelling


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def variants(seed, n=120):
    """Texts of a few words, their misspellings, and misspellings of these, with very different frequencies."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 12))) for _ in range(12)]
    words = []
    for i, w in enumerate(base):
        words += [w] * (400 if i % 3 == 0 else 12)
        for _ in range(8):
            v = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(v))
                v[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "c", "x"])
            words += ["".join(v)] * rng.choice([1, 2, 3, 40])
    words += ["chainword"] * 900 + ["chaimword"] * 60 + ["chaimwort"] * 4
    rng.shuffle(words)
    return [(i, " ".join(words[i::n]).title() + (" 12,x" if i % 2 else "")) for i in range(n)]


@pytest.mark.parametrize("alphabet,length", [("ab", 7), ("aé", 4), ("abc", 5)])
def test_composition_against_all_pairs(alphabet, length):
    rng = random.Random(length)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(0, length + 1))) for _ in range(90)})
    one = spelling.Acceptor(words)
    got = [tuple(sorted(p)) for p in spelling.Composition(one, one).pairs()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    left, right = words[::2], words[1::2]
    got = list(spelling.Composition(spelling.Acceptor(left), spelling.Acceptor(right)).pairs())
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in left for b in right if one_edit(a, b)}


def test_acceptor_is_minimal():
    made = spelling.Acceptor(sorted(a + b + "ing" for a in "abcd" for b in "xyz"))
    states, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in states:
            states.add(s)
            todo += made.arcs[s].values()
    assert len(states) == 6


def test_long_words_do_not_recurse():
    long = "ab" * 40_000
    one = spelling.Acceptor(sorted([long, long + "a", "b" + long]))
    assert sum(1 for _ in spelling.Composition(one, one).pairs()) == 2
    run = "a" * 30_000
    one = spelling.Acceptor([run, run + "a"])
    assert sum(1 for _ in spelling.Composition(one, one).pairs()) == 1


def test_against_all_pairs(docs_of):
    docs = variants(3)
    expected = spelling_rows(docs)
    assert any(f and expected[f][0] for f, *_ in expected.values())  # forms of forms
    for block in (20_000, 3):  # 3: states are cut into blocks
        assert rows_of(spelling.spelling_variants(docs_of(docs), block=block)) == expected


def test_given_documents(sf):
    docs = [(r.doc_id, r.text) for r in sf("documents").select("doc_id", "text").collect()]
    words = spelling_words(docs)
    got = rows_of(spelling.spelling_variants(sf("documents")))
    assert {w: v[2] for w, v in got.items()} == words
    some = sorted(words)[:: max(1, len(words) // 60)]
    for w in some:
        assert got[w][3] == sum(one_edit(w, v) for v in words)


def test_odd_rows(odd, none):
    from pyspark.sql import functions as F

    assert spelling.spelling_variants(none).count() == 0
    assert spelling.spelling_variants(odd).count() == 0
    many = odd.withColumn("text", F.when(F.col("doc_id") != 1, F.lit("Straßenbahn straßenbahn STRAßENBAHN")))
    docs = [(r.doc_id, r.text) for r in many.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_variants(many.withColumn("word", F.lit("clash")))) == spelling_rows(docs)
