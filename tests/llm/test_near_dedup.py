import random

import numpy as np
from helpers import near_components, shingle_set

from embedlens.llm import kernels, near_dedup


def copies(seed, n=70):
    """Texts, exact copies and copies with a few words changed, around the limit."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 4, 5, 40, 90]))] for _ in range(n // 4)]
    while len(texts) < n:
        own = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            if own:
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(own)
    return [(i * 7 % 1000, rng.choice([" ", "\n", "  "]).join(t).title()) for i, t in enumerate(texts)]


def test_shingles_match_sets():
    import pyarrow as pa

    texts = ["", None, "a", "a b c d", "a b c d e", "A b  c\nd e f", "é b c d e f g a b c d e"]
    got = [len(s) for _, part in kernels.shingle_sets(pa.array(texts)) for s in part]
    assert got == [len(shingle_set(t)) for t in texts]


def test_equal_sets_have_equal_signatures_and_keys_meet_within_the_distance():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
    for _ in range(200):
        other = one.copy()
        place = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        other[place] += 1
        a, b = near_dedup.chunk_keys(np.stack([one, other]))
        assert set(a.tolist()) & set(b.tolist())


def test_against_all_pairs(docs_of):
    docs = copies(1)
    for block in (4096, 5):  # 5: groups are cut into blocks
        rows = near_dedup.near_duplicates(docs_of(docs), block=block).collect()
        expected = near_components(docs)
        assert {r.doc_id: r.component_id for r in rows} == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
        assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingle_set(t)) for i, t in docs}
    assert len(set(expected.values())) < len(expected) - 5


def test_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert by[5] == [(5, True)] * 2 and by[6] == [(5, False)]
    assert by[None] == [(None, True)] * 2
    assert by[1] == [(1, True)] and by[2] == [(2, True)] and by[3] == [(3, True)]
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.remove_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]


def test_a_repeated_row_is_confirmed_once(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([(1, text)] * 400 + [(2, text + " x")])
    keys = docs.select("doc_id", near_dedup.F.xxhash64("text").alias("text_hash")).distinct()
    groups = keys.select(near_dedup.F.col("doc_id").alias("node"), near_dedup.F.lit(1).alias("group"), near_dedup.F.lit(b"").alias("signature"), "doc_id", "text_hash")
    assert near_dedup._texts(docs, groups).count() == 2
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == 401 and all(r.component_id == 1 for r in rows)
