from helpers import SF, near_components, repeated_bytes

import corpus_pipeline


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
    start, good, single, cut, clean, packed = seen
    kept = {r.doc_id for r in good}
    assert sum((q == 1) == (d in kept) for d, q in labels.items()) >= 0.95 * len(labels)
    parts = near_components([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in single} == set(parts.values())
    expected = repeated_bytes([(r.doc_id, r.text) for r in single])
    assert {r.doc_id: r.text for r in cut} == {i: e[4].decode("utf-8", "ignore") for i, e in expected.items()}
    assert all(r.n_chars == len(r.text) for r in cut)
    leaky = {r.doc_id for r in cut if any(t in r.text for t in items)}
    assert not leaky & {r.doc_id for r in clean} and len(cut) - len(clean) <= len(leaky) + 2
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert sum(r.n_words for r in packed) == sum(len(r.text.split()) for r in clean)
