import random

import numpy as np
from helpers import SF, base_counts
from pyspark.sql import functions as F

from embedlens.llm import chars, cotraining, decision_list, language_id, text_stats, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_statistics(docs_of):
    rng = random.Random(2)
    parts = ["a", "b ", "\n", "é", "a b c d e ", "|", " ", "x\n", "\t", "!", "", "<&"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "x\nx\n"), (902, "\n\n")]
    got = {r.doc_id: tuple(r[c] for c in text_stats.BASE) for r in text_stats.with_stats(docs_of(docs), "doc_id").collect()}
    assert got == {i: base_counts(t) for i, t in docs}


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.95)
    rules = decision_list.learn(x, bad, ["n_words", "mean_word", "echo_share"])
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= decision_list.covers(rule, x, ["n_words", "mean_word", "echo_share"])
    assert 1 < len(rules) <= 6 and (hit == bad).mean() > 0.98


def test_rules_on_documents(spark, sf):
    docs, labels = sf("documents"), sf("labels")
    rows = decision_list.apply_rules(docs, decision_list.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    open_ = [r for r in rows if not r.base_failed]
    assert np.mean([r.kept == (r.quality == 1) for r in open_]) > 0.9


def test_cotraining(spark):
    docs, labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    even, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = cotraining.score_documents(docs, cotraining.fit(docs, even), "doc_id").join(rest, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert docs.where(chars.held_out()).count() == len(rows)


def test_language_backs_off(docs_of):
    docs = docs_of([(i, "sprechen machen laufen kaufen") for i in range(0, 40)]).withColumn("lang", F.lit("de"))
    other = docs_of([(i, "doing running walking talking") for i in range(40, 80)]).withColumn("lang", F.lit("en"))
    model = language_id.fit(docs.unionByName(other))
    got = {r.doc_id: r for r in language_id.predict(docs_of([(1, "suchen"), (2, "jumping"), (3, "12 !"), (4, None)]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["de", "en", "und", "und"] and got[3].score == 0


def test_toxicity(spark):
    docs, labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9  # 94 rows, about 300 to learn from
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (5, 0, None), (None, 1, 1), (77, None, 0)], LABELS)
    empty = labels.where("1 = 0")
    for docs, n in ((odd, 11), (none, 0)):
        for given in (labels, empty):
            assert decision_list.apply_rules(docs, decision_list.fit(docs, given)).count() == n
            assert cotraining.score_documents(docs, cotraining.fit(docs, given), "doc_id").count() == n
            assert toxicity.score(docs, toxicity.fit(docs, given)).count() == n
        got = language_id.predict(docs, language_id.fit(docs)).collect()
        assert len(got) == n and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))
    kept = cotraining.filter_documents(odd, 1.0)
    assert kept.columns == odd.columns and kept.count() == 11
