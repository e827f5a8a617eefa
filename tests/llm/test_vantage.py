import numpy as np
import pytest
from helpers import nearest_rows
from pyspark.sql import functions as F

from embedlens.llm import vantage

SCHEMA = "vec_id long, embedding array<double>, shard string, width string, limit string, asked string"


def frame_of(spark, rows, parts=3):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash", "clash", "clash") for i, v in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def lists(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(seed, n=400, d=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (12, d))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(0, 0.3, d)).round(1).tolist()) for i in range(n)]
    rows += [(n + i, [1.0] * d) for i in range(60)]  # copies of one vector
    return rows


@pytest.mark.parametrize("shard_rows,leaf", [(10_000, 128), (60, 4)])
def test_factor_one_equals_comparing_all(spark, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(vantage, "LEAST_SHARD", shard_rows)
    rows = clustered(1)
    got = lists(vantage.nearest(frame_of(spark, rows), F.col("vec_id") % 20 == 0, 10, shard_rows=shard_rows, leaf=leaf))
    expected = nearest_rows(rows, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], expected[q]))


def test_tree_prunes_and_a_smaller_factor_prunes_more():
    rows = clustered(2, 4000)
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    exact, seen, recall = None, [], []
    for factor in (1.0, 0.5, 0.1):
        shard = vantage.Shard(ids, points, leaf=32)
        q, found, _ = shard.search(ids[:100], points[:100], 10, np.full(100, np.inf), factor)
        got = set(zip(q.tolist(), found.tolist()))
        exact = exact or got
        seen.append(shard.seen)
        recall.append(len(got & exact) / len(exact))
    assert seen[0] < 0.3 * 100 * len(points)
    assert seen[0] > seen[1] > seen[2] and recall[0] == 1.0 and recall[1] > 0.9


def test_recall_on_given_embeddings(sf):
    """The registered factor is one: nothing is lost."""
    rows = [(r.vec_id, r.embedding) for r in sf("embeddings").collect()]
    got = lists(vantage.nearest(sf("embeddings"), F.col("vec_id") % 100 == 0))
    expected = nearest_rows(rows, lambda i: i % 100 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [9.0, 9.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.5]), (20, [9.0, 8.0]),
        (11, [1e200, 1.0]), (-10, [-1.0, -0.0]),
    ]
    got = lists(vantage.nearest(frame_of(spark, rows), F.col("vec_id") % 10 == 0, 3))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [7, 8, 20], 10: [9], 20: [0, 7, 8], -10: [0, 7, 8]}
    assert vantage.nearest(frame_of(spark, rows).where("1 = 0"), F.col("vec_id") % 10 == 0).count() == 0
    assert vantage.nearest(frame_of(spark, [(0, [1.0])]), F.col("vec_id") % 10 == 0).count() == 0
