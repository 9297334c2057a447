import math

import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import vector_search as V


def ints(v):
    out = []
    for x in v:
        top, low = float(x).as_integer_ratio()
        out.append(256 * top // low)
    return out


def brute(rows, every, k=5):
    good = [(i, ints(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, q in good:
        if qi % every:
            continue
        best = sorted(((-max(-V.LONG - 1, min(V.LONG, sum(a * b for a, b in zip(q, v)))), i) for i, v in good if i != qi))[:k]
        out |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_SHARD_ROWS", 60)
    monkeypatch.setattr(V, "LEAF_ROWS", 8)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(0, 1, 6) * (rng.random() < 0.9)).round(1).tolist()) for i in range(500)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # one common vector: ties by id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = V.top_k(df, F.col("vec_id") % 10 == 0)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute(exact, 10)


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [3.0], "a"), (3, [1e30, -1e30], "b"), (20, [-0.001, 1e-9], "b"), (4, [nan, 1.0], "b"),
            (5, [inf, 1.0], "b"), (6, None, "b"), (7, [], "c"), (8, [None, 1.0], "c"), (None, [1.0, 1.0], "c"), (9, [1.0, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = V.top_k(df, F.col("vec_id") % 10 == 0)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute([r[:2] for r in rows], 10)


def test_repeated_rows(spark):
    rows = [(10, [1.0]), (10, [1.0]), (1, [2.0]), (1, [2.0])]
    got = sorted(tuple(r) for r in V.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 10).collect())
    assert got == [(10, 1, 1, 256 * 512), (10, 2, 1, 256 * 512)]


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    asks = F.col("vec_id") % 50 == 0
    assert V.top_k(spark.createDataFrame([], schema), asks).collect() == []
    assert V.top_k(spark.createDataFrame([(0, [1.0])], schema), asks).collect() == []
    assert V.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema), asks).collect() == []


def test_the_tree_leaves_boxes_out():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 100, (4000, 2)))
    tree = V.Tree.build(np.arange(4000), rows, 16)
    seen = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree.rows = tree.rows.view(Counting)
    found = tree.search(-1, np.array([3.0, -2.0]), 5, None)
    scores = rows @ np.array([3.0, -2.0])
    assert found == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(4000), -scores))[:5]]
    assert sum(seen) < 1000
