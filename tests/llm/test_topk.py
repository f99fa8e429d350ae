import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, np.floor(256 * np.array(v, "f8")).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-int((q * v).sum()), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -a) for r, (a, j) in enumerate(s[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit("clash"), "score": F.lit(0)})


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 4 == 0)).astype("f4").tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(400)]  # copies: ties
    rows += [(5000, None), (5050, [float("nan")] * 8), (5051, [1.0, None] + [0.0] * 6), (5052, [float("inf")] * 8), (5100, [1.0, 2.0]), (5101, [3.0, 1.0]), (5150, []), (None, [0.0] * 8)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, -1.0]), (1, [2.0, 0.5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame(spark, rows)).collect()) == brute(rows)
    assert topk.top_k(frame(spark, rows).limit(0)).count() == 0


def test_numbers_beyond_doubles():
    ids, x = np.arange(300), np.full((300, 2), 2**40) + np.arange(300)[:, None]
    got, scores, there = topk.BallTree(ids, x).search(np.array([1000]), x[:1] + 1, 3, np.array([-np.inf]))
    assert there.all() and got[0].tolist() == [299, 298, 297] and scores[0, 0] == 2 * (2**40 + 1) * (2**40 + 299)


def test_leaves_of_equal_vectors():
    rng = np.random.default_rng(5)
    ids = rng.permutation(np.concatenate([np.arange(5_000), np.zeros(300, "i8"), np.full(9, 3)]))
    tree = topk.BallTree(ids, np.full((len(ids), 4), 7), 5)
    assert len(tree.nodes) == 1 and len(tree.nodes[0][3]) < 330
    for own in (0, 3, 9_999):
        got, scores, there = tree.search(np.array([own]), np.full((1, 4), 2), 5, np.array([-np.inf]))
        assert there.all() and got[0].tolist() == sorted(i for i in ids if i != own)[:5] and (scores == 56).all()


def test_queries_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0])]
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(frame(spark, rows), 3).collect())
    assert got == [(1, 1, 3 * 65536), (2, 2, 2 * 65536), (3, 1, 65536)]


def test_ties_beyond_doubles(spark):
    top = float(2**20)
    rows = [(0, [top, 1.0])] + [(i, [top * 8, 0.0]) for i in range(1, 2000)] + [(2000, [top * 8, 1 / 256])]
    got = sorted((r["rank"], r.vec_id) for r in topk.top_k(frame(spark, rows), every=10_000).collect())
    assert got == [(1, 2000), (2, 1), (3, 2), (4, 3), (5, 4)]
