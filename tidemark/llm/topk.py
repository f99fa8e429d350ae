"""Exact top-k by inner product: a ball tree in every shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id, so that copies of one vector spread. A shard's tree bounds what a ball
can hold for a query: <q, centre> + |q| radius. Blocks of queries walk it best bound first; a ball whose bound is below a
query's current kth score is left out for that query. A first round gives each query one shard and so a kth score; the
second takes this score to all other shards as the bar to start from. Scores are integers and ties go to the smaller
id, therefore balls that could only tie are still opened.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAF = 128
#: A shard's vectors are in one task's memory; there are as many shards as keep them under this, and some at least to work side by side.
SHARD_ROWS, LEAST_SHARDS = 65_536, 24
_EXACT = float(2**53)


class BallTree:
    """Balls over the rows of ``x``; leaves hold at most LEAF rows. Of more equal vectors, which all score the same, a leaf holds those
    of the smallest ids that can be among the ``k`` best when all rows of any one id are left out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int = 5):
        self.ids, self.x, self.k = ids, x, k
        self.float = x.astype("f8")
        self.nodes: list = []
        self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> int:
        stack, root = [(rows, -1, 0)], len(self.nodes)
        while stack:
            rows, parent, side = stack.pop()
            own = self.float[rows]
            centre = own.mean(0)
            radius = math.sqrt(float(((own - centre) ** 2).sum(1).max()))
            me = len(self.nodes)
            if len(rows) > LEAF and radius < 1e-3 and (self.x[rows] == self.x[rows[0]]).all():
                radius, rows = 0.0, self._first(rows)
            self.nodes.append([centre, radius, None, rows])
            if parent >= 0:
                self.nodes[parent][2][side] = me
            if len(rows) > LEAF and radius > 0:
                along = own @ (own[int(((own - centre) ** 2).sum(1).argmax())] - centre)
                half = len(rows) // 2
                order = np.argpartition(along, half)
                self.nodes[me][2:] = [[-1, -1], None]
                stack += [(rows[order[:half]], me, 0), (rows[order[half:]], me, 1)]
        return root

    def _first(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[np.argsort(self.ids[rows], kind="stable")]
        first = np.searchsorted(self.ids[rows], self.ids[rows], "left")
        most = np.maximum.accumulate(np.arange(len(rows)) - first + 1)  # rows of one id so far
        enough = np.flatnonzero(np.arange(1, len(rows) + 1) - most >= self.k)
        return rows[: enough[0] + 1] if len(enough) else rows

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray):
        """(ids, scores, valid) of shape (queries, k): every row's best but its own id, down to ``bar``."""
        n = len(qid)
        ids = np.full((n, k), np.iinfo("i8").max)
        # float64 holds these integers exactly; beyond, Python's own integers do
        big = float(np.abs(self.float).max(initial=0)) * float(np.abs(q.astype("f8")).max(initial=0)) * max(1, q.shape[1]) >= _EXACT
        low = -np.inf
        scores = np.full((n, k), low)
        if big:
            scores = scores.astype(object)
        qf = q.astype("f8")
        norm = np.sqrt((qf**2).sum(1))
        bar = bar.copy()

        def bound(node, rows):
            centre, radius = self.nodes[node][:2]
            b = qf[rows] @ centre + norm[rows] * radius
            return b + np.abs(b) * 1e-9 + 0.5

        everyone = np.arange(n)
        heap = [(-float(bound(0, everyone).max(initial=low)), 0, everyone)] if n and self.nodes else []
        while heap:
            _, node, rows = heapq.heappop(heap)
            rows = rows[bound(node, rows) >= bar[rows]]
            if not len(rows):
                continue
            _, _, kids, own = self.nodes[node]
            if kids is not None:
                for kid in kids:
                    b = bound(kid, rows)
                    near = b >= bar[rows]
                    if near.any():
                        heapq.heappush(heap, (-float(b[near].max()), kid, rows[near]))
                continue
            s = (q[rows].astype(object) @ self.x[own].astype(object).T) if big else qf[rows] @ self.float[own].T
            there = np.broadcast_to(self.ids[own], s.shape)
            s = np.where(there == qid[rows, None], low, s)
            all_s, all_i = np.concatenate([scores[rows], s], 1), np.concatenate([ids[rows], there], 1)
            if big:
                order = np.array([sorted(range(len(a)), key=lambda j, a=a, b=b: (-a[j], b[j]))[:k] for a, b in zip(all_s, all_i, strict=True)])
            else:
                order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            kth = scores[rows, k - 1].astype("f8")
            bar[rows] = np.maximum(bar[rows], np.nextafter(kth, -np.inf) if big else kth)
        return ids, scores, scores != low


def to_integers(vectors: DataFrame) -> DataFrame:
    """id, floor(256 x) of each component. Null vectors and those with null or non-finite components are left out;
    vectors of other lengths are compared among themselves only."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform("x", lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("long"))
    return vectors.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(finite).select("id", x.alias("x"), F.size("x").alias("dim"))


def top_k(vectors: DataFrame, k: int = 5, *, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best among all rows of other ids.

    Rows that share an id are candidates of their own, but never of a query with this id; queries that share an id answer as one set,
    the k best of their pairs. Rows without a usable vector take no part, vectors of other lengths are compared among themselves, an
    empty table gives an empty one, and other columns are ignored. Components and scores are exact within a long, and held at its ends beyond.
    Runs jobs while it is called: the first round is written.
    """
    spark = vectors.sparkSession
    whole = to_integers(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")))
    whole = common.written(whole, "vectors")
    rows = whole.count()
    shards = max(min(LEAST_SHARDS, -(-rows // 1024)), -(-rows // SHARD_ROWS), 1)
    shard_of = F.pmod(F.xxhash64("id", "x"), F.lit(shards))
    queries = whole.filter(F.col("id") % every == 0)
    base = whole.select(shard_of.cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), "id", "x", F.lit(None).cast("double").alias("bar"))

    def asked(q: DataFrame) -> DataFrame:
        return q.select("shard", "dim", F.lit(1).alias("kind"), "id", "x", "bar")

    home = F.pmod(F.hash("id"), F.lit(shards)).cast("int")
    first = _searched(base, asked(queries.withColumn("shard", home).withColumn("bar", F.lit(None).cast("double"))), k, shards)
    first = common.written(first, "first-round")
    bars = first.groupBy("query_id", "dim").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select(F.col("query_id").alias("id"), "dim", F.when(F.col("n") >= k, F.col("kth").cast("double")).alias("bar"))
    others = queries.join(bars, ["id", "dim"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != home)
    second = _searched(base, asked(others), k, shards)
    best = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(second)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(base: DataFrame, asked: DataFrame, k: int, shards: int) -> DataFrame:
    """Each shard's vectors, then the queries sent to it, pass a task in this order; queries pass in blocks."""
    dealt = base.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
    names = ["query_id", "dim", "vec_id", "score"]

    def matrix(batch):
        col = batch.column(4)
        dim = batch.column(1)[0].as_py()
        return np.asarray(col.flatten(), "i8").reshape(batch.num_rows, dim) if dim else np.zeros((batch.num_rows, 0), "i8")

    def search(batches):
        key, held, tree = None, [], None
        for batch in batches:
            tags = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(1)) + 1).tolist(), len(tags)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                shard, dim, kind = tags[a].tolist()
                if (shard, dim) != key:
                    key, held, tree = (shard, dim), [], None
                part = batch.slice(a, b - a)
                if not kind:
                    held.append((np.asarray(part.column(3), "i8"), matrix(part)))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                for at in range(0, part.num_rows, 512):
                    block = part.slice(at, 512)
                    qid = np.asarray(block.column(3), "i8")
                    bar = np.asarray(block.column(5).fill_null(-math.inf), "f8")
                    bar = np.where(np.abs(bar) >= _EXACT, np.nextafter(bar, -np.inf), bar)  # a long may have been rounded up
                    ids, scores, there = tree.search(qid, matrix(block), k, bar)
                    rows, ranks = np.nonzero(there)
                    kept = scores[rows, ranks] >= bar[rows]
                    rows, ranks = rows[kept], ranks[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[rows], pa.int64()), pa.array(np.full(len(rows), dim), pa.int32()), pa.array(ids[rows, ranks], pa.int64()), pa.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores[rows, ranks]], pa.int64())], names)

    return dealt.mapInArrow(search, "query_id long, dim int, vec_id long, score long")


def op6_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
