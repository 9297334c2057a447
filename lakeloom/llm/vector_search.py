"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are compared as integers, ``floor(scale * x)`` of each component, so scores
are exact. The candidates are dealt into shards by a hash of their id: at least
``LEAST_SHARDS`` where there are rows enough, of at most about ``SHARD_ROWS``. A shard's KD-tree splits at the median of the widest dimension down to
leaves of ``LEAF_ROWS`` rows, and every node keeps its tight bounding box. A query
walks the tree best-first: a node's bound is the largest inner product that any point
of its box could have, and nodes whose bound is below the query's kth score so far
(or equal to it, if the node holds no smaller id) are left out. The kth score is
carried from leaf to leaf, and from a first shard, searched alone, into all others.

Shards and blocks of ``BLOCK_QUERIES`` queries meet in an equi-join on both numbers,
each pair in a task that holds one shard's tree and one block. The best k of each shard are merged by a window over the
query.

Defined cases: vectors that are null or empty, hold null or non-finite components, or
have a null id take no part. Vectors of different lengths are compared over the
shorter one's components. A query isn't compared with rows of its own id; rows that
repeat an id are candidates each, and a query that is repeated with the same vector is
asked once. Ties go to the smaller id. Fewer candidates than k give fewer rows; an
empty table gives none. Scores beyond 64 bits stop at the type's limits. Other columns
are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.llm.common import partitions_for, prepare_workers, stored

SCALE = 256
TOP = 5
SHARD_ROWS = 65536
LEAST_SHARDS = 16
LEAST_SHARD_ROWS = 1024
LEAF_ROWS = 256
BLOCK_QUERIES = 4096
MOST_TASKS = 100_000
#: Integers up to here have exact double sums.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def quantised(rows: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of the rows, padded with zeros, as exact doubles, or as
    Python integers if doubles can't hold the products."""
    width = max(map(len, rows))
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        m[i, :len(r)] = r
    with np.errstate(over="ignore"):
        m = np.floor(scale * m)
    if np.isfinite(m).all() and (np.abs(m).max(initial=0) ** 2) * width < EXACT:
        return m
    exact = np.zeros(m.shape, object)
    for i, r in enumerate(rows):
        for j, x in enumerate(r):
            top, low = float(x).as_integer_ratio()
            exact[i, j] = scale * top // low
    return exact


def _integers(m: np.ndarray) -> np.ndarray:
    return m if m.dtype == object else np.frompyfunc(int, 1, 1)(m)


@dataclass
class Tree:
    """Nodes in arrays: children (-1 in a leaf), row range, box, smallest id."""

    ids: np.ndarray
    rows: np.ndarray
    left: list[int]
    right: list[int]
    first: list[int]
    last: list[int]
    low: np.ndarray
    high: np.ndarray
    least_id: list[int]

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        order = np.lexsort((ids,))
        ids, rows = ids[order], rows[order]
        place = np.arange(len(ids))
        t = Tree(ids, rows, [], [], [], [], None, None, [])  # type: ignore[arg-type]
        low, high, stack = [], [], [(0, len(ids), -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            node, own = len(t.left), rows[place[a:b]]
            lo, hi = own.min(0), own.max(0)
            for held, x in ((t.left, -1), (t.right, -1), (t.first, a), (t.last, b), (low, lo), (high, hi), (t.least_id, int(ids[place[a:b]].min()))):
                held.append(x)
            if parent >= 0:
                (t.right if is_right else t.left)[parent] = node
            if b - a > leaf_rows and (hi > lo).any():
                at = own[:, int((hi - lo).argmax())]
                split = np.argsort(at, kind="stable")
                place[a:b] = place[a:b][split]
                middle = (a + b) // 2
                stack += [(middle, b, node, True), (a, middle, node, False)]
        t.ids, t.rows, t.low, t.high = ids[place], rows[place], np.array(low), np.array(high)
        return t

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """Up to k (score, id), best first; ``floor``: a score that k rows of other
        shards are known to reach."""
        d = min(self.low.shape[1], len(q))
        q, rows, high, low = q[:d], self.rows, self.high, self.low
        if object in (q.dtype, rows.dtype):
            q, rows, high, low = map(_integers, (q, rows, high, low))
        bound = np.where(q > 0, high[:, :d] * q, low[:, :d] * q).sum(1)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its first is the kth
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            if floor is not None and -top < floor:
                break
            if len(best) == k and -top < best[0][0]:
                break
            if len(best) == k and -top == best[0][0] and self.least_id[node] > -best[0][1]:
                continue
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (-bound[child], child))
                continue
            a, b = self.first[node], self.last[node]
            scores, ids = rows[a:b, :d] @ q, self.ids[a:b]
            least = best[0][0] if len(best) == k else floor
            at = np.flatnonzero(ids != query_id) if least is None else np.flatnonzero((scores >= least) & (ids != query_id))
            if len(at) > k:
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            for s, i in zip(scores[at].tolist(), ids[at].tolist()):
                entry = (int(s), -i)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _found(trees: DataFrame, blocks: DataFrame, k: int, scale: int, pairs: int) -> DataFrame:
    """The best k of each tree for each query of the block it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, asked in zip(*batch.columns):
                tree, out, queries = pickle.loads(blob.as_py()), [], asked.as_py()
                vectors = quantised([q["vector"] for q in queries], scale)
                for q, v in zip(queries, vectors):
                    for s, i in tree.search(q["id"], v, k, q["floor"]):
                        out.append((q["id"], q["mark"], i, max(-LONG - 1, min(LONG, s))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["query_id", "mark", "vec_id", "score"])

    met = trees.join(blocks, ["shard", "block"]).repartition(max(1, min(pairs, MOST_TASKS)), "shard", "block")
    return met.select("tree", "queries").mapInArrow(run, "query_id long, mark long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of
    ``vectors`` (vec_id, embedding); ``is_query`` marks the rows that ask."""
    prepare_workers(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks")).where(
        F.col("id").isNotNull() & usable(F.col("vector")))
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    per_shard = max(LEAST_SHARD_ROWS, min(SHARD_ROWS, count["n"] // LEAST_SHARDS))
    shards, blocks = partitions_for(count["n"], per_shard, 1), partitions_for(count["q"], BLOCK_QUERIES, 1)

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            found += batch.column(1).to_pylist()
        tree = Tree.build(np.array(ids, np.int64), quantised(found, scale))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], names=["shard", "tree"])

    dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("long").alias("shard"))
    trees = stored(dealt.groupBy("shard").applyInArrow(build, "shard long, tree binary"), "kd-trees")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    trees = trees.select("shard", "tree", numbers(blocks).alias("block"))
    asked = rows.where("asks").select("id", "vector", F.xxhash64("vector").alias("mark")).dropDuplicates(["id", "mark"])
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")), "kd-queries")

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block").agg(F.collect_list(F.struct("id", "mark", "vector", "floor")).alias("queries"))

    ahead = in_blocks(asked.withColumn("floor", F.lit(None).cast("long"))).withColumn("shard", F.lit(0).cast("long"))
    found = stored(_found(trees.where("shard = 0"), ahead, k, scale, blocks), "kd-first")
    if shards > 1:
        floors = found.groupBy(F.col("query_id").alias("id"), "mark").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(
            F.col("n") >= k).select("id", "mark", "floor")
        others = in_blocks(asked.join(floors, ["id", "mark"], "left")).withColumn("shard", numbers(shards)).where("shard <> 0")
        found = found.union(_found(trees.where("shard <> 0"), others, k, scale, (shards - 1) * blocks))
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
