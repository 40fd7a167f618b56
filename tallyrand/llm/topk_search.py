"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt into shards of a bounded number of rows, a few shards to a task; each shard becomes a KD-tree (median splits on the widest side,
tight bounding boxes), and all queries of its length stream past the task's trees. Every query walks them best box first: a box's
bound is the largest inner product that any of its points could have, and boxes below the query's k-th score so far are skipped. That k-th score is
carried from tree to tree, and a first pass, in which each query meets one task's trees, gives all others a score to start from.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128
FOUND = "query_id long, vec_id long, score long"


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component as long; null for vectors that are null or hold null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * factor).cast("long")))


class Tree:
    """points: int64 (n, d); ids: int64. Rows of a node are order[lo:hi]; within a leaf by id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        points, ids = points[order], ids[order]
        perm = np.arange(len(ids))
        nodes, todo = [], [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = points[perm[lo:hi]]
            low, high = own.min(0), own.max(0)
            me = len(nodes)
            nodes.append([low, high, int(ids[perm[lo:hi]].min()), lo, hi, -1, -1])
            if parent >= 0:
                nodes[parent][5 + side] = me
            if hi - lo > LEAF and len(low) and (high > low).any():
                axis = int(np.argmax(high - low))
                mid = (hi - lo) // 2
                perm[lo:hi] = perm[lo:hi][np.argpartition(own[:, axis], mid)]
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
            else:
                perm[lo:hi] = np.sort(perm[lo:hi])
        self.low, self.high = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
        self.nodes = [x[2:] for x in nodes]
        self.points, self.ids = points[perm], ids[perm]

    def search(self, query: np.ndarray, own_id: int, k: int, best: list[tuple[int, int]]) -> None:
        """Improves best, a min-heap of (score, -id) of up to k rows; it may already hold what other shards have given."""
        bounds = np.maximum(self.low * query, self.high * query).sum(1)
        walk = [(-int(bounds[0]), 0)]
        while walk:
            bound, at = heapq.heappop(walk)
            least, lo, hi, left, right = self.nodes[at]
            if len(best) == k and (-bound, -least) <= best[0]:
                if -bound < best[0][0]:
                    return
                continue
            if left >= 0:
                heapq.heappush(walk, (-int(bounds[left]), left))
                heapq.heappush(walk, (-int(bounds[right]), right))
                continue
            scores = self.points[lo:hi] @ query
            ids = self.ids[lo:hi]
            wanted = ids != own_id  # before the cut, as the query's own rows may be many
            if len(best) == k:
                wanted &= scores >= best[0][0]
            scores, ids = scores[wanted], ids[wanted]
            if len(scores) > k:
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _answers(trees: list[Tree], ids: list[int], points: np.ndarray, floors: list[int | None], k: int) -> pa.RecordBatch:
    """(query_id, vec_id, score) of the best k of all trees for each query; floors: scores that k rows are known to reach."""
    out: list[tuple[int, int, int]] = []
    for i, q, floor in zip(ids, points, floors, strict=True):
        # A row below the floor can't be wanted; stand-ins just below it end as soon as they are all that is left.
        heap = [] if floor is None else [(floor - 1, 0)] * k
        for tree in trees:
            tree.search(q, i, k, heap)
        out += [(i, -neg, s) for s, neg in heap if floor is None or s >= floor]
    columns = zip(*out, strict=True) if out else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _streamed(k: int):
    """Rows (task, dim, is_query, shard, id, v, floor) in the order of the first four: a task's vectors become trees, then its queries stream past them, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        trees: list[Tree] = []
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            task, dim, asks, shard = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            heads = np.flatnonzero(np.append(True, (np.diff(task) != 0) | (np.diff(dim) != 0) | (np.diff(asks) != 0) | (np.diff(shard) != 0)))
            for lo, hi in itertools.pairwise([*heads.tolist(), len(task)]):
                if now != (task[lo], dim[lo]):
                    now, trees, held = (task[lo], dim[lo]), [], []
                ids, points = batch.column(4).slice(lo, hi - lo), _rows(batch.column(5).slice(lo, hi - lo), int(dim[lo]))
                if not asks[lo]:
                    held.append((int(shard[lo]), points, ids.to_numpy()))
                    continue
                for _, parts in itertools.groupby(held, lambda h: h[0]):
                    _, p, i = zip(*parts, strict=True)
                    trees.append(Tree(np.concatenate(p), np.concatenate(i)))
                held = []
                if trees:
                    yield _answers(trees, ids.to_pylist(), points, batch.column(6).slice(lo, hi - lo).to_pylist(), k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, shard_rows: int = 4096, shards_per_task: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products among all other rows.

    vectors and queries: (vec_id long, v array<long>), as scaled() makes them; null ids or vectors take no part, a query meets only
    vectors of its own length and not rows of its own id. Ties go to the smaller vec_id; repeated rows are candidates each; of repeated queries of one id the
    smallest vector counts. With fewer than k rows all are returned. Scores are exact while they fit a long. Empty tables give an empty result.
    A task holds the trees of its own shards and some queries at a time. Every query goes to every task once, after one task has given it a score to start from.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.col("vec_id").alias("id"), "v", F.size("v").alias("dim"))
    asked = queries.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n_tasks = -(-rows.count() // (shard_rows * shards_per_task)) or 1
    dealt = F.pmod(F.xxhash64("id"), F.lit(n_tasks * shards_per_task))
    trees = rows.select(F.floor(dealt / shards_per_task).alias("task"), "dim", F.lit(False).alias("is_query"), dealt.alias("shard"), "id", "v", F.lit(None).cast("long").alias("floor"))

    def answered(by_task: DataFrame) -> DataFrame:
        """by_task: (task, id, v, dim, floor)"""
        both = trees.unionByName(by_task.select("task", "dim", F.lit(True).alias("is_query"), F.lit(0).cast("long").alias("shard"), "id", "v", "floor"))
        placed = both.repartition(n_tasks, "task").sortWithinPartitions("task", "dim", "is_query", "shard")
        return placed.mapInArrow(_streamed(k), FOUND)

    first = answered(asked.withColumns({"task": F.pmod(F.xxhash64("id", F.lit("first")), F.lit(n_tasks)), "floor": F.lit(None).cast("long")}))
    floor = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    found = answered(asked.join(floor, "id", "left").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tasks - 1).cast("long")))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
