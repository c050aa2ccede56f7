"""Exact top-k inner products by one KD-tree per shard.

Candidates are hashed into shards of a bounded size.  A query first searches
its home shard; its k-th score there travels with it to all other shards, where
best-first traversal drops every box whose bound lies below it.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.session import cut_lineage

LEAF_ROWS = 128
#: Below this magnitude a double holds every sum of products exactly.
EXACT = 2.0**53
RESULT = "key long, query_id long, vec_id long, score long"


class KDTree:
    """Median splits of integer vectors, with the tight bounding box of every node."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.children = [], [], [], []
        self._points, self._leaf = points, leaf_rows
        self._grow(0, len(points))
        self.points = points[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, start: int, end: int) -> int:
        part = self._points[self.order[start:end]]
        low, high = part.min(axis=0), part.max(axis=0)
        node = len(self.span)
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, end))
        self.children.append(None)
        if end - start > self._leaf and (high > low).any():
            middle = (end - start) // 2
            turn = np.argpartition(part[:, int(np.argmax(high - low))], middle)
            self.order[start:end] = self.order[start:end][turn]
            self.children[node] = (self._grow(start, start + middle), self._grow(start + middle, end))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product any point of a node can have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _search(tree: KDTree, ids: np.ndarray, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor):
    """The k best (score, id) of a tree that reach ``floor``, ties to smaller ids."""
    scores, found = np.empty(0, query.dtype), np.empty(0, np.int64)
    queue = [(-bounds[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        if floor is not None and -bound < floor:
            break
        if tree.children[node]:
            for child in tree.children[node]:
                if floor is None or bounds[child] >= floor:
                    heapq.heappush(queue, (-bounds[child], child))
            continue
        start, end = tree.span[node]
        got, names = tree.points[start:end] @ query, ids[start:end]
        fits = names != own
        if floor is not None:
            fits &= got >= floor
        if fits.any():
            scores, found = np.concatenate([scores, got[fits]]), np.concatenate([found, names[fits]])
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
            if len(scores) == k:
                floor = scores[-1]
    return scores, found


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["vector"].combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.reshape(len(column), -1 if len(column) and len(rows) else 0)


def _shard_search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"key": [], "query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and queries.num_rows:
            points, asked = _matrix(candidates), _matrix(queries)
            peak = float(np.abs(points).max(initial=0)) * float(np.abs(asked).max(initial=0)) * points.shape[1]
            if peak < EXACT:
                points, asked = points.astype(np.float64), asked.astype(np.float64)
            ids = candidates["vec_id"].to_numpy()
            tree = KDTree(points)
            ids = ids[tree.order]
            own, key, floors = (queries[c].to_pylist() for c in ("query_id", "key", "floor"))
            for start in range(0, len(asked), 512):
                limit = tree.bounds(asked[start : start + 512])
                for i, bounds in enumerate(limit, start):
                    scores, found = _search(tree, ids, asked[i], own[i], bounds, k, floors[i])
                    out["key"] += [key[i]] * len(found)
                    out["query_id"] += [own[i]] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += [int(s) for s in scores]
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return run


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold only finite components."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(inside, F.lit(False))


def _best(found: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def exact_top_k(
    vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, shard_rows: int = 8192, query_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where ``asked`` holds.

    Components become ``floor(scale * x)``; the score is their integer inner
    product and ties go to the smaller id.  A query never meets rows of its own
    id; vectors meet only vectors of their length.  Vectors that are null or
    hold null or non-finite components, and rows without an id, take no part.
    Repeated rows are candidates each, and one query.  An empty table gives an
    empty result.  Queries are met in blocks of ``query_rows``, so a task holds
    one shard and one block.
    """
    quantised = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised.alias("vector"), asked.alias("asked")
    )
    rows = cut_lineage(rows.withColumn("width", F.size("vector")))
    counts = rows.agg(F.count("*"), F.count_if("asked")).first()
    shards, blocks = max(1, ceil(counts[0] / shard_rows)), max(1, ceil(counts[1] / query_rows))
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    queries = rows.where("asked").select(
        F.col("vec_id").alias("query_id"), "vector", "width", F.xxhash64("vector").alias("key"), shard.alias("home")
    ).dropDuplicates(["query_id", "key"])
    queries = cut_lineage(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    points = rows.select("vec_id", "vector", "width", shard.alias("shard"))
    points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asking: DataFrame) -> DataFrame:
        keys = ["width", "shard", "block"]
        return points.groupBy(keys).cogroup(asking.groupBy(keys)).applyInArrow(_shard_search(k), RESULT)

    at_home = cut_lineage(meet(queries.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("long"))))
    kth = at_home.groupBy("query_id", "key").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bound = kth.select("query_id", "key", F.when(F.col("n") >= k, F.col("low")).alias("floor"))
    away = queries.join(bound, ["query_id", "key"], "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    found = at_home.unionByName(meet(away.where("shard <> home")))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
