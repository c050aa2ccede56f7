"""Approximate nearest neighbours by cosine: NN-descent in Spark joins, and greedy search of the graph.

Rows meet in cells: groups of nodes of a bounded size, dealt by hash.  A round
of NN-descent joins every node's neighbours with each other inside the cell of
that node; a cell gets each vector it needs once, however many of its nodes
need it.  Nothing is gathered on the driver.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.llm.topk import finite
from proseloom.session import cut_lineage

NEIGHBOURS, POOL = 32, 48
ROUNDS, TREES = 7, 2
CELL_ROWS, GROUP_ROWS = 8192, 1024
#: Rows of a random group of one width, and how many of it each node is linked to, so that no node stands alone.
LINK_ROWS, LINKS = 128, 8
#: Least number of cells, so that small tables keep all cores busy.
LEAST_CELLS = 16
#: Rounds end early when the sum of all cosines grows by less than this share.
SETTLED = 1e-3
BEAM, EXPAND, SEARCH_ROUNDS = 160, 40, 12
#: Recall that a search must reach on as many of its queries, drawn by hash.
WANTED, PROBES = 0.9, 200
EDGES = "node long, other long, near float"


def _unit(vectors: pd.Series, kind) -> pd.Series:
    out = []
    for vector in vectors:
        row = np.asarray(vector, dtype=np.float64)
        peak = np.abs(row).max()
        row = row / peak
        out.append((row / np.sqrt(row @ row)).astype(kind).tobytes())
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def _half(vectors: pd.Series) -> pd.Series:
    return _unit(vectors, "<f2")


@F.pandas_udf(T.BinaryType())
def _single(vectors: pd.Series) -> pd.Series:
    return _unit(vectors, "<f4")


def _rows(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=kind).reshape(len(column), -1).astype(np.float32)


def _by_width(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Vectors of any lengths: the bytes of each, its row among those of its length, and one matrix for each length."""
    raw = column.to_pylist()
    sizes, row, parts = np.array([len(x) for x in raw]), np.empty(len(raw), dtype=np.int64), {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        row[at] = np.arange(len(at))
        parts[int(size)] = np.frombuffer(b"".join(raw[i] for i in at), dtype=kind).reshape(len(at), -1).astype(np.float32)
    return sizes, row, parts


def _edges(node, other, near) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "near": pa.array(near, pa.float32())})


def _best(node: np.ndarray, other: np.ndarray, near: np.ndarray, most: int):
    """The ``most`` nearest distinct others of each node, ties to smaller ids."""
    order = np.lexsort((other, -near, node))
    node, other, near = node[order], other[order], near[order]
    # The same pair always has nearly the same value, so equals may lie a few places apart.
    pair = np.lexsort((np.arange(len(node)), other, node))
    again = np.zeros(len(node), dtype=bool)
    same = (node[pair][1:] == node[pair][:-1]) & (other[pair][1:] == other[pair][:-1])
    again[pair[1:]] = same
    node, other, near = node[~again], other[~again], near[~again]
    starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1)) if len(node) else np.empty(0, np.int64)
    turn = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = turn < most
    return node[keep], other[keep], near[keep]


def _all_pairs(most: int):
    """Brute force inside one group of bounded size."""

    def run(group: pa.Table) -> pa.Table:
        ids, x = group["node"].to_numpy(), _rows(group["half"], "<f2")
        take = min(most, len(ids) - 1)
        if take < 1:
            return _edges([], [], [])
        out = []
        for start in range(0, len(ids), 512):
            near = x[start : start + 512] @ x.T
            near[np.arange(len(near)), start + np.arange(len(near))] = -9
            top = np.argpartition(-near, take - 1, axis=1)[:, :take]
            out.append((np.repeat(ids[start : start + 512], take), ids[top].ravel(), np.take_along_axis(near, top, 1).ravel()))
        return _edges(*(np.concatenate(part) for part in zip(*out)))

    return run


def _local_join(most: int, pool: int):
    """Pairs of neighbours of each node that are nearer than what the ends have."""

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        if not edges.num_rows or not vectors.num_rows:
            return _edges([], [], [])
        ids, kth = vectors["id"].to_numpy(), vectors["kth"].to_numpy()
        order = np.argsort(ids)
        sizes, row, parts = _by_width(vectors["half"], "<f2")
        ids, kth, sizes, row = ids[order], kth[order], sizes[order], row[order]
        node, other, _ = _best(*(edges[c].to_numpy() for c in ("node", "other", "near")), pool)
        at = np.searchsorted(ids, other)
        starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
        ends = np.append(starts[1:], len(node))
        found: list[tuple] = []
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        size = 0
        for start, end in zip(starts, ends):
            here = at[start:end]
            x = parts[sizes[here[0]]][row[here]]
            near = x @ x.T
            near[np.arange(len(here)), np.arange(len(here))] = -9
            a, b = np.nonzero(near > kth[here][:, None])
            found.append((here[a], here[b], near[a, b]))
            size += len(a)
            if size > 1_000_000:
                kept = _best(*(np.concatenate(part) for part in zip(kept, *found)), most)
                found, size = [], 0
        kept = _best(*(np.concatenate(part) for part in zip(kept, *found)), most)
        return _edges(ids[kept[0]], ids[kept[1]], kept[2])

    return run


def _merge(most: int):
    def run(edges: pa.Table) -> pa.Table:
        return _edges(*_best(*(edges[c].to_numpy() for c in ("node", "other", "near")), most))

    return run


def _score(candidates: pa.Table, vectors: pa.Table) -> pa.Table:
    """Cosine of each (query, node) pair of a cell, if it beats the query's worst kept one."""
    if not candidates.num_rows or not vectors.num_rows:
        return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
    ids, asks = vectors["id"].to_numpy(), vectors["asks"].to_numpy(zero_copy_only=False)
    sizes, row, parts = _by_width(vectors["single"], "<f4")

    def place(of: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        order = np.flatnonzero(chosen)
        order = order[np.argsort(ids[order])]
        return order[np.searchsorted(ids[order], of)]

    query, node, kth = (candidates[c].to_numpy() for c in ("query", "node", "kth"))
    left, right = place(query, asks), place(node, ~asks)
    near = np.empty(len(query), dtype=np.float32)
    for size, x in parts.items():
        alike = np.flatnonzero(sizes[left] == size)
        for i in range(0, len(alike), 8192):
            some = alike[i : i + 8192]
            near[some] = np.einsum("nd,nd->n", x[row[left[some]]], x[row[right[some]]])
    keep = near > kth
    return pa.table({"query": query[keep], "node": node[keep], "near": near[keep]})


def _advance(beam: int, expand: int):
    """Keep the beam of each query and choose what it expands next."""

    def run(pool: pa.Table) -> pa.Table:
        query, node, near = (pool[c].to_numpy() for c in ("query", "node", "near"))
        done = pool["done"].to_numpy(zero_copy_only=False)
        order = np.lexsort((~done, node, query))
        query, node, near, done = query[order], node[order], near[order], done[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (node[1:] != node[:-1])
        query, node, near, done = query[new], node[new], near[new], done[new]

        def turn(of: np.ndarray) -> np.ndarray:
            starts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1)) if len(of) else np.empty(0, np.int64)
            return np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))

        order = np.lexsort((node, -near, query))
        order = order[turn(query[order]) < beam]
        query, node, near, done = query[order], node[order], near[order], done[order]
        kth = np.full(len(query), -9, dtype=np.float32)
        sizes = np.unique(query, return_counts=True)[1]
        lows = np.where(sizes >= beam, near[np.cumsum(sizes) - 1], np.float32(-9)) if len(sizes) else kth
        kth = np.repeat(lows, sizes).astype(np.float32) if len(sizes) else kth
        open_at = np.flatnonzero(~done)
        go = np.zeros(len(query), dtype=bool)
        go[open_at[turn(query[open_at]) < expand]] = True
        return pa.table({"query": query, "node": node, "near": near, "kth": kth, "done": done | go, "go": go})

    return run


class Graph:
    """Nodes are the distinct vectors, named by their least id; see :func:`build`."""

    def __init__(self, members: DataFrame, nodes: DataFrame, edges: DataFrame, cells: int):
        self.members, self.nodes, self.edges, self.cells = members, nodes, edges, cells

    def cell(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.cells)).cast("int")

    def both_ways(self) -> DataFrame:
        """(node, other, near): each node's neighbours, and as many of the nearest that have it as theirs."""
        return self.edges.unionByName(_nearest_reverse(self.edges, NEIGHBOURS))


def _nearest_reverse(edges: DataFrame, most: int) -> DataFrame:
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "near")
    turn = Window.partitionBy("node").orderBy(F.desc("near"), "other")
    return back.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).drop("turn")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, width) of the rows that take part; equal rows once."""
    rows = vectors.where(finite(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("width"))
    return rows.dropDuplicates(["id", "vector"])


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 6, rounds: int = ROUNDS) -> Graph:
    """A neighbour graph of every row of ``vectors``.

    Rows with equal vectors are one node, whose ``copies`` smallest ids are
    kept as members.  First neighbours come from brute force in groups that lie
    on the same side of random planes, whose number follows the nodes of each
    length; groups too large are dealt into parts.  Random groups of each
    length add a few links, so that no node or small group stands alone.
    Then each round joins neighbours of neighbours, both ways, and every node
    keeps its nearest.  Vectors that are null, all zero, or hold null or
    non-finite components take no part; vectors meet those of their length.
    """
    rows = cut_lineage(usable(vectors, id_col, vector_col))
    same = Window.partitionBy("vector")
    kept = rows.withColumn("turn", F.row_number().over(same.orderBy("id"))).where(F.col("turn") <= copies)
    members = cut_lineage(kept.withColumn("node", F.min("id").over(same)).select("node", "id", "vector", "width"))
    nodes = members.where("id = node").select("node", "width", "vector", _half("vector").alias("half"), _single("vector").alias("single"))
    nodes = cut_lineage(nodes)
    count = nodes.count()
    graph = Graph(members, nodes, None, max(LEAST_CELLS, ceil(count / CELL_ROWS)))
    widths = cut_lineage(nodes.groupBy("width").agg(F.count("*").alias("rows")))
    bits = F.greatest(F.ceil(F.log2(F.col("rows") / GROUP_ROWS)), F.lit(0)).cast("int")
    sized = cut_lineage(nodes.join(widths, "width").select("node", "width", "half", "rows", bits.alias("bits")))
    deal = F.pmod(F.xxhash64("node", F.lit("links")), F.greatest(F.floor(F.col("rows") / LINK_ROWS), F.lit(1)))
    starts = sized.withColumn("deal", deal).groupBy("width", "deal").applyInArrow(_all_pairs(LINKS), EDGES)
    for tree in range(TREES):
        code = _side_code(tree)
        coded = cut_lineage(sized.select("node", "width", "half", code("half", "bits").alias("code")))
        sizes = coded.groupBy("width", "code").agg(F.ceil(F.count("*") / F.lit(2.0 * GROUP_ROWS)).alias("parts"))
        parted = coded.join(cut_lineage(sizes), ["width", "code"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(tree)), F.col("parts")))
        found = parted.groupBy("width", "code", "part").applyInArrow(_all_pairs(NEIGHBOURS // TREES), EDGES)
        starts = starts.unionByName(found)
    graph.edges = _kept(graph, starts)
    total = _total(graph.edges)
    for _ in range(rounds):
        graph.edges = _descend(graph)
        before, total = total, _total(graph.edges)
        if total - before <= SETTLED * abs(total):
            break
    return graph


def _total(edges: DataFrame) -> float:
    return edges.agg(F.sum(F.col("near").cast("double"))).first()[0] or 0.0


def _side_code(tree: int):
    @F.pandas_udf("long")
    def of(vectors: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        planes: dict[int, np.ndarray] = {}
        for raw, most in zip(vectors, bits):
            x = np.frombuffer(raw, dtype="<f2").astype(np.float32)
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng([tree, len(x)]).normal(size=(most, len(x)))
            out.append(int(sum(1 << i for i, side in enumerate(planes[len(x)] @ x) if side > 0)))
        return pd.Series(out, dtype="int64")

    return of


def _kept(graph: Graph, edges: DataFrame) -> DataFrame:
    """The nearest neighbours of each node, merged cell by cell."""
    return cut_lineage(edges.withColumn("cell", graph.cell("node")).groupBy("cell").applyInArrow(_merge(NEIGHBOURS), EDGES))


def _descend(graph: Graph) -> DataFrame:
    """One round: neighbours of neighbours are compared, and each node keeps the nearest."""
    around = cut_lineage(graph.both_ways().withColumn("cell", graph.cell("node")))
    kth = graph.edges.groupBy("node").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("near")).otherwise(F.lit(-9.0)).cast("float").alias("kth"))
    known = cut_lineage(graph.nodes.select("node", "half").join(kth, "node", "left").select(
        F.col("node").alias("id"), "half", F.coalesce("kth", F.lit(-9.0).cast("float")).alias("kth")))
    needed = around.select(F.col("cell").alias("place"), F.col("other").alias("id")).distinct().join(known, "id")
    pairs = around.groupBy("cell").cogroup(needed.groupBy("place")).applyInArrow(_local_join(NEIGHBOURS, POOL), EDGES)
    return _kept(graph, pairs.unionByName(graph.edges))


def search(
    graph: Graph, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM,
    expand: int = EXPAND, rounds: int = SEARCH_ROUNDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of the index, the nearest others found.

    Each query starts at its own node.  Every round expands the nearest nodes
    of its beam that were not expanded yet, until none is left or the rounds
    are over.  The score is the cosine of the original vectors in double
    precision; ties go to the smaller id.
    """
    asked = usable(queries, id_col, vector_col)
    nodes = graph.nodes.select("node", F.col("vector").alias("same"))
    asked = cut_lineage(asked.join(nodes, asked["vector"] == nodes["same"]).select(F.col("id").alias("query_id"), "node", "vector"))
    starts = asked.select(F.col("node").alias("query")).distinct()
    sight = cut_lineage(starts.join(graph.nodes, starts["query"] == graph.nodes["node"]).select("query", "single"))
    around = cut_lineage(graph.both_ways().select("node", "other"))
    first = graph.edges.join(starts, graph.edges["node"] == starts["query"]).select("query", F.col("other").alias("node"), "near")
    blocks = max(1, ceil(sight.count() / 512))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")

    def advance(rows: DataFrame) -> DataFrame:
        schema = "query long, node long, near float, kth float, done boolean, go boolean"
        return cut_lineage(rows.withColumn("block", block).groupBy("block").applyInArrow(_advance(beam, expand), schema))

    pool = advance(first.withColumn("done", F.lit(False)))
    known = graph.nodes.select(graph.cell("node").alias("place"), F.col("node").alias("id"), "single", F.lit(False).alias("asks"))
    for _ in range(rounds):
        front = pool.where("go").select("query", "node", "kth")
        reached = front.join(around, "node").select("query", F.col("other").alias("node"), "kth").where("node <> query").distinct()
        reached = cut_lineage(reached.withColumn("cell", graph.cell("node")))
        if reached.isEmpty():
            break
        eyes = reached.select("cell", "query").distinct().join(sight, "query")
        eyes = eyes.select(F.col("cell").alias("place"), F.col("query").alias("id"), "single", F.lit(True).alias("asks"))
        scored = reached.groupBy("cell").cogroup(known.unionByName(eyes).groupBy("place")).applyInArrow(
            _score, "query long, node long, near float"
        )
        pool = advance(pool.select("query", "node", "near", "done").unionByName(scored.withColumn("done", F.lit(False))))
    nearest = Window.partitionBy("query").orderBy(F.desc("near"), "node")
    few = pool.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= 4 * k + 4).select("query", "node")
    few = cut_lineage(few.unionByName(starts.select("query", F.col("query").alias("node"))))
    left = asked.select("query_id", F.col("node").alias("query"), F.col("vector").alias("a"))
    right = graph.members.select("node", F.col("id").alias("vec_id"), F.col("vector").alias("b"))
    pairs = left.join(few, "query").join(right, "node").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = pairs.select("query_id", "vec_id", cosine(F.col("a"), F.col("b")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(graph: Graph, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, kth, wanted): cosine of the k-th nearest other row by brute force, and how many there are up to k."""
    asked = probes.select("id", _single("vector").alias("single")).collect()
    queries = np.array([r["id"] for r in asked], dtype=np.int64)
    sights = [np.frombuffer(r["single"], dtype="<f4") for r in asked]

    def run(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            sizes, row, parts = _by_width(batch["single"], "<f4")
            out = []
            for size, x in parts.items():
                mine = np.empty(len(x), dtype=np.int64)
                mine[row[sizes == size]] = ids[sizes == size]
                for query, sight in zip(queries, sights):
                    if sight.nbytes == size:
                        near = np.where(mine == query, -9, x @ sight).astype(np.float32)
                        top = np.argpartition(-near, min(k, len(near)) - 1)[:k]
                        top = top[near[top] > -9]
                        out.append((np.full(len(top), query), mine[top], near[top]))
            if out:
                yield from _edges(*(np.concatenate(part) for part in zip(*out))).to_batches()

    pairs = graph.members.select("id", _single("vector").alias("single")).mapInArrow(run, EDGES)
    turn = Window.partitionBy("node").orderBy(F.desc("near"))
    best = pairs.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k)
    return best.groupBy(F.col("node").alias("query_id")).agg(F.min("near").alias("kth"), F.count("*").alias("wanted"))


def search_until(graph: Graph, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, wanted: float = WANTED) -> DataFrame:
    """:func:`search` with a beam widened until its recall on queries drawn by hash, against brute force, is as wanted."""
    drawn = usable(queries, id_col, vector_col).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(PROBES)
    kth, most = cut_lineage(_kth(graph, cut_lineage(drawn), k)), graph.nodes.count()
    total = kth.agg(F.sum("wanted")).first()[0] or 0
    while True:
        found = cut_lineage(search(graph, queries, k, id_col, vector_col, beam, max(1, beam // 4)))
        right = found.join(F.broadcast(kth), "query_id").where(F.col("score") >= F.col("kth") - 1e-5).count()
        if right >= wanted * total or beam >= most:
            return found
        beam *= 2


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda u, v: F.reduce(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = wide(a), wide(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
