"""Exact top-k inner-product search with dual cover trees.

Rows and queries are dealt into blocks by a hash; the cover tree of each block is built once and written. Each pair of a
query block and a row block is searched by itself and the best k of each query are merged. The children of a node are a
net of its points, chosen farthest first: they are apart from each other by more than the radius within which they cover
the node's points, the first is the node's own centre, and each point belongs to the nearest. A pair of nodes is pruned
when no score between their points, <c, d> + r|d| + s|c| + rs for centres c, d and covering radii r, s, can reach the
worst k-th score of the query node. Leaves are scored by matrix products of whole numbers.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, ship

ROW_BLOCK = 16_384
QUERY_BLOCK = 1024
#: Points of a leaf at most, and children of a node at most.
LEAF = 256
NET = 12


class Node:
    __slots__ = ("centre", "length", "radius", "children", "points", "worst")

    def __init__(self, x, points, centre, children=()):
        self.points, self.centre, self.children = points, x[centre], list(children)
        self.length = float(np.sqrt(self.centre @ self.centre))
        d = x[points] - self.centre
        self.radius = float(np.sqrt((d * d).sum(1).max(initial=0)))
        self.worst = -np.inf


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A node holds all its points; a node of up to LEAF points, or whose points are all equal, is a leaf."""
    points = np.arange(len(x)) if points is None else points
    centre = _middle(x, points) if centre is None else centre
    if len(points) <= LEAF:
        return Node(x, points, centre)
    own = x[points]
    d = own - x[centre]
    gap, nearest, centres = (d * d).sum(1), np.zeros(len(points), int), [centre]
    while len(centres) < NET and gap.max() > 0:
        far = int(points[gap.argmax()])
        d = own - x[far]
        new = (d * d).sum(1)
        nearest[new < gap] = len(centres)
        gap = np.minimum(gap, new)
        centres.append(far)
    if len(centres) == 1:
        return Node(x, points, centre)
    return Node(x, points, centre, [cover_tree(x, points[nearest == i], c) for i, c in enumerate(centres)])


def _middle(x: np.ndarray, points: np.ndarray) -> int:
    """The point nearest to the mean."""
    d = x[points] - x[points].mean(0)
    return int(points[(d * d).sum(1).argmin()])


class Search:
    """Best k scores of each query against rows, ties to smaller ids; a query's own id is left out."""

    def __init__(self, q, q_ids, x, x_ids, k: int, q_tree: Node | None = None, x_tree: Node | None = None):
        self.q, self.q_ids, self.x, self.x_ids, self.k = q, q_ids, x, x_ids, k
        self.scores = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.visits = 0
        if len(q) and len(x):
            self.walk(q_tree or cover_tree(q), [x_tree or cover_tree(x)])

    def bounds(self, a: Node, rows: list[Node]) -> np.ndarray:
        c = np.stack([r.centre for r in rows])
        length, radius = np.array([r.length for r in rows]), np.array([r.radius for r in rows])
        out = c @ a.centre + a.radius * length + radius * a.length + a.radius * radius
        return out + 1e-9 * (1 + np.abs(out))

    def walk(self, a: Node, rows: list[Node]) -> None:
        a.worst = self.scores[a.points, -1].min()
        b = self.bounds(a, rows)
        if a.children:
            open_ = [c for r, v in zip(rows, b, strict=True) if v >= a.worst for c in (r.children or [r])]
            for child in a.children:
                if open_:
                    self.walk(child, open_)
            return
        heap = sorted(zip(b.tolist(), rows, strict=True), key=lambda p: p[0])
        while heap:
            bound, r = heap.pop()
            if bound < a.worst:
                break
            if r.children:
                heap += zip(self.bounds(a, r.children).tolist(), r.children, strict=True)
                heap.sort(key=lambda p: p[0])
            else:
                self.score(a, r)

    def score(self, a: Node, r: Node) -> None:
        self.visits += 1
        s = self.q[a.points] @ self.x[r.points].T
        ids = self.x_ids[r.points]
        s[self.q_ids[a.points][:, None] == ids] = -np.inf
        if not (s.max(1) >= self.scores[a.points, -1]).any():
            return
        s = np.concatenate([self.scores[a.points], s], 1)
        ids = np.concatenate([self.found[a.points], np.broadcast_to(ids, (len(a.points), len(ids)))], 1)
        order = np.lexsort((ids, -s), axis=1)[:, : self.k]
        self.scores[a.points], self.found[a.points] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
        a.worst = self.scores[a.points, -1].min()


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _distinct(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the first of rows that repeat both id and vector."""
    order = np.lexsort((*x.T, ids))
    same = (ids[order][1:] == ids[order][:-1]) & (x[order][1:] == x[order][:-1]).all(1)
    return np.sort(order[np.concatenate([[True], ~same])]) if len(ids) else order


def _plant(table: pa.Table, width: int) -> pa.Table:
    """A block's ids, vectors and cover tree as one row."""
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    x = _matrix(table.column("v"), width)
    keep = _distinct(ids, x)
    return pa.table({"block": table.column("block")[:1], "tree": pa.array([pickle.dumps((ids[keep], x[keep], cover_tree(x[keep])))], pa.binary())})


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for each row of queries; both have vec_id and whole numbers v.

    Vectors of different length are compared over their common length. Rows that repeat id and vector count once;
    rows with the query's id are its own and left out. Fewer than k candidates: all. An empty table gives no rows; null
    ids must be left out before. Whole numbers are exact while scores stay below 2 ** 53. Blocks are of a fixed size, so
    memory does not depend on the input; each pair of blocks is one task's work, and a tree moves once for each block of
    the other side.
    """
    ship(vectors.sparkSession)

    def trees(df: DataFrame, n: int, size: int, width: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(size), "vec_id"), F.lit(max(1, -(-n // size)))).cast("int")
        return cut(df.select(block.alias("block"), "vec_id", "v").groupBy("block").applyInArrow(lambda t: _plant(t, width), "block int, tree binary"), "trees")

    n, m = (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first() for df in (vectors, queries))
    width = max(1, n.w or 0, m.w or 0)
    rows, asked = trees(vectors, n.n, ROW_BLOCK, width), trees(queries, m.n, QUERY_BLOCK, width)
    parts = [F.lit(max(1, -(-c.n // s)) - 1) for c, s in ((n, ROW_BLOCK), (m, QUERY_BLOCK))]
    rows = rows.select(F.col("block").alias("rb"), F.explode(F.sequence(F.lit(0), parts[1])).alias("qb"), "tree")
    asked = asked.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), parts[0])).alias("rb"), "tree")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)}
        if left.num_rows and right.num_rows:
            x_ids, x, x_tree = pickle.loads(left.column("tree")[0].as_py())
            q_ids, q, q_tree = pickle.loads(right.column("tree")[0].as_py())
            s = Search(q, q_ids, x, x_ids, k, q_tree, x_tree)
            i, j = np.nonzero(np.isfinite(s.scores))
            out = {"query_id": s.q_ids[i], "vec_id": s.found[i, j], "score": s.scores[i, j].astype(np.int64)}
        return pa.table(out)

    out = rows.groupBy("qb", "rb").cogroup(asked.groupBy("qb", "rb")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(column: str = "embedding"):
    """Not null and without null or non-finite components."""
    x = F.col(column)
    return x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def op5_topk_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable() & F.col("vec_id").isNotNull())
    whole = cut(rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64).cast("long")).alias("v")), "vectors")
    return top_k(whole, whole.where("vec_id % 20 = 0"), 20)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
