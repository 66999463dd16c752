"""Embedding near-dedup with a hierarchical navigable small-world graph for each shard.

Vectors are compared only under equal labels. Equal vectors count as one node with a number of copies. Nodes of a
label are dealt into shards of bounded size; each shard's graph is built once and written as a row, and every block
of the label's nodes queries every shard. A beam that is full of links is widened; an audit of some queries against
the whole shard widens all beams until it finds them all. Links are verified in double precision, counted, and
handed on as spanning stars, never as all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import components, cut, ship
from sedimenta.llm.topk import _matrix, usable

SHARD_ROWS = 8192
QUERY_ROWS = 4096
#: Queries whose links are held at a time.
PART_ROWS = 512
DEGREE, CAP, BEAM = 8, 16, 48
EXPAND = 4
#: Share of an audit's links that beams must find, and every how many-th query is audited.
RECALL = 0.999
AUDIT_EVERY = 37
#: Audited queries of a block at least, if it has as many.
AUDITS = 64
SLACK = 1e-4


class Hnsw:
    """Nodes are ordered by level, so layer l holds the first sizes[l] of them; layers are filled from the top."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.minimum((-np.log(1 - np.random.RandomState(seed).random_sample(n)) / np.log(DEGREE)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")
        self.x, level = self.x[self.order], level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers = [np.full((s, CAP), -1, np.int32) for s in self.sizes]
        for k in reversed(range(len(self.sizes))):
            self.fill(k)

    def fill(self, k: int) -> None:
        n, done = self.sizes[k], 0
        while done < n:
            end = min(n, done + max(64, min(done, 1024)))
            q = self.x[done:end]
            near = q @ q.T
            np.fill_diagonal(near, -2)
            c = min(BEAM // 2, len(q) - 1)
            own = np.argpartition(-near, c - 1, 1)[:, :c] if c > 0 else np.empty((len(q), 0), int)
            ids, sims = own + done, np.take_along_axis(near, own, 1)
            if done:
                old, s = self.beam(q, self.entries(q, k), k, BEAM, done)
                ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, s], 1)
            picked = self.diverse(ids, sims, DEGREE)
            self.layers[k][done:end, :DEGREE] = picked
            self.reverse(k, np.arange(done, end), picked)
            done = end

    def diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row than to any taken before; -1 fills up."""
        order = np.argsort(-sims, 1, kind="stable")[:, : 3 * most + 8]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        kept, n = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for j in range(ids.shape[1]):
            ok = (ids[:, j] >= 0) & (n < most) & ~((among[:, j] >= sims[:, j, None]) & kept).any(1)
            kept[:, j] = ok
            n += ok
        out = np.full((len(ids), most), -1, np.int32)
        r, j = np.nonzero(kept)
        out[r, kept.cumsum(1)[r, j] - 1] = ids[r, j]
        return out

    def reverse(self, k: int, new: np.ndarray, picked: np.ndarray) -> None:
        """Link back from the picked nodes; lists that overflow are thinned."""
        graph = self.layers[k]
        source, target = np.repeat(new, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = (self.x[source] * self.x[target]).sum(1)
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        heads, firsts, counts = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(heads), 1024):
            h, f, c = heads[at : at + 1024], firsts[at : at + 1024], np.minimum(counts[at : at + 1024], CAP)
            extra = np.full((len(h), int(c.max())), -1, np.int32)
            r = np.repeat(np.arange(len(h)), c)
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            extra[r, j] = source[f[r] + j]
            extra[(extra[:, :, None] == graph[h][:, None, :]).any(2)] = -1
            all_ = np.concatenate([graph[h], extra], 1)
            full = (all_ >= 0).sum(1) > CAP
            left = all_[~full]
            graph[h[~full]] = np.take_along_axis(left, np.argsort(left < 0, 1, kind="stable"), 1)[:, :CAP]
            if full.any():
                ids = all_[full]
                s = np.einsum("bmd,bd->bm", self.x[np.maximum(ids, 0)], self.x[h[full]])
                graph[h[full]] = self.diverse(ids, np.where(ids >= 0, s, -2), CAP)

    def entries(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each query the best nodes of the layer above, by descent from the top."""
        at = np.zeros((len(q), 1), np.int64)
        for up in range(len(self.sizes) - 1, k, -1):
            ids, _ = self.beam(q, at, up, 8, self.sizes[up])
            at = np.where(ids[:, :4] >= 0, ids[:, :4], ids[:, :1])
        return at

    def beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The width best nodes met from the start nodes, best first, and their similarities; -1 and -2 fill up."""
        graph, rows = self.layers[k], len(q)
        ids, sims = np.full((rows, width), -1, np.int64), np.full((rows, width), -2, np.float32)
        spent = np.ones((rows, width), bool)
        seen = np.zeros((rows, limit), bool)
        active, new = np.arange(rows), start
        while len(active):
            r = np.arange(len(active))[:, None]
            ok = (new >= 0) & (new < limit)
            safe = np.where(ok, new, 0)
            ok &= ~seen[active[:, None], safe]
            srt = np.sort(np.where(ok, safe, -1 - np.arange(safe.shape[1])), 1)
            if (srt[:, 1:] == srt[:, :-1]).any():  # one node over two edges
                for j in range(1, safe.shape[1]):
                    ok[:, j] &= ~((safe[:, :j] == safe[:, j, None]) & ok[:, :j]).any(1)
            seen[active[:, None].repeat(safe.shape[1], 1)[ok], safe[ok]] = True
            s = np.where(ok, np.matmul(self.x[safe], q[active][:, :, None])[:, :, 0], -2)
            both_s = np.concatenate([sims[active], s], 1)
            top = np.argsort(-both_s, 1, kind="stable")[:, :width]
            sims[active] = np.take_along_axis(both_s, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(ok, safe, -1)], 1), top, 1)
            spent[active] = done = np.take_along_axis(np.concatenate([spent[active], ~ok], 1), top, 1)
            pick = np.argsort(done, 1, kind="stable")[:, : min(EXPAND, width)]
            use = ~np.take_along_axis(done, pick, 1)
            go = use.any(1)
            spent[active[:, None], pick] = True
            cur = np.where(use, np.take_along_axis(ids[active], pick, 1), 0)
            new = np.where(use[:, :, None], graph[cur], -1).reshape(len(active), -1)[go]
            active = active[go]
        return ids, sims

    def links(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of linked_parts() at once."""
        return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *self.linked_parts(q, least), strict=True))

    def linked_parts(self, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node in the given order) with at least this similarity, PART_ROWS queries at a time.

        Beams are widened until they find enough of what a full scan finds for the audited queries.
        """
        q = np.ascontiguousarray(q, np.float32)
        n, width = len(self.x), BEAM // 2
        audit = np.arange(0, len(q), max(1, min(AUDIT_EVERY, len(q) // AUDITS)))
        while width < n:
            found = known = 0
            for at in range(0, len(audit), PART_ROWS):
                own = q[audit[at : at + PART_ROWS]]
                truth = own @ self.x.T >= least
                a, b = self.within(own, least, width)
                found, known = found + int(truth[a, b].sum()), known + int(truth.sum())
            if found >= RECALL * known:
                break
            width *= 2
        for at in range(0, len(q), PART_ROWS):
            own = q[at : at + PART_ROWS]
            a, b = self.within(own, least, width) if width < n else np.nonzero(own @ self.x.T >= least)  # a part of the graph that no beam reaches
            yield a + at, self.order[b]

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        out, n = [], len(self.x)
        for at in range(0, len(q), 1024):
            rows, w = np.arange(at, min(at + 1024, len(q))), width
            while len(rows):
                if w > 4 * width:  # so many links that the whole shard is no dearer
                    r, b = np.nonzero(q[rows] @ self.x.T >= least)
                    out.append((rows[r], b))
                    break
                ids, s = self.beam(q[rows], self.entries(q[rows], 0), 0, min(w, n), n)
                full = s[:, -1] >= least
                r, j = np.nonzero((s >= least) & ~full[:, None])
                out.append((rows[r], ids[r, j]))
                rows, w = rows[full], 4 * w if w < 4 * width and w < n else 4 * width + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n nodes reaches over the pairs (a, b)."""
    label = ids.copy()
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            break
    return label


def _build(table: pa.Table) -> pa.Table:
    ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    order = np.argsort(ids)
    x = _matrix(table.column("embedding"), table.column("dim")[0].as_py())[order]
    graph = Hnsw(unit(x))
    row = {k: [table.column(k)[0].as_py()] for k in ("label", "dim", "shard", "blocks")}
    return pa.table(row | {"graph": pa.array([pickle.dumps((ids[order], copies[order], x, graph))], pa.binary())}, schema=pa.schema([("label", table.schema.field("label").type), ("dim", pa.int32()), ("shard", pa.int32()), ("blocks", pa.int32()), ("graph", pa.binary())]))


def _search(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    ids, sums, roots = [], [], []
    if left.num_rows and right.num_rows:
        x_ids, copies, x, graph = pickle.loads(left.column("graph")[0].as_py())
        q_ids = right.column("rep").to_numpy()
        q = _matrix(right.column("embedding"), x.shape[1])
        uq, ux = unit(q), unit(x)
        nodes, at = np.unique(np.concatenate([q_ids, x_ids]), return_inverse=True)
        own, other = at[: len(q_ids)], at[len(q_ids) :]
        n, root = np.zeros(len(q_ids), np.int64), np.arange(len(nodes))
        for a, b in graph.linked_parts(uq, least - SLACK):  # a part's links are counted and joined before the next part's are listed
            ok = np.concatenate([(uq[a[i : i + 65536]] * ux[b[i : i + 65536]]).sum(1) >= least for i in range(0, len(a), 65536)] or [np.empty(0, bool)]) & (q_ids[a] != x_ids[b])
            a, b = a[ok], b[ok]
            n += np.bincount(a, copies[b], len(q_ids)).astype(np.int64)
            root = local_roots(len(nodes), root[own[a]], root[other[b]], np.arange(len(nodes)))[root]
        root = nodes[root]
        total = np.zeros(len(nodes), np.int64)
        total[own] = n
        keep = (total > 0) | (root != nodes)
        ids, sums, roots = nodes[keep], total[keep], root[keep]
    return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(sums, pa.int64()), "root": pa.array(roots, pa.int64())})


def embedding_groups(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding, label).

    Links: cosine of at least least under equal labels that are not null, vectors of equal length. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and are kept. Repeated rows and equal
    vectors are linked copies. An empty table gives no rows. Other columns are ignored. Components are doubles.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    kind = rows.schema["label"].dataType.simpleString()
    part = usable() & F.col("label").isNotNull() & F.exists("embedding", lambda c: c != 0)
    alone = rows.where(~F.coalesce(part, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where(part)
    nodes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.withColumn("dim", F.size("embedding")), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.select("label", "dim", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("blocks")), "sizes")
    dealt = nodes.join(sizes, ["label", "dim"])
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    graphs = dealt.withColumn("shard", place(1, "shards")).groupBy("label", "dim", "shard").applyInArrow(_build, f"label {kind}, dim int, shard int, blocks int, graph binary")
    graphs = cut(graphs, "graphs").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = dealt.withColumn("block", place(2, "blocks")).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    keys = ["label", "dim", "shard", "block"]
    found = graphs.select(*keys, "graph").groupBy(*keys).cogroup(asked.select(*keys, "rep", "embedding").groupBy(*keys))
    found = cut(found.applyInArrow(lambda a, b: _search(a, b, least), "id long, n long, root long"), "found")
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = nodes.select("label", "embedding", "rep", "copies").join(sums.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = cut(named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    # a root is the least representative only after the first round of contraction; the least id of its nodes names it
    least_id = cut(nodes.join(labels.withColumnRenamed("id", "rep"), "rep").groupBy("root").agg(F.min("rep").alias("least")), "least")
    named = cut(named.join(least_id, "root", "left").select("label", "embedding", "n_links", F.coalesce("least", "root").alias("component_id")), "groups")
    out = rows.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embedding_dedup(spark, sf_dir):
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a WHERE r.root < l.b
), c AS (SELECT id, min(root) AS root FROM r GROUP BY id
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, m.vec_id = c.root AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id JOIN c ON c.id = m.vec_id
"""
