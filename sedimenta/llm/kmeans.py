"""Centroid clustering (Lloyd's rounds, exact integers) with Drake's adaptive bounds.

For each vector are kept: its cluster with an upper bound of the distance, lower bounds of the distances to several next
nearest centroids, and one lower bound for all the rest. Bounds are moved by how far centroids went. A vector is done if
its upper bound is under all lower bounds; else its distance is computed; else those of its several nearest; only where
the bound for the rest cannot certify the order are all centroids scanned. The number of bounds kept falls to the
highest rank that was needed in a round. Distances that decide are whole numbers, so results are exact.

A round is one pass over the vectors in batches. Beside the new bounds each task leaves one row for each centroid with
the sum of its vectors; these are added up by Spark and only the centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, ship, tidy

K, ROUNDS, WIDTH = 16, 3, 64
#: Components must stay below this, so that squared distances of up to 512 components fit a long.
LARGEST = 2**26
#: Bounds are compared with so much to spare, relative and absolute: more than rounding can add up.
SPARE = 1e-9
STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, near array<int>, lower array<double>, rest double, summary boolean, sums array<long>, n long, scans long, rank int"


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of x by rows of c; by matrix product where doubles are exact."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:
        a, b = x.astype(float), c.astype(float)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - own) ** 2).sum(1) for own in c], 1)


def _farthest(moved: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each row the farthest that a centroid went which is not among the row's known ones."""
    out, open_ = np.zeros(len(known)), np.ones(len(known), bool)
    for c in np.argsort(-moved)[: known.shape[1] + 1]:
        here = open_ & ~(known == c).any(1)
        out[here] = moved[c]
        open_ &= ~here
    return out


class Bounds:
    """The bounds of a batch of vectors against centroids numbered from 0."""

    def __init__(self, x: np.ndarray, centres: np.ndarray, keep: int):
        self.x, self.centres, self.keep, self.scans, self.rank = x, centres, min(keep, len(centres) - 1), 0, 0
        n = len(x)
        self.cluster, self.upper, self.rest = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        self.near, self.lower = np.zeros((n, self.keep), np.int64), np.zeros((n, self.keep))

    def load(self, cluster, upper, near, lower, rest, moved: np.ndarray) -> None:
        """Bounds of the round before, moved; bounds beyond those to keep join the rest."""
        self.cluster, self.upper = cluster, upper + moved[cluster]
        lower = lower - moved[near]
        self.rest = np.minimum(rest - _farthest(moved, np.concatenate([cluster[:, None], near], 1)), lower[:, self.keep :].min(1, initial=np.inf))
        self.near, self.lower = near[:, : self.keep], lower[:, : self.keep]

    def scan(self, at: np.ndarray) -> None:
        """All centroids for these vectors; equal distances: the smaller number first."""
        if not len(at):
            return
        self.scans += len(at)
        d = squares(self.x[at], self.centres)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        b = self.keep
        self.cluster[at], self.upper[at] = order[:, 0], root[:, 0]
        self.near[at], self.lower[at] = order[:, 1 : b + 1], root[:, 1 : b + 1]
        self.rest[at] = root[:, b + 1] if d.shape[1] > b + 1 else np.inf

    def settle(self) -> None:
        """Certify, or find anew, the nearest centroid of each vector."""
        over = self.upper * (1 + SPARE) + SPARE
        open_ = np.flatnonzero(over >= np.minimum(self.lower.min(1, initial=np.inf), self.rest))
        exact = np.sqrt(((self.x[open_] - self.centres[self.cluster[open_]]) ** 2).sum(1).astype(float))
        self.upper[open_] = exact
        over = exact * (1 + SPARE) + SPARE
        far = over >= self.rest[open_]
        self.scan(open_[far])
        needed = (over[:, None] >= self.lower[open_]) & ~far[:, None]
        some = needed.any(1)
        at, needed = open_[some], needed[some]
        if len(at):
            self.rank = int(needed.sum(1).max())
            ids = np.concatenate([self.cluster[at][:, None], self.near[at]], 1)
            d = ((self.x[at][:, None, :] - self.centres[ids]) ** 2).sum(2)
            order = np.lexsort((ids, d), axis=1)
            ids, root = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
            self.cluster[at], self.upper[at], self.near[at], self.lower[at] = ids[:, 0], root[:, 0], ids[:, 1:], root[:, 1:]


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _list(rows: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel(), kind))


def _round(batches: Iterator[pa.RecordBatch], centres: np.ndarray, moved: np.ndarray | None, kept: int, keep: int) -> Iterator[pa.RecordBatch]:
    """The new bounds of each vector, then a summary row for each centroid."""
    k, width = centres.shape
    sums, counts, scans, rank = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0, 0
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64()), ("near", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())),
                        ("rest", pa.float64()), ("summary", pa.bool_()), ("sums", pa.list_(pa.int64())), ("n", pa.int64()), ("scans", pa.int64()), ("rank", pa.int32())])
    none = lambda n, *names: [pa.nulls(n, schema.field(c).type) for c in names]
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column("v"), width, np.int64)
        own = Bounds(x, centres, keep)
        if moved is None:
            own.scan(np.arange(len(x)))
        else:
            own.load(b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy(), _matrix(b.column("near"), kept, np.int64), _matrix(b.column("lower"), kept, float), b.column("rest").to_numpy().copy(), moved)
            own.settle()
        scans, rank = scans + own.scans, max(rank, own.rank)
        np.add.at(sums, own.cluster, x)
        counts += np.bincount(own.cluster, minlength=k)
        d = ((x - centres[own.cluster]) ** 2).sum(1)
        state = [b.column("vec_id"), b.column("v"), pa.array(own.cluster, pa.int32()), pa.array(d), pa.array(own.upper), _list(own.near, pa.int32()), _list(own.lower, pa.float64()), pa.array(own.rest), pa.array(np.zeros(len(x), bool))]
        yield pa.record_batch([*state, *none(len(x), "sums", "n", "scans", "rank")], schema=schema)
    parts = none(k, "vec_id", "v") + [pa.array(np.arange(k), pa.int32())] + none(k, "distance", "upper", "near", "lower", "rest")
    yield pa.record_batch([*parts, pa.array(np.ones(k, bool)), _list(sums, pa.int64()), pa.array(counts), pa.array([scans] + [0] * (k - 1), pa.int64()), pa.array([rank] * k, pa.int32())], schema=schema)


def _summary(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sums and counts by centroid, vectors scanned in full and the highest rank needed: k rows reach the driver."""
    own = state.where("summary").select("cluster", "sums", "n", "scans", "rank")
    totals = own.groupBy("cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)], F.sum("n").alias("n"), F.sum("scans").alias("scans"), F.max("rank").alias("rank"))
    sums, counts, scans, rank = np.zeros((k, width), object), np.zeros(k, object), 0, 0
    for r in totals.collect():
        sums[r.cluster], counts[r.cluster], scans, rank = [r[f"s{i}"] for i in range(width)], r.n, scans + r.scans, max(rank, r["rank"])
    return sums, counts, scans, rank


def centroid_sha256(centre) -> str:
    return hashlib.sha256(",".join(map(str, map(int, centre))).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, scans: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, centroid_sha256) of vectors (vec_id, v array<long>, all of one length).

    The first centroids are the k vectors with the smallest SHA-256 of seed:vec_id (a null vec_id counts as empty text;
    equal ids by their vectors). Rows that repeat an id are vectors of their own. With fewer than k vectors each is
    a centroid; with none the result is empty. Components of LARGEST or more raise an error, as distances would not fit
    a long. scans, if given, is filled with the number of vectors scanned in full in each round.
    """
    spark = vectors.sparkSession
    ship(spark)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    fits = F.when(F.exists("v", lambda c: F.abs(c) >= LARGEST), F.raise_error(F.lit(f"components of {LARGEST} or more"))).otherwise(F.col("v"))
    with tidy() as keep:
        state = cut(vectors.select("vec_id", fits.alias("v"), key.alias("key")), "vectors")
        first = [r.v for r in state.orderBy("key", "vec_id", "v").select("v").limit(k).collect()]
        if not first:
            return keep(cut(state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit("").alias("centroid_sha256")), "clusters"))
        centres, moved, kept = np.array(first, np.int64), None, 0
        state, bounds = state.drop("key"), max(1, len(first) // 4)
        for turn in range(rounds + 1):
            step = lambda it, c=centres, m=moved, was=kept, b=bounds: _round(it, c, m, was, b)
            vectors = state if moved is None else state.where("not summary").select("vec_id", "v", "cluster", "upper", "near", "lower", "rest")
            state, kept = cut(vectors.mapInArrow(step, STATE), "bounds"), min(bounds, len(centres) - 1)
            if scans is None and turn == rounds:
                break
            sums, counts, scanned, rank = _summary(state, *centres.shape)
            if scans is not None:
                scans.append(scanned)
            if turn < rounds:
                fresh = np.array([[int(s) // int(n) for s in own] if n else list(c) for own, n, c in zip(sums, counts, centres, strict=True)], np.int64)
                gap = np.sqrt(((fresh - centres) ** 2).sum(1).astype(float))
                moved, centres = gap * (1 + SPARE), fresh
                bounds = max(1, len(centres) // 8, min(bounds, rank)) if turn else bounds
        names = F.array(*[F.lit(centroid_sha256(c)) for c in centres])
        return keep(cut(state.where("not summary").select("vec_id", "cluster", "distance", names[F.col("cluster")].alias("centroid_sha256")), "clusters"))


def op13_kmeans(spark, sf_dir):
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) == WIDTH) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable)
    found = cluster(rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("long")).alias("v")))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row for each centroid
    inertia = inertia.withColumn("inertia", F.sum("cluster_inertia").over(W.partitionBy()))
    return found.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_NEAREST = """a{i} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, (list_dot_product(e.v, e.v) - 2 * list_dot_product(e.v, m.v) + list_dot_product(m.v, m.v))::BIGINT AS d FROM e, m{i} m) GROUP BY rid)"""
_MOVED = """m{j} AS MATERIALIZED (SELECT c, coalesce(f.v, m.v) AS v FROM m{i} m LEFT JOIN (SELECT c, list(q::DOUBLE ORDER BY k) AS v FROM
  (SELECT c, k, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS q FROM (SELECT c, unnest(v)::BIGINT AS x, unnest(range(64)) AS k FROM e JOIN a{i} USING (rid)) GROUP BY c, k) GROUP BY c) f USING (c))"""
OP13_SQL = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS c, v FROM (SELECT *, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM e) QUALIFY c < 16),
{", ".join(_NEAREST.format(i=i) + ", " + _MOVED.format(i=i, j=i + 1) for i in range(3))}, {_NEAREST.format(i=3)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM e JOIN a3 USING (rid) JOIN m3 m USING (c)
"""
