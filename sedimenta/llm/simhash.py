"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints of 64 bits come from word shingles. Bits that go together are put into the same partition; a dynamic
programme over estimated candidate counts gives each partition its own threshold (the sum is tau - parts + 1, and
-1 leaves a partition out). Two fingerprints that differ in tau bits or fewer agree on some partition up to its
threshold, so each fingerprint is filed under the partition's value with that many bits masked out; buckets are
then verified on all 64 bits. The plan depends on counts over all fingerprints and adapts to their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import PAIRWISE_MEMBERS, components, cut, link, ship, text_or_empty, within

BITS = 64
#: In a plan, an expected candidate pair costs as much as so many filed rows.
PAIR_COST = 8
#: Sketches of a text and the minima in each: at a Jaccard of 0.8, 1 - (1 - 0.8 ** 6) ** 16 = 0.992 of the pairs share one.
SKETCHES, ROWS = 16, 6
#: Fingerprints of documents within so many bits are found by the pigeonhole principle.
PROBED = 3


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: A-Z lowered, words between ASCII white space, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[i:j], 42) for i, j in spans], np.uint64)


def fingerprint(text: str, width: int = 3) -> int:
    """Bit i is set if more than half of the shingle hashes have it; no words: 0. A signed long."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t.as_py(), width) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row; a null text counts as empty."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(partial(_fingerprints, width=width), f"doc_id {kind}, fp bigint")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        for at in range(0, len(fp), 1 << 15):
            x = np.unpackbits(fp[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total[i, j]})


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How often bits i and j are both set, over all distinct fingerprints: 64 x 64 numbers whatever the input."""
    out = np.zeros((BITS, BITS))
    for r in prints.select("fp").mapInArrow(_pair_counts, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def _groups(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the bits into parts of near equal size, each filled with the bits most correlated with those it has."""
    p = counts.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    cor = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(cor, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        own = [max(left, key=lambda b: (cor[b][left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (cor[b][own].sum(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def _within(agree: list[float], most: int) -> list[float]:
    """P(at most t of the bits differ) for t = 0..most, bits taken as independent."""
    d = np.zeros(most + 2)
    d[0] = 1
    for q in agree:
        d[1:] = d[1:] * q + d[:-1] * (1 - q)
        d[0] *= q
    return np.cumsum(d)[: most + 1].tolist()


def plan(counts: np.ndarray, n: int, tau: int) -> list[list[int]]:
    """The masks of the cheapest plan: for each kept partition, its bits less each choice of as many bits as its threshold.

    The cost of a partition at a threshold is its filed rows plus PAIR_COST for each expected candidate pair, so pairs stay
    in proportion to rows: keys grow longer, and more of them are filed, as n grows.
    """
    p = counts.diagonal() / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, tau + 2):
        groups = _groups(counts, n, parts)
        total = tau - parts + 1
        cost = [[0.0] + [n * sum(1 for _ in combinations(g, t)) + PAIR_COST * n * n / 2 * w for t, w in enumerate(_within([agree[b] for b in g], total + parts - 1))] for g in groups]
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # sum of (threshold + 1) so far
        for own in cost:
            step: dict[int, tuple[float, tuple]] = {}
            for s, (c, chosen) in states.items():
                for t1 in range(min(len(own) - 1, total + parts - s) + 1):
                    new = (c + own[t1], (*chosen, t1 - 1))
                    if s + t1 not in step or new < step[s + t1]:
                        step[s + t1] = new
            states = step
        c, chosen = states[total + parts]
        if c < best[0]:
            best = (c, [[b for b in g if b not in out] for g, t in zip(groups, chosen, strict=True) if t >= 0 for out in combinations(g, t)])
    return best[1]


def _signed(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << BITS) if v >> (BITS - 1) else v


def filed(prints: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(probe int, masked long, id long, fp long): each distinct fingerprint, which is its own id, under each mask."""
    table = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    return prints.select("fp", F.posexplode(table).alias("probe", "mask")).select("probe", F.col("mask").bitwiseAND(F.col("fp")).alias("masked"), F.col("fp").alias("id"), "fp")


def _sphere(fp: str, radius: int):
    """The longs that differ from fp in exactly radius (1 or 2) bits."""
    flipped = lambda c, i: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    one = lambda c, low: F.transform(F.sequence(low, F.lit(BITS - 1)), lambda i: flipped(c, i))
    if radius == 1:
        return one(F.col(fp), F.lit(0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS - 2)), lambda i: one(flipped(F.col(fp), i), i + 1)))


def ball_links(prints: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that have the components of all pairs within tau (2 or 3) bits.

    Fingerprints within 2 bits are both within one bit of some value, and all around such a value are within 2 bits
    of each other: each is linked with the least of them. At most 65 are around a value, however dense a group is.
    Fingerprints 3 bits apart differ in parity, and some value is one bit from the even one, two from the odd one.
    """
    around = prints.select("fp", F.explode(F.concat(F.array("fp"), _sphere("fp", 1))).alias("z"))
    stars = around.groupBy("z").agg(F.min("fp").alias("lo"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    links = stars.select(F.col("lo").alias("a"), F.explode("all").alias("b"))
    if tau == 3:
        odd = F.bit_count("fp") % 2 == 1
        even_lo = prints.where(~odd).select("fp", F.explode(_sphere("fp", 1)).alias("z")).groupBy("z").agg(F.min("fp").alias("a"))
        far = prints.where(odd).select(F.col("fp").alias("b"), F.explode(_sphere("fp", 2)).alias("z"))
        links = links.unionByName(far.join(even_lo, "z").select("a", "b"))
    return links.where("a <> b")


def near_links(members: DataFrame, tau: int) -> DataFrame:
    """(id, root) of the graph of fingerprints within tau bits, from filed() rows.

    Buckets of up to PAIRWISE_MEMBERS are probed pair by pair; the fingerprints of larger ones by ball_links(), whose
    work is linear in their number. Every link is verified on all 64 bits.
    """
    keys = ["probe", "masked"]
    sizes = cut(members.groupBy(*keys).agg(F.count("fp").alias("n")).where("n > 1"), "buckets")
    rows = cut(members.join(sizes, keys).select(*keys, "fp", "n"), "members")
    few = rows.where(F.col("n") <= PAIRWISE_MEMBERS).groupBy(*keys).agg(F.collect_list("fp").alias("own"))
    a = few.select(F.posexplode("own").alias("at", "a"), "own")
    pairs = a.select("a", F.explode(F.slice("own", F.col("at") + 2, PAIRWISE_MEMBERS)).alias("b"))
    hot = cut(rows.where(F.col("n") > PAIRWISE_MEMBERS).select("fp").distinct(), "hot")
    return components(pairs.unionByName(ball_links(hot, tau)).where(within("a", "b", tau)))


def simhash_groups(docs: DataFrame, width: int = 3, tau: int = 2) -> DataFrame:
    """Link documents whose fingerprints differ in tau bits or fewer.

    Returns (doc_id, fp long, component_id), a row for each input row; component_id is the smallest doc_id that is
    reachable over links. Null and empty texts have fingerprint 0 and link like any other. Rows may repeat: each
    gets its row. A null doc_id takes part but never names a component that has another id. An empty table gives no
    rows. Other columns are ignored. Work after the fingerprints is on distinct fingerprints, so exact copies cost one node.
    """
    prints = cut(fingerprints(docs, width), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    n = nodes.count()
    masks = plan(bit_counts(nodes), n, tau)
    members = filed(nodes, masks)
    if tau in (2, 3):
        labels = near_links(members, tau)
    else:
        labels = link(members.select(F.xxhash64("probe", "masked").alias("key"), "id", "fp"), lambda pairs: pairs.where(within("a", "b", tau)), tau)
    rooted = cut(nodes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = cut(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _shared(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            p, q = set(shingle_hashes(x, width).tolist()), set(shingle_hashes(y, width).tolist())
            out.append(len(p & q) / len(p | q) if p or q else 1.0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "similarity"])


def sketch(h: np.ndarray) -> list[int]:
    """SKETCHES signed longs from shingle hashes, each over ROWS minima; sets with a Jaccard of J share one with J ** ROWS."""
    from xxhash import xxh64_digest

    rnd = np.random.RandomState(1)
    times, plus = rnd.randint(0, 1 << 62, (2, SKETCHES * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(SKETCHES * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 12):
        least = np.minimum(least, (h[at : at + (1 << 12), None] * times + plus).min(0))
    return [int.from_bytes(xxh64_digest(own.tobytes()), "big", signed=True) for own in least.reshape(SKETCHES, ROWS)]


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        prints, own = [fingerprint(t, width) for t in texts], [sketch(shingle_hashes(t, width)) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["id", "fp", "own"])


def pigeonhole_members(prints: DataFrame, tau: int) -> DataFrame:
    """(key, id, fp) of rows (id, fp) under each mask of the plan for tau bits: fingerprints that differ in tau bits or fewer share a key."""
    distinct = cut(prints.select("fp").distinct(), "fingerprints")
    table = F.array(*[F.lit(_signed(m)).cast("long") for m in plan(bit_counts(distinct), distinct.count(), tau)])
    rows = prints.select("id", "fp", F.posexplode(table).alias("probe", "mask"))
    return rows.select(F.xxhash64(F.lit("mask"), "probe", F.col("mask").bitwiseAND(F.col("fp"))).alias("key"), "id", "fp")


def near_copies(docs: DataFrame, width: int, tau: int, similarity: float) -> DataFrame:
    """(doc_id, id, root) of each pair of doc_id and text: id is the text's hash, and equal roots are near copies.

    Distinct texts whose fingerprints differ in PROBED bits or fewer are candidates, found by the pigeonhole principle as in
    simhash_groups(), and so are those that share a sketch, as most pairs at a Jaccard of 0.8 differ in more bits than blocks can
    find. They are linked if their fingerprints differ in tau bits or fewer and their sets of shingles have similarity (Jaccard) in common; root names a component of these links. A
    null text counts as empty; texts without words are near copies of each other.
    """
    ship(docs.sparkSession)
    texts = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("id"), "text")
    nodes = cut(texts.groupBy("id").agg(F.first("text").alias("text")), "nodes")
    prints = cut(nodes.mapInArrow(partial(_sketches, width=width), "id bigint, fp bigint, own array<bigint>"), "sketches")
    sketched = prints.select("id", "fp", F.posexplode("own").alias("probe", "masked")).select(F.xxhash64("probe", "masked").alias("key"), "id", "fp")
    print_of = lambda most: F.struct("fp", F.lit(most).alias("most")).alias("fp")
    members = sketched.select("key", "id", print_of(tau)).unionByName(pigeonhole_members(prints, PROBED).select("key", "id", print_of(min(PROBED, tau))))
    near = lambda a, b: F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= F.col(f"{a}.most")

    def verify(pairs: DataFrame) -> DataFrame:
        fa, fb = (prints.select(F.col("id").alias(x), F.col("fp").alias(f"f{x}")) for x in "ab")
        near = cut(pairs.join(fa, "a").join(fb, "b").where(within("fa", "fb", tau)).select("a", "b"), "near")
        ta, tb = (nodes.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        both = near.join(ta, "a").join(tb, "b").select(F.struct("a", "b").alias("ids"), "ta", "tb")
        close = both.mapInArrow(partial(_shared, width=width), "doc_id struct<a: bigint, b: bigint>, similarity double")
        return close.where(F.col("similarity") >= similarity).select("doc_id.a", "doc_id.b")

    labels = link(members, verify, tau, near=near)
    return texts.select("doc_id", "id").distinct().join(labels, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))


def op3_simhash_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
