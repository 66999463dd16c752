"""Mixing sources to target weights as a time-varying curriculum.

Targets: the sources share a budget by weight, none above a multiple of its own size; the level at which that
holds is found in closed form over the sources, ordered by cap over weight. Within a source documents are in the
order of a hash; whole passes repeat every document, the rest is the documents up to the remaining words, the one
on the boundary taken in part. Positions: each source's weight is a line over training time, 1 + a(2t - 1); its
integral is the share of the target demanded by time t, and inverting it at a document's cumulative words gives
the document's training position in [0, 1]. Documents are then range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, text_or_empty

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_REPEATS = 2
#: The a of each source's schedule, in turn: above 0 more is taken late, below 0 early.
SLOPES = (0.0, 0.6, -0.6)
BUCKET_ROWS = 20_000


def word_count():
    """Number of runs of anything but ASCII white space; null text: 0."""
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """(skey, sid, source_size, target) of each source; sizes has skey, source and size."""
    each = sizes.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    each = each.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    each = each.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    each = each.withColumn("cap", F.col("source_size").cast("double") * most)
    fill = W.orderBy(F.col("cap") / F.col("w"), "sid")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy()).cast("double") * budget
    each = each.withColumn("level", (whole - before) / left).withColumn("level", F.max("level").over(W.partitionBy()))
    return each.select("skey", "sid", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _position(share, slope):
    """The time at which the schedule's integral reaches share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * F.when(slope == 0, F.lit(1.0)).otherwise(slope)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, position, positions.

    taken counts words, repeats included; the sum over a source is its target, rounded. positions has one
    for each copy, the one taken in part last (empty if nothing is taken); position is the first, null if nothing is taken. Order in a source: md5 of doc_id as text (null: of ""), then size, so
    reruns agree; repeated rows have a turn each. A null source is a source of its own, last. Null or blank texts have size 0
    and are never taken. An empty table gives no rows; columns beside doc_id, text and source are ignored. Sources' running sums are added up over hash ranges, so that no task holds a source.
    """
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    turn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = cut(docs.select("doc_id", "source", word_count().alias("size"), skey.alias("skey"), turn.alias("turn")), "sizes")
    digits = max(1, math.ceil(math.log(max(2, sizes.count() / BUCKET_ROWS), 16)))
    rows = sizes.withColumn("bucket", F.substring("turn", 1, digits))
    targets = source_targets(sizes, weights, budget, most)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("b"))
    firsts = sums.withColumn("first", F.coalesce(F.sum("b").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = cut(firsts.join(targets, "skey").select("skey", "bucket", "first", "sid", "source_size", "target"), "targets")
    inside = W.partitionBy("skey", "bucket").orderBy("turn", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("cum", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(known, ["skey", "bucket"]).withColumn("cum", F.col("cum") + F.col("first"))
    words = F.round("target").cast("long")
    passes = F.coalesce(F.try_divide(words, "source_size"), F.lit(0.0)).cast("long")
    rows = rows.withColumn("words", words).withColumn("passes", passes)
    extra = F.greatest(F.lit(0), F.least("size", F.col("words") - F.col("passes") * F.col("source_size") - F.col("cum")))
    rows = rows.withColumn("extra", extra).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    first = F.when(F.col("passes") > 0, F.col("size")).otherwise(F.col("extra"))
    share = F.try_divide(F.col("cum") + first / 2, F.col("words"))
    slope = F.element_at(F.array(*[F.lit(float(a)) for a in slopes]), (F.col("sid") % len(slopes) + 1).cast("int"))
    done = lambda i: i * F.col("source_size") + F.col("cum")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda i: done(i) + F.col("size") / 2))
    part = F.when(F.col("extra") > 0, F.array(done(F.col("passes")) + F.col("extra") / 2))
    none = F.array().cast("array<double>")
    at = F.when(F.col("taken") > 0, F.concat(F.coalesce(whole, none), F.coalesce(part, none))).otherwise(none)
    positions = F.transform(at, lambda x: _position(F.try_divide(x, F.col("words")), slope))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, _position(share, slope)).alias("position"), positions.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sort by position; rows that are not taken follow, by a hash, so that they form no hot key."""
    key = F.coalesce("position", 1 + F.abs(F.xxhash64("doc_id") % 1_000_003) / 1_000_003.0)
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.withColumn("_at", key).repartitionByRange(n, "_at").sortWithinPartitions("_at", "doc_id").drop("_at")


def op10_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return in_training_order(cut(mix(docs), "mixed")).select("doc_id", "size", "source_size", "target", "taken", "position")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0])[sid % 3 + 1]::DOUBLE AS w, ([0.0, 0.6, -0.6])[sid % 3 + 1]::DOUBLE AS a, source_size::DOUBLE * 2 AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w
), t AS (SELECT source, source_size, a, least(cap, max(lv) OVER () * w) AS target FROM l
), c AS (
  SELECT doc_id, size, source_size, target, a, round(target)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS passes FROM c
), x AS (SELECT *, greatest(0, least(size, words - passes * source_size - cum)) AS extra FROM p
), y AS (SELECT *, (passes * size + extra)::BIGINT AS taken, (cum + CASE WHEN passes > 0 THEN size ELSE extra END / 2) / nullif(words, 0) AS share FROM x)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN a = 0 THEN share ELSE (sqrt((1 - a) * (1 - a) + 4 * a * share) - (1 - a)) / (2 * a) END END AS position
FROM y
"""
