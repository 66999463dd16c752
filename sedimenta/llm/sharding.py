"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters rows by seeded hashes: rendezvous hashing on doc_id picks the shard (a further shard takes rows
only into itself), a second hash picks one of the shard's buckets, sized to fit a task's memory. Pass two draws
each bucket in order into an array and permutes it with Spark's shuffle(), which is a Fisher-Yates shuffle.
Bucket counts give each bucket its first slot, so slots of a shard run from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.common import scratch_path, text_or_empty

#: Bytes of one bucket; a row that carries no text counts as ROW_BYTES.
BUCKET_BYTES = 32 << 20
ROW_BYTES = 96


def text_size():
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.octet_length(text_or_empty()) + 16).cast("long")


def rendezvous(key: str, shards: int, seed: int):
    """The shard whose seeded hash of the key is largest, as struct (h, shard)."""
    each = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(key)).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]
    return F.greatest(*each) if shards > 1 else each[0]


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7, carry: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Assign each row a shard, a bucket and a slot.

    Returns doc_id, size, text_crc32, the column that carry names, law ("key": doc_id and the number of shards alone decide
    the shard, so equal texts with different ids are spread like any others), shard, grown_shard (with one shard more),
    bucket and slot. A null doc_id is hashed as null. A null text has size 16 and the checksum of no bytes. Repeated rows
    keep a slot each, in any order. An empty table gives no rows. doc_id is taken as nearly unique: rows that share one
    share a bucket. Only the carried column travels; its type, and other columns' names, don't matter.
    """
    spark = docs.sparkSession
    own = F.struct("doc_id", text_size().alias("size"), F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"))
    rows = docs.select(own.alias("own"), (F.col(carry) if carry else F.lit(None)).alias("carried"), (text_size() if carry else F.lit(0)).alias("held"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("b")).first()
    per_shard = max(1, -(-(sizes.n * ROW_BYTES + (sizes.b or 0)) // (shards * bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "own.doc_id"), F.lit(per_shard)).cast("int")
    placed = rows.withColumn("best", rendezvous("own.doc_id", shards, seed))
    more = F.xxhash64(F.lit(seed), F.lit(shards), F.col("own.doc_id"))
    placed = placed.select((-F.col("best.s")).alias("shard"), F.when(more > F.col("best.h"), shards).otherwise(-F.col("best.s")).alias("grown_shard"), bucket.alias("bucket"), "own", "carried")
    order = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_key = lambda a, b: F.when(a["own"] < b["own"], -1).when(a["own"] > b["own"], 1).otherwise(0)
    drawn = placed.repartition(parts, "shard", "bucket").groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("own", "grown_shard", "carried")), by_key).alias("rows"))
    drawn = drawn.sortWithinPartitions("shard", "bucket").withColumn("rows", F.shuffle("rows", F.lit(seed)))
    out = drawn.join(firsts, ["shard", "bucket"]).select("shard", "bucket", "first", F.posexplode("rows").alias("at", "x"))
    return out.select("x.own.*", *([F.col("x.carried").alias(carry)] if carry else []), F.lit("key").alias("law"), "shard", "x.grown_shard", "bucket", (F.col("first") + F.col("at")).alias("slot"))


PLACE = ("size", "text_crc32", "law", "shard", "grown_shard", "bucket", "slot")


def place_names(docs: DataFrame) -> dict[str, str]:
    """The names of a row's place among the columns of docs: with underscores before them where docs has the name."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for name in PLACE:
        out[name] = name
        while out[name] in taken:
            out[name] = "_" + out[name]
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> DataFrame:
    """Write whole rows as Parquet, a folder for each shard, a file for each of its buckets, rows in slot order; the result reads them.

    The columns of docs keep their names, beside them stands the row's place under place_names().
    """
    names = place_names(docs)
    rows = shard_rows(docs.select("doc_id", "text", F.struct("*").alias("row")), shards, carry="row", **options)
    rows = rows.select("row.*", *[F.col(c).alias(names[c]) for c in PLACE])
    rows.sortWithinPartitions(names["shard"], names["slot"]).write.partitionBy(names["shard"]).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def op2_sharding(spark, sf_dir):
    """Shards are written whole to the shared folder; size and checksum are those of the texts read from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written, names = write_shards(docs, scratch_path(spark, "shards")), place_names(docs)
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    return written.select("doc_id", text_size().alias("size"), crc.alias("text_crc32"), *[F.col(names[c]).alias(c) for c in ("law", "shard", "slot", "grown_shard")])
