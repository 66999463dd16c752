"""Exact dedup with the heavy hitters taken out first.

Texts are equal when they are identical after lower-casing A-Z. Every text becomes a SHA-256 digest, written once with the
row's id. A Misra-Gries summary of each partition's digests gives lower bounds of their counts; those that may hold more
than a share of all rows are counted again exactly, and the verified ones, with the row that stays, are broadcast: a
bounded number. Rows of frequent texts are settled where they are read, all other rows by one ordinary exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, ship, text_or_empty, tidy

#: A digest is frequent if it holds more than one in so many rows (or one in as many rows as there are shuffle partitions).
SHARE = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(column: str = "text"):
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    t = text_or_empty(column)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digest(column: str = "text"):
    return F.unhex(F.sha2(normal_text(column), 256))


def misra_gries(counts: Counter, more: dict, most: int) -> Counter:
    """The summary with more counts added, of up to most counters: beyond that all lose the count of the next one."""
    counts.update(more)
    if len(counts) > most:
        loss = sorted(counts.values(), reverse=True)[most]
        counts = Counter({d: c - loss for d, c in counts.items() if c > loss})
    return counts


def _summaries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for b in batches:
        own = b.column(0).value_counts()
        counts = misra_gries(counts, dict(zip(own.field(0).to_pylist(), own.field(1).to_pylist(), strict=True)), most)
    yield pa.record_batch({"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def frequent(rows: DataFrame, share: int) -> DataFrame:
    """(digest, n, best) of the digests with more than one in share of the rows and more than one row: all of them, exactly counted.

    rows has digest, doc_id and uid; best is the struct (doc_id, uid) that stays. With 2 * share - 1 counters for each
    partition a count is too low by one in 2 * share of the partition's rows at most, and so is the sum of all
    partitions' counts; so fewer than 2 * share digests are candidates, whatever the number of rows.
    """
    ship(rows.sparkSession)
    n = rows.count()
    lower = rows.select("digest").mapInArrow(lambda it: _summaries(it, 2 * share - 1), "digest binary, n long")
    candidates = lower.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > n / (2 * share)).select("digest")
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "uid")).alias("best"))
    return cut(exact.where((F.col("n") > n / share) & (F.col("n") > 1)), "frequent")


def _share(docs: DataFrame) -> int:
    return max(SHARE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def exact_groups(docs: DataFrame, share: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs, those that go included.

    Of equal texts the row with the largest doc_id stays; of rows that repeat both, one. Null texts equal empty ones. A
    null doc_id is smaller than any other; if a group has no other, one of its rows stays and keep_id is null. Only doc_id
    and text are read, so other columns' names don't matter; an empty table gives no rows. A group outside the frequent
    ones has up to one in share of the rows, so no task of the exchange holds much more than its part.
    """
    with tidy() as keep:
        rows = cut(docs.select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("uid")), "digests")
        heavy = frequent(rows, share or _share(docs))
        settled = rows.join(F.broadcast(heavy), "digest")
        group = W.partitionBy("digest")
        light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        light = light.withColumns({"n": F.count(F.lit(1)).over(group), "best": F.max(F.struct("doc_id", "uid")).over(group)})
        every = settled.select(*light.columns).unionByName(light)
        return keep(cut(every.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("best.uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "groups"))


def drop_duplicates(docs: DataFrame, share: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows of frequent texts but those with the winner's doc_id go where they are read; the rest meets in one exchange, where the best row of each text stays (map-side first).
    """
    with tidy() as keep:
        rows = cut(docs.select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("uid")), "digests")
        heavy = keep(frequent(rows, share or _share(docs))).select("digest", F.col("best.doc_id").alias("winner"), F.lit(True).alias("frequent"))
    whole = docs.select(F.col("doc_id").alias("id"), digest().alias("digest"), F.struct("*").alias("row"))
    left = whole.join(F.broadcast(heavy), "digest", "left").where(F.col("frequent").isNull() | F.col("id").eqNullSafe(F.col("winner")))
    return left.groupBy("digest").agg(F.max_by("row", F.struct(F.col("id"))).alias("row")).select("row.*")


def op12_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents) WINDOW g AS (PARTITION BY h)
"""
