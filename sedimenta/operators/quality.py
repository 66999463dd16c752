"""Quality score, validation and processing flags of the specified record form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def steps(value: Column, arms: list[tuple[float, float]], default: float) -> Column:
    """The score of the first arm (least value, score) that the value reaches."""
    out = F.lit(default)
    for least, score in reversed(arms):
        out = F.when(value >= least, score).otherwise(out)
    return out


def quality_score(length: Column, source: Column, sentiment: Column, location: Column, recency: Column) -> Column:
    """Weighted sum of five scores between 0 and 1."""
    return length * 0.2 + source * 0.3 + sentiment * 0.2 + location * 0.15 + recency * 0.15


def violations(df: DataFrame) -> DataFrame:
    """Adds violations: which of the written rules a record (id, source, url, content, rating, score) breaks.

    A column scraped_at must be an ISO 8601 time, a column quality_score between 0 and 1.
    """
    extra = {"date": F.try_to_timestamp("scraped_at").isNotNull()} if "scraped_at" in df.columns else {}
    if "quality_score" in df.columns:
        extra["quality"] = F.col("quality_score").isNull() | F.col("quality_score").between(0, 1)
    alone = F.count(F.lit(1)).over(W.partitionBy("source", "id")) == 1
    tests = extra | {
        "required": F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("url").isNotNull() & F.col("content").isNotNull(),
        "unique_id": alone, "url": F.col("url").rlike("^https?://"), "length": F.length("content") >= 20,
        "rating": F.col("rating").isNull() | F.col("rating").between(1, 5), "sentiment": F.col("score").isNull() | F.col("score").between(-1, 1),
    }
    each = [F.when(~F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]
    return df.withColumn("violations", F.filter(F.array(*each), lambda x: x.isNotNull()))


def flags(duplicate: Column, short: Column, keyword: Column, location: Column) -> Column:
    each = {"duplicate": duplicate, "low_length": short, "keyword_match": keyword, "location_found": location}
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in each.items()]), lambda x: x.isNotNull())
