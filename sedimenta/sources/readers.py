"""Readers with declared schemas, and request tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "id string, source string, text string, timestamp string, url string, language string, metadata string, content_length bigint, word_count bigint, is_truncated boolean, original_length bigint, extraction_method string"
POST = "id string, title string, selftext string, score bigint, upvote_ratio double, num_comments bigint, created_utc double, created_date string, author string, subreddit string, url string, permalink string, source string, scraped_at string, comments array<struct<id string, body string, score bigint, created_utc double, author string>>"


def jsonl(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """One object a line; damaged lines come with nulls and their text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; types follow column by column."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS file."""
    schema = "title string, link string, description string, pubDate string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def pages(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Fetched pages; with a year, only that partition."""
    df = spark.read.parquet(path)
    return df.where(F.col("year") == year) if year is not None else df


def requests(spark: SparkSession, base: str, most: int) -> DataFrame:
    """The paginated request table of a listing."""
    return spark.range(1, most + 1).select(F.col("id").cast("int").alias("page"), F.concat(F.lit(f"{base}?page="), F.col("id").cast("string")).alias("url"))


def fixed(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "seq int, url string")


def hot_and_new(hot: DataFrame, new: DataFrame, order: str, n: int) -> DataFrame:
    """Half of the limit from either listing, in listing order."""
    return hot.orderBy(order).limit(n // 2).unionByName(new.orderBy(order).limit(n // 2))


def setting(spark: SparkSession, name: str, default: str) -> str:
    """A parameter from the session, else the environment, else the default."""
    return spark.conf.get(f"spark.sedimenta.{name}", os.environ.get(name.upper(), default))
