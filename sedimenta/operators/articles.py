"""Article, post and comment records: built from fields, completed with constants and defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.dates import from_epoch
from sedimenta.functions.text import stable_id, word_count


def article(df: DataFrame, source: str, text: Column, url: Column, stamp: Column, metadata: dict[str, Column], language: str = "en") -> DataFrame:
    """(id, source, text, timestamp, url, language, metadata): metadata is a struct that always names its agency."""
    fields = F.struct(F.lit(source).alias("agency"), *[c.alias(k) for k, c in metadata.items()])
    return df.select(stable_id(source.lower(), url).alias("id"), F.lit(source).alias("source"), text.alias("text"), stamp.alias("timestamp"), url.alias("url"), F.lit(language).alias("language"), fields.alias("metadata"))


def completed(articles: DataFrame, most: int | None = None) -> DataFrame:
    """Articles with measures and defaults: content_length, word_count, is_truncated, original_length, extraction_method.

    With most, texts are cut there; original_length is that before, and is the length where nothing was cut.
    """
    n = F.length("text").cast("long")
    cut = F.lit(False) if most is None else F.coalesce(n > most, F.lit(False))
    own = F.col("text") if most is None else F.substring("text", 1, most)
    rows = articles.withColumns({"original_length": F.coalesce(n, F.lit(0).cast("long")), "is_truncated": cut, "text": own})
    measures = {"content_length": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "word_count": F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")), "extraction_method": F.lit("web_scraping")}
    return rows.withColumns(measures)


def merged_metadata(*maps: Column) -> Column:
    """Maps merged, later ones winning; null maps count as empty."""
    none = F.create_map().cast("map<string,string>")

    def both(early: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(early, lambda k, _: ~F.map_contains_key(later, k)), later)

    return reduce(both, (F.coalesce(m, none) for m in maps))


def map_get(m: Column, key: str, default: str) -> Column:
    """A map's value, the default where there is none."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def recategorised(articles: DataFrame, category: str) -> DataFrame:
    """Articles whose metadata.category is replaced, whatever was found."""
    return articles.withColumn("metadata", F.col("metadata").withField("category", F.lit(category)))


def author(name: Column, default: str = "[deleted]") -> Column:
    return F.coalesce(name, F.lit(default))


def post(df: DataFrame, site: str, source: str, scraped_at: Column) -> DataFrame:
    """Posts flattened: created_date from the epoch, the permalink with its site, source and time of the run; a missing author is named."""
    return df.withColumns({"created_date": from_epoch(F.col("created_utc")), "permalink": F.concat(F.lit(site), F.col("permalink")), "author": author(F.col("author")), "source": F.lit(source), "scraped_at": scraped_at})
