"""Crawling as a fixpoint: links found in the pages fetched so far lead to pages not seen before, round by round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import html as h
from sedimenta.session import checkpointed


def links_of(pages: DataFrame, page: str, base: str, html: str = "html", name=None, keep=None) -> DataFrame:
    """(page, target): the links found in each page, made absolute on its address, each once.

    name turns an absolute address into the name under which pages are known (default: without its fragment); keep is a
    test on the absolute address. Links without a name go.
    """
    name = name or (lambda url: F.regexp_replace(url, "#.*$", ""))
    url = h.absolute(F.col("_href"), F.col("_base"))
    found = pages.select(F.col(page).alias("page"), F.col(base).alias("_base"), F.explode(F.array_distinct(F.transform(h.anchors(F.col(html)), lambda a: a["href"]))).alias("_href"))
    found = found.withColumn("_url", url)
    found = found.where(keep(F.col("_url"))) if keep else found
    return found.select("page", name(F.col("_url")).alias("target")).where("target <> ''").distinct()


def known_pages(pages: DataFrame, page: str, name: Column) -> DataFrame:
    """(target, page): the page known by each name; of several the least."""
    return pages.select(name.alias("target"), F.col(page).alias("page")).where("target <> ''").groupBy("target").agg(F.min("page").alias("page"))


def crawl(seeds: DataFrame, links: DataFrame, known: DataFrame, most_depth: int = 10) -> DataFrame:
    """(page, depth): seeds (page) and every page that links lead to from them, with the least number of links.

    A round joins the pages of the last depth with their links and these with the known pages, and keeps those not seen
    before; it ends when there are none or at most_depth. Links to nowhere, to the page itself and circles do no harm.
    Duplicates are taken out before each join, so a page that all others link to moves once for each partition. Only
    whether a round found anything reaches the driver.
    """
    edges = checkpointed(links.join(known.withColumnRenamed("page", "to"), "target").where("page <> to").select("page", "to").distinct())
    seen = fresh = checkpointed(seeds.select("page").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most_depth + 1):
        reached = edges.join(fresh.select("page"), "page", "left_semi").select(F.col("to").alias("page")).distinct()
        fresh = checkpointed(reached.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def listing(sizes: DataFrame, section: str, page: str, count: str, target: int) -> DataFrame:
    """Pages of each section up to the first empty one, while fewer than target rows were gathered before; sections are independent.

    A page is judged by sums over ranges of pages of its section, so no task needs a whole section.
    """
    from sedimenta.operators.grouped import running

    rows = running(sizes, [section], page, {"_before": F.col(count), "_empty": (F.col(count) == 0).cast("long")})
    return rows.where((F.col("_before") < target) & (F.col("_empty") == 0) & (F.col(count) > 0)).drop("_before", "_empty")
