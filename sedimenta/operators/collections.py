"""Operators on whole collections: dedup, prefix limits, early stops, nesting, unions and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_value_first_place(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key: its last row by seq, and place, the seq of its first. Ties go to the larger row."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(seq, *[F.col(c) for c in rest if c != seq])).alias("last"), F.min(seq).alias("place"))
    return best.select(key, *[F.col(f"last.{c}").alias(c) for c in rest], "place")


def first_value(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key: its first by seq. Ties go to the smaller row."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(seq, *[F.col(c) for c in rest if c != seq])).alias("first"))
    return best.select(*[F.col(key) if c == key else F.col(f"first.{c}").alias(c) for c in df.columns])


def limit_then_filter(df: DataFrame, group: list[str], seq: str, n: int, test: Column) -> DataFrame:
    """The first n rows of each group that pass; rows beyond n never get in."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(seq))).where(F.col("_rn") <= n).where(test).drop("_rn")


def filter_then_limit(df: DataFrame, group: list[str], seq: str, n: int | Column, test: Column) -> DataFrame:
    rows = df.where(test).withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(seq)))
    return rows.where(F.col("_rn") <= n).drop("_rn")


def until_empty(df: DataFrame, group: str, page: str, size: str) -> DataFrame:
    """Pages before a group's first empty one."""
    stop = F.min(F.when(F.col(size) == 0, F.col(page))).over(W.partitionBy(group))
    return df.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")


def place(df: DataFrame, seq: str, name: str = "place") -> DataFrame:
    """Adds each row's place by seq (a number or time) in the whole list, from 1.

    Approximate quantiles cut the list into ranges, a place is the row's place in its range and the rows of the ranges
    before; so no task holds the list, unless most rows have the same seq. Only the quantiles reach the driver. Rows with
    equal seq have places in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(seq, [i / n for i in range(1, n)] or [0.5], 1000).alias("b")).first().b or []
    kind = df.schema[seq].dataType
    part = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b < F.col(seq))) if bounds else F.lit(0)
    dealt = df.withColumn("_part", part)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    turn = F.row_number().over(W.partitionBy("_part").orderBy(seq))
    return dealt.withColumn(name, turn).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def numbered(df: DataFrame, seq: str, year: Column, prefix: str) -> DataFrame:
    """release_id PREFIX_year_nnn by place in the whole list."""
    return place(df, seq, "_place").withColumn("release_id", F.format_string(f"{prefix}_%d_%03d", year, F.col("_place"))).drop("_place")


def until_target(sections: DataFrame, more: DataFrame, section: str, order: str, target: int) -> DataFrame:
    """Sections are taken whole until target rows are there, more only if they are short; then the first target rows.

    Adds part (0 or 1) and needs a number of sections that one task can list.
    """
    sizes = sections.groupBy(section).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col(section).alias("_s"), (F.sum("_n").over(W.orderBy(section)) - F.col("_n")).alias("_before"))
    taken = sections.join(before, sections[section] == before["_s"]).where(F.col("_before") < target).drop("_s", "_before")
    all_ = sections.agg(F.count(F.lit(1)).alias("_all")).scalar()
    every = taken.withColumn("part", F.lit(0)).unionByName(more.where(all_ < target).withColumn("part", F.lit(1)))
    return every.orderBy("part", section, order).limit(target)


def nest(children: DataFrame, parent: str, order: str, fields: list[str], most: int, keep=None) -> DataFrame:
    """(parent, children): the first most children by order, then those that pass keep. No more than most are gathered for a parent."""
    turn = F.row_number().over(W.partitionBy(parent).orderBy(order, *fields))
    first = children.withColumn("_turn", turn).where(F.col("_turn") <= most)
    first = first.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("children"))
    return first.withColumn("children", F.filter("children", keep)) if keep else first


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def counts(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Rows of each key; a missing key counts as unknown."""
    return df.groupBy(F.coalesce(key, F.lit("unknown")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def array_counts(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """In how many rows each distinct item occurs."""
    return df.select(F.explode(F.array_distinct(items)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def with_total(df: DataFrame, key: str) -> DataFrame:
    """Counts by key and, under a null key, their total."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("n"))


def follow_links(links: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Links joined with the fetched pages they name, each address once."""
    return links.dropDuplicates([url]).join(pages, url)


def merged(*layers: Column) -> Column:
    """Merge of field values where later layers win: the last that is not null."""
    return F.coalesce(*reversed(layers))
