"""Statistical series: unpivot, indentation hierarchy, null tokens, header drift, changes over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.dates import period
from sedimenta.functions.text import number

#: Headers as found and as meant.
HEADERS = {"shs": "shs_year", "old_age_depndency_ratio": "old_age_dependency_ratio"}


def renamed(df: DataFrame, headers: dict[str, str] = HEADERS) -> DataFrame:
    return df.withColumnsRenamed(headers)


def measure(text: Column, kind: str = "double") -> Column:
    """A measure: na is null, thousands separators are dropped."""
    return number(F.nullif(F.trim(text), F.lit("na")), kind)


def unpivoted(df: DataFrame, key: str) -> DataFrame:
    """(key, period text, first_day, value) from a column for each period."""
    columns = [c for c in df.columns if c != key and c != "row_no"]
    ids = [c for c in df.columns if c in (key, "row_no")]
    long = df.unpivot(ids, [F.col(f"`{c}`").cast("string").alias(c) for c in columns], "period", "value")
    return long.withColumns({"first_day": period(F.col("period")), "value": measure(F.col("value"))})


def hierarchy(df: DataFrame, key: str, order: str, step: int = 4, file: str | None = None) -> DataFrame:
    """Adds level, name and parent (the last name one level up), from leading spaces and the order inside a file, to any depth.

    Without file, the rows are one file. Only the deepest level reaches the driver.
    """
    out = df.withColumn("level", F.floor((F.length(key) - F.length(F.ltrim(F.col(key)))) / step).cast("int")).withColumn("name", F.trim(F.col(key)))
    above = (W.partitionBy(file) if file else W.partitionBy(F.lit(0))).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parents = [F.when(F.col("level") == level + 1, F.last(F.when(F.col("level") == level, F.col("name")), ignorenulls=True).over(above)) for level in range(out.agg(F.max("level")).first()[0] or 0)]
    return out.withColumn("parent", F.coalesce(*parents, F.lit(None).cast("string")))


def detail(df: DataFrame, dim: str) -> DataFrame:
    """Without subtotal rows."""
    return df.where(~F.col(dim).rlike("^(All |Total)"))


def changes(df: DataFrame, dims: list[str], order: str, value: str, lag: int = 1) -> DataFrame:
    """Adds change: the relative change from lag periods before."""
    before = F.lag(value, lag).over(W.partitionBy(*dims).orderBy(order))
    return df.withColumn("change", F.try_divide(F.col(value) - before, before))


def distinct_files(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Of files with equal bytes, the one whose path comes first."""
    return df.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(path).alias(path))


def summary(df: DataFrame, dims: list[str], order: str, value: str) -> DataFrame:
    """Average and last value (by order) of each combination of dims."""
    return df.groupBy(*dims).agg(F.avg(value).alias("average"), F.max_by(value, order).alias("last"))
