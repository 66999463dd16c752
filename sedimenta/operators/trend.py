"""Trends of a grouped series: a calendar without gaps, as-of filling, sliding windows and slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units of the calendar and the interval between their starts.
UNITS = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def periods(df: DataFrame, dims: list[str], at: str, unit: str = "month", measures: dict | None = None) -> DataFrame:
    """(dims, period, n, measures) for every period from the first to the last of all rows and every combination of dims that occurs.

    n is 0 and measures are null where there are no rows. Rows without a time count nowhere. The rows of a combination
    are aggregated before they are exchanged; its calendar is made from two dates, which reach the driver.
    """
    rows = df.where(F.col(at).isNotNull()).withColumn("period", F.date_trunc(unit, at).cast("date"))
    sums = rows.groupBy(*dims, "period").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (measures or {}).items()])
    first = rows.agg(F.min("period").alias("a"), F.max("period").alias("b")).first()
    if first.a is None:
        return sums
    calendar = F.sequence(F.lit(first.a), F.lit(first.b), F.expr(f"interval {UNITS[unit]}"))
    spine = rows.select(*dims).distinct().withColumn("period", F.explode(calendar))
    own, on = sums.withColumnsRenamed({c: f"_{c}" for c in [*dims, "period"]}), F.lit(True)
    for c in [*dims, "period"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return spine.join(own, on, "left").select(*dims, "period", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *(measures or {}))


def filled(df: DataFrame, dims: list[str], value: str, name: str = "filled", order: str = "period") -> DataFrame:
    """Adds the last value known at each period; null before the first."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*dims).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def sliding(df: DataFrame, dims: list[str], value: str, width: int, name: str = "sliding", order: str = "period") -> DataFrame:
    """Adds the mean over the last width periods, this one included; fewer at the start."""
    return df.withColumn(name, F.avg(value).over(W.partitionBy(*dims).orderBy(order).rowsBetween(1 - width, 0)))


def slopes(df: DataFrame, dims: list[str], value: str, unit: str = "month", order: str = "period") -> DataFrame:
    """(dims, slope, periods): the least-squares slope of the value by number of periods; null for a single period.

    Months and longer units count by the calendar, so every step is one. Partial sums are exchanged, no rows.
    """
    months = F.year(order) * 12 + F.month(order)
    x = {"day": F.unix_date(order), "week": F.unix_date(order) / 7, "month": months, "quarter": months / 3, "year": F.year(order)}[unit]
    return df.groupBy(*dims).agg(F.regr_slope(F.col(value).cast("double"), x.cast("double")).alias("slope"), F.count(F.lit(1)).alias("periods"))
