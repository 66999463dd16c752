"""Running sums and numbers inside groups of any size: rows are dealt by ranges of (group, order), so a hot group is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.session import checkpointed


def running(df: DataFrame, group: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of the values of the rows before in the group; 0 at its start.

    Two levels: each range partition adds up its own rows, then what earlier partitions hold of the group is added. Only
    the first group of a partition can have begun in an earlier one, so there are no more of these sums than partitions and
    they are broadcast. Rows with equal group and order stay in one partition, in any order; null values count as 0.
    """
    names = list(sums)
    values = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    dealt = df.withColumns(values).repartitionByRange(*group, order).withColumn("_pid", F.spark_partition_id())
    dealt = checkpointed(dealt)  # bounds of ranges are drawn anew whenever they are computed
    totals = dealt.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.withColumns({f"_b{v}": F.sum(f"_t{v}").over(before) for v in values}).where(F.col(f"_b{next(iter(values))}").isNotNull())
    carried = carried.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[f"_b{v}" for v in values])
    own = W.partitionBy("_pid", *group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumns({f"_o{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values})
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = rows.join(F.broadcast(carried), same, "left")
    added = {n: F.col(f"_o{v}") + F.coalesce(F.col(f"_b{v}"), F.lit(0)) for n, v in zip(names, values, strict=True)}
    return rows.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def numbered_in(df: DataFrame, group: list[str], order: str, name: str = "turn", start: int = 1) -> DataFrame:
    """Adds each row's number in its group by order."""
    return running(df, group, order, {name: F.lit(1)}).withColumn(name, F.col(name) + start)


def until_enough(df: DataFrame, group: str, seq: str, size: str, target: int) -> DataFrame:
    """Rows (threads) while fewer than target were gathered before them in the group; the last may overshoot."""
    return running(df, [group], seq, {"_before": F.col(size)}).where(F.col("_before") < target).drop("_before")


def weighted_limit(df: DataFrame, group: str, seq: str, weights: dict[str, float], budget: int = 20) -> DataFrame:
    """floor(budget x weight) rows of each group; a group without a weight gets none.

    The largest limit is a constant, so every task sends on no more rows of a group than that.
    """
    most = {k: int(budget * w) for k, w in weights.items()}
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col(group))
    turn = F.row_number().over(W.partitionBy(group).orderBy(seq))
    first = df.where(F.col(group).isin(*most)).withColumn("_rn", turn).where(F.col("_rn") <= max(most.values()))
    return first.where(F.col("_rn") <= own).drop("_rn")
