"""Bad records set apart in one pass: every record gets the first rule it breaks, good and bad ones go to their own folders, counters come along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Isolated:
    """What a run wrote: good records with their own columns, bad ones with error too, and how many broke each rule first."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def first_error(rules: dict[str, Column]) -> Column:
    """The name of the first rule that fails; null if none does. A rule that is null fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit(None).cast("string"))


def error_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(error, n) for each rule that fails first somewhere, ok for good records, and the total under a null error."""
    return df.select(F.coalesce(first_error(rules), F.lit("ok")).alias("error")).rollup("error").agg(F.count(F.lit(1)).alias("n"))


def isolate(df: DataFrame, path: str, rules: dict[str, Column], mode: str = "errorifexists") -> Isolated:
    """Write the records of df under path, by outcome, in one pass over the input; the counters are observed on the way.

    An empty input leaves no good and no bad records. Columns named error and outcome are not allowed, as they are written.
    """
    clash = {"error", "outcome"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    seen = Observation()
    rows = df.withColumn("error", first_error(rules)).withColumn("outcome", F.when(F.col("error").isNull(), "good").otherwise("bad"))
    each = [F.count_if(F.col("error") == name).alias(name) for name in rules]
    rows.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"), *each).write.mode(mode).partitionBy("outcome").parquet(path)
    back = df.sparkSession.read.schema(rows.schema).parquet(path)
    return Isolated(back.where("outcome = 'good'").select(*df.columns), back.where("outcome = 'bad'").drop("outcome"), seen.get)


def lines(df: DataFrame, column: str, schema: str, name: str = "record") -> tuple[DataFrame, dict[str, Column]]:
    """JSON text parsed by a schema, and rules for what can be wrong with it: no text, no JSON, a field of another type.

    Fields that don't fit become null in the record; the rules tell them from fields that are null or absent.
    """
    bag = F.try_parse_json(column)
    parsed = df.withColumn(name, F.from_json(F.when(bag.isNotNull(), F.col(column)), schema, {"mode": "PERMISSIVE"}))
    rules = {"empty": F.col(column).isNotNull(), "corrupt": bag.isNotNull()}
    for field in parsed.schema[name].dataType.fields:
        own = F.try_variant_get(bag, f"$.{field.name}", "variant")
        rules[f"type_{field.name}"] = own.isNull() | F.is_variant_null(own) | F.try_variant_get(bag, f"$.{field.name}", field.dataType.simpleString()).isNotNull()
    return parsed, rules
