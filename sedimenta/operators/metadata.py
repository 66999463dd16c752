"""Open metadata bags as VARIANT: fields by path and type, absent keys told from explicit nulls, and what keys there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(json: Column) -> Column:
    """The text as a variant; null if it is no JSON."""
    return F.try_parse_json(json)


def field(of: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]) as a type; null if it is absent, null or of another type."""
    return F.try_variant_get(of, path, kind)


def presence(of: Column, path: str) -> Column:
    """absent, null or value; null for a null bag."""
    own = F.try_variant_get(of, path, "variant")
    return F.when(of.isNull(), F.lit(None)).when(own.isNull(), "absent").when(F.is_variant_null(own), "null").otherwise("value")


def kind_of(value: Column) -> Column:
    """null, number, string, boolean, array, object or another type's name, of a variant."""
    s = F.schema_of_variant(value)
    return (
        F.when(s == "VOID", "null").when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise(F.lower(s))
    )


def fields_of(df: DataFrame, of: str) -> DataFrame:
    """A row for each key at the top of each bag: the columns of df, key, value (a variant) and kind."""
    keys = df.sparkSession.tvf.variant_explode(F.col(of).outer())
    return df.lateralJoin(keys).drop("pos").withColumn("kind", kind_of(F.col("value")))


def key_types(df: DataFrame, of: str) -> DataFrame:
    """(key, kind, n): how many bags hold a key with a value of a kind."""
    return fields_of(df.select(of), of).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


def schema_of(df: DataFrame, of: str) -> DataFrame:
    """One row: the schema that all bags together have, merged map-side."""
    return df.agg(F.schema_of_variant_agg(of).alias("schema"))


def typed(df: DataFrame, of: str, fields: dict[str, str], name: str = "metadata", extra: str = "extra") -> DataFrame:
    """The declared fields of a bag as a struct, and the keys that are not declared as a map of their JSON texts."""
    known = F.struct(*[field(F.col(of), f"$.{k}", kind).alias(k) for k, kind in fields.items()])
    every = F.try_variant_get(F.col(of), "$", "map<string,variant>")
    rest = F.transform_values(F.map_filter(every, lambda k, v: ~k.isin(*fields)), lambda k, v: F.to_json(v))
    return df.withColumns({name: F.when(F.col(of).isNotNull(), known), extra: rest})
