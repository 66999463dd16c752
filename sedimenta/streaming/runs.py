"""Repeated runs append files; as a stream each record is passed on once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_records(spark: SparkSession, folder: str, schema: str, key: str = "id", delay: str = "30 days", per_trigger: int = 100) -> DataFrame:
    """Records of a growing folder of JSON lines, the first of each key within the delay."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)
    stamped = rows.withColumn("event_time", F.try_to_timestamp(F.regexp_replace("timestamp", r"(Z|\+08:00)$", "")))
    return stamped.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
