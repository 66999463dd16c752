"""Writers: JSON lines with explicit nulls, fan-out by column, envelopes, statistics; empty frames are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, run_id: str | None = None, gzip: bool = False, by: list[str] | None = None) -> bool:
    """Append under run=run_id, or overwrite; False if there was nothing to write."""
    if df.isEmpty():
        return False
    w = df.write.mode("append" if run_id else "overwrite").option("ignoreNullFields", False)
    w = w.option("compression", "gzip") if gzip else w
    w = w.partitionBy(*by) if by else w
    w.json(f"{path}/run={run_id}" if run_id else path)
    return True


def fan_out(df: DataFrame, path: str, bucket: str) -> bool:
    """A folder for each bucket."""
    return json_lines(df, path, by=[bucket])


def combined_and_parts(df: DataFrame, path: str, bucket: str) -> None:
    df = df.persist()
    json_lines(df, f"{path}/all")
    fan_out(df, f"{path}/by_{bucket}", bucket)
    df.unpersist()


def json_array(df: DataFrame, most: int = 100_000) -> DataFrame:
    """One row with all rows as a JSON array; for results of up to most rows, an error for larger ones."""
    few = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("*")).alias("rows"))
    return few.select(F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} rows for one JSON array"))).otherwise(F.to_json("rows")).alias("value"))


def batched(df: DataFrame, path: str, source: str, day: str, batches: int) -> bool:
    """One folder for each batch, named {source}_{date}_{batch}; rows are dealt by a hash of all of them, so a rerun deals alike."""
    batch = F.format_string(f"{source}_{day}_%03d", F.pmod(F.xxhash64(*df.columns), F.lit(batches)).cast("int"))
    return json_lines(df.withColumn("batch", batch), path, by=["batch"])


def run_names(prefix: str, stamp: str) -> dict[str, str]:
    """The three ways to name output by the stamp of a run (yyyymmdd_hhmmss): kept apart by run, replaced daily, always replaced."""
    return {"run": f"{prefix}_{stamp}", "daily": f"{prefix}_{stamp[:8]}", "fixed": f"{prefix}_stats"}


def envelope(df: DataFrame, path: str, manifest: DataFrame) -> None:
    """Records, and beside them what is known about the run."""
    json_lines(df, f"{path}/articles")
    json_lines(manifest, f"{path}/scraping_metadata")


def statistics(df: DataFrame, path: str, key: str, text: str = "text") -> DataFrame:
    """Write counts and text lengths by key and in total, replacing what was there; returns what was written."""
    stats = df.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(text)).alias("avg_length"), F.sum(F.length(text)).alias("total_length"))
    stats.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return df.sparkSession.read.schema(stats.schema).json(path)


def report(df: DataFrame, rows: int = 20) -> None:
    """Print the first rows of a summary."""
    df.show(rows, truncate=False)
