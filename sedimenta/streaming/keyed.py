"""Keyed dedup across runs: the last value of each key and the place where it first came, kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sedimenta.session import send_code

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LastValueFirstPlace(StatefulProcessor):
    """For each key the row with the largest seq and the smallest seq; a row of output whenever either changes.

    Rows may come in any order and more than once. A key that had no rows for idle_ms of event time is given out once
    more, as final, and forgotten; a later row begins it anew.
    """

    def __init__(self, key: str, kind: str, idle_ms: int | None = None):
        self.key, self.kind, self.idle_ms = key, kind, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("best", f"last long, value {self.kind}, place long, seen long, timer long")

    def _row(self, key, best, final: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "seq": [best[0]], "value": [best[1]], "place": [best[2]], "final": [final]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        best = list(before) if before else None
        for part in rows:
            at = part["seq"].idxmax()
            own = [int(part["seq"].max()), part["value"][at], int(part["seq"].min()), int(part["at"].max().timestamp() * 1000)]
            own[1] = None if pd.isna(own[1]) else own[1].item() if hasattr(own[1], "item") else own[1]
            if best is None:
                best = [*own, -1]
            else:
                if own[0] > best[0]:
                    best[0], best[1] = own[0], own[1]
                best[2], best[3] = min(best[2], own[2]), max(best[3], own[3])
        if self.idle_ms is not None and best[4] != best[3] + self.idle_ms:
            if best[4] >= 0:
                self.handle.deleteTimer(best[4])
            best[4] = best[3] + self.idle_ms
            self.handle.registerTimer(best[4])
        if before is None or list(before) != best:
            self.state.update(tuple(best))
        if before is None or tuple(before[:3]) != tuple(best[:3]):
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            best = self.state.get()
            self.state.clear()
            yield self._row(key, best, True)

    def close(self) -> None:
        pass


def last_values(stream: DataFrame, key: str, seq: str, value: str, at: str, idle: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(key, seq, value, place, final): updates of the last value and first place of each key of a stream.

    at is the event time; rows older than the watermark (delay behind the latest) are late and dropped if keys are
    forgotten when idle (an interval such as "3 days"); without idle nothing is late and state is kept for ever. A null key is a
    key of its own. Needs the state store set by state_store().
    """
    spark = stream.sparkSession
    send_code(spark)
    kind = stream.schema[value].dataType.simpleString()
    rows = stream.select(F.col(key).alias(key), F.col(seq).cast("long").alias("seq"), F.col(value).alias("value"), F.col(at).cast("timestamp").alias("at"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = rows.withWatermark("at", delay) if idle else rows
    schema = T.StructType([stream.schema[key], T.StructField("seq", T.LongType()), T.StructField("value", stream.schema[value].dataType), T.StructField("place", T.LongType()), T.StructField("final", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(LastValueFirstPlace(key, kind, idle_ms), schema, "update", "EventTime" if idle else "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run_available(updates: DataFrame, folder: str) -> DataFrame:
    """Run a stream of updates over what is there, and return all of them with batch, the number of the run's batch.

    Every batch overwrites its own folder, so a batch that is repeated after a failure counts once. A later call with the same
    folder goes on where this one ended.
    """

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    with state_store(updates.sparkSession):
        query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()
    schema = T.StructType([*updates.schema.fields, T.StructField("batch", T.LongType())])
    return updates.sparkSession.read.schema(schema).parquet(f"{folder}/updates")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key that was not forgotten."""
    best = updates.groupBy(key).agg(F.max_by(F.struct("seq", "value", "place", "final"), F.struct("batch", F.col("final"))).alias("x"))
    return best.select(key, "x.*").where("not final").drop("final")
