"""The event log as a stream: sequence numbers, latest state and windows, equal to their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder, so many a trigger; its checkpoint is the reader's cursor."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and type, with a watermark for late events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def numbered(events: DataFrame) -> DataFrame:
    """(user_id, event_id, n): each user's events numbered in order of arrival; within a trigger by time, then id. The
    state is one counter a user."""

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        state.update((last + len(rows),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "n": range(last + 1, last + 1 + len(rows))})

    return events.groupBy("user_id").applyInPandasWithState(number, "user_id bigint, event_id bigint, n bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream until its source is read and return what it wrote; for tests and backfills."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def until_terminal(events: DataFrame, terminal: str) -> DataFrame:
    """Batch twin of a tail that stops at the first terminal event of each user, the event itself included."""
    stop = events.where(F.col("event_type") == terminal).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("stop"))
    joined = events.join(stop, "user_id", "left")
    return joined.where(F.col("stop").isNull() | (F.struct("ts", "event_id") <= F.col("stop"))).drop("stop")
