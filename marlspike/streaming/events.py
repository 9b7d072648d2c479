"""Structured Streaming over event and document streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A directory of parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums a window and key; events later than the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id") -> DataFrame:
    """(user, start, end, n) of each user's sessions, parted by gaps."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """Each key once, as it is first met; with `late` keys are forgotten after the watermark."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def cooldown(alerts: DataFrame, key: str, tick: str, ticks: int) -> DataFrame:
    """(key, tick) of alerts that are emitted: state is the last tick emitted for the key."""
    kind = alerts.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b[tick]):
            if last is None or t - last >= ticks:
                last = int(t)
                out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), tick: out})

    return alerts.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {tick} long", "last long", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feeds micro-batches to a function until the source is drained; a failed batch runs again as a whole."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
