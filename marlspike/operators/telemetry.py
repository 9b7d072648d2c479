"""Telemetry over event tables: statistics, thresholds, first sightings and alert cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sensor_stats(events: DataFrame, key: str = "event_type", value: str = "value", limit: int = 20) -> DataFrame:
    """(sensor, n, lo, hi, mean) by the key up to its first underscore."""
    name = F.substring_index(F.col(key), "_", 1).alias("sensor")
    out = events.groupBy(name).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.round(F.avg(value), 2).alias("mean"))
    return out.orderBy("sensor").limit(limit)


def threshold_alerts(events: DataFrame, thresholds: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Events below the lower or above the upper limit of their key; a null limit does not bind.

    The limits are a catalogue, one row a key; Spark broadcasts it while it is below its size threshold.
    """
    t = thresholds.select(F.col(key), "lo", "hi")
    return events.join(t, key).where((F.col("lo").isNotNull() & (F.col(value) < F.col("lo"))) | (F.col("hi").isNotNull() & (F.col(value) > F.col("hi"))))


def first_seen(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def cooled(ticks: list[int], cooldown: int) -> Iterator[int]:
    """Positions of the ticks that are emitted: the first, then each at least `cooldown` after the last emitted."""
    last = None
    for i, t in enumerate(ticks):
        if last is None or t - last >= cooldown:
            last = t
            yield i


def alert_cooldown(alerts: DataFrame, key: str, tick: str, event_id: str, cooldown: int) -> DataFrame:
    """The alerts that are emitted: after one, others of its key are held back until `cooldown` ticks have passed.

    What counts is the last alert emitted, so a window function cannot tell. Keys and ticks stream through in
    order, one batch at a time; no key is held in memory as a whole.
    """
    rows = alerts.repartition(F.col(key)).sortWithinPartitions(key, tick, event_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch[tick]):
                emit = k != at or t - last >= cooldown
                keep.append(emit)
                if emit:
                    at, last = k, t
            yield batch[keep]

    return rows.mapInPandas(run, alerts.schema)
