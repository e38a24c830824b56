"""Upkeep of the hourly price table as new rows land.

Backfill may replace live rows of any age, so no row is ever final and a
watermark would drop rows that still count. Each micro-batch finds the target
dates it touches and rebuilds those partitions from the landed rows of these
dates. Raw rows lie in a folder per target date, so no other is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirmark.plans.facts import hourly_prices, rebuild


def refresh_touched(batch: DataFrame, all_rows: DataFrame, path: str, build: Callable[[DataFrame], DataFrame] = hourly_prices, partition: str = "target_date") -> None:
    """Replaces the partitions of the batch's dates. Those are days of a calendar, so their list is short whatever the batch."""
    touched = [r[0] for r in batch.select(partition).where(F.col(partition).isNotNull()).distinct().collect()]
    if touched:
        rebuild(build(all_rows.where(F.col(partition).isin(touched))), path, (partition,))


def land(rows: DataFrame, raw_path: str, partition: str = "target_date") -> None:
    """Appends raw rows, a folder per date; AQE splits a date that is large."""
    rows.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(raw_path)


def maintain(stream: DataFrame, raw_path: str, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = hourly_prices) -> StreamingQuery:
    """``stream`` reads the Parquet rows under ``raw_path``, as ``land`` lays them; the table under ``path`` follows it."""

    def step(batch: DataFrame, _: int) -> None:
        everything = batch.sparkSession.read.schema(batch.schema).parquet(raw_path)
        refresh_touched(batch, everything, path, build)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
