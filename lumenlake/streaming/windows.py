"""The windowed statistics over an unbounded stream of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(stream: DataFrame, time: str, value: str, keys: list[str], window: str, stride: str, late: str) -> DataFrame:
    """Count, mean and population deviation per key and hopping event-time window.

    Rows later than ``late`` are left out; state ends with the watermark. Works on batches as well.
    """
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window, stride).alias("w"), *keys)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
        .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std")
    )
