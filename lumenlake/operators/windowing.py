"""Hopping windows and the ids, segments and ranges built on them.

Sessions are the partition key everywhere; windows are half-open and times are session seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def make_windows(sessions: DataFrame, window: float, stride: float, min_tail: float) -> DataFrame:
    """``session_id, duration`` to ``session_id, window_index, start_sec, end_sec``.

    The end is clipped to the duration; windows stop at the first tail shorter than ``min_tail``.
    """
    last = F.floor((F.col("duration") - min_tail + EPS) / stride)
    rows = sessions.filter((F.col("duration") > 0) & (last >= 0))
    rows = rows.select("session_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window_index"))
    start = F.col("window_index") * F.lit(float(stride))
    return rows.filter(start < F.col("duration")).select(
        "session_id", "window_index", start.alias("start_sec"), F.least(start + window, F.col("duration")).alias("end_sec")
    )


def assign_windows(samples: DataFrame, windows: DataFrame, window: float, stride: float) -> DataFrame:
    """Each sample with each window that holds its ``t_sec``: an equi-join on computed indices."""
    first = F.greatest(F.floor((F.col("t_sec") - window) / stride), F.lit(0))
    last = F.floor(F.col("t_sec") / stride)
    rows = samples.filter("t_sec >= 0").withColumn("window_index", F.explode(F.sequence(first, last)))
    joined = rows.join(windows, ["session_id", "window_index"])
    return joined.filter((F.col("t_sec") >= F.col("start_sec")) & (F.col("t_sec") < F.col("end_sec")))


def sampling_rate(samples: DataFrame, keys: list[str], fallback: float) -> DataFrame:
    """One over the median step above a microsecond; the fallback below three samples."""
    w = Window.partitionBy(*keys).orderBy("t_sec")
    step = F.col("t_sec") - F.lag("t_sec").over(w)
    return samples.select(*keys, "t_sec", step.alias("step")).groupBy(*keys).agg(
        F.when(F.count("t_sec") < 3, F.lit(float(fallback))).otherwise(F.coalesce(1 / F.median(F.when(F.col("step") > 1e-6, F.col("step"))), F.lit(float(fallback)))).alias("rate")
    )


def atomic_ids(units: DataFrame) -> DataFrame:
    """Units that share rounded bounds get one id ``E0000`` in order of their bounds."""
    key = units.withColumns({"a": F.round("start_sec", 6), "b": F.round("end_sec", 6)})
    n = F.dense_rank().over(Window.partitionBy("session_id").orderBy("a", "b")) - 1
    return key.withColumn("atomic_id", F.format_string("E%04d", n)).drop("a", "b")


def segments(atomic: DataFrame, segment: float, most: int) -> DataFrame:
    """Buckets atomic windows by midpoint into at most ``most`` segments of a multiple of ``segment``."""
    w = Window.partitionBy("session_id")
    natural = F.ceil(F.max("end_sec").over(w) / segment)
    width = F.greatest(F.ceil(natural / most), F.lit(1)) * segment
    rows = atomic.withColumn("width", width).withColumn("bucket", F.floor((F.col("start_sec") + F.col("end_sec")) / 2 / F.col("width")))
    n = F.dense_rank().over(w.orderBy("bucket")) - 1
    return rows.withColumn("segment_id", F.format_string("S%03d", n)).drop("width", "bucket")


def segment_ranges(segmented: DataFrame) -> DataFrame:
    """Ranges that tile the session: neighbours meet midway between their nearest atomic midpoints."""
    mid = (F.col("start_sec") + F.col("end_sec")) / 2
    own = segmented.groupBy("session_id", "segment_id").agg(F.min(mid).alias("lo"), F.max(mid).alias("hi"), F.min("start_sec").alias("a"), F.max("end_sec").alias("b"))
    w = Window.partitionBy("session_id").orderBy("lo", "segment_id")
    return own.select(
        "session_id", "segment_id",
        F.coalesce((F.lag("hi").over(w) + F.col("lo")) / 2, F.col("a")).alias("start_sec"),
        F.coalesce((F.lead("lo").over(w) + F.col("hi")) / 2, F.col("b")).alias("end_sec"),
    )


def format_time(seconds: Column) -> Column:
    """``MM:SS.mmm``, with hours in front where there are any."""
    ms = F.bround(seconds * 1000).cast("long")
    h, m, s = F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    short = F.format_string("%02d:%02d.%03d", m, s, ms % 1000)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), short)).otherwise(short)
