"""Interval joins. They meet in the cells of a dyadic index, so they are equi-joins that shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Unions touching intervals of a session; reasons are the sorted distinct ones, joined by +."""
    order = Window.partitionBy("session_id").orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("new", F.when(F.col("start_sec") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    return rows.groupBy("session_id", "island").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reason")
    ).drop("island")


def _cells(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Each interval in the cells of its level that it touches, three at most: ``_level`` and ``_cell``.

    Cells of level k are ``width * 2**k`` long, and an interval's level is the first whose cells are
    as long as itself.
    """
    rows = intervals.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0))))).cast("int"))
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
    first = F.floor(F.col(start) / size)
    return rows.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col(end) / size)))))


def _asked(points: DataFrame, at: str, indexed: DataFrame, width: float) -> DataFrame:
    """Each point with its cell at each level that ``indexed`` has: a few dozen levels, as lengths are doubles."""
    levels = indexed.agg(F.collect_set("_level").alias("_levels"))
    rows = points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")  # one row
    return rows.withColumn("_cell", F.floor(F.col(at) / (F.lit(width) * F.pow(F.lit(2.0), F.col("_level")))))


def stab_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Points of a session with the intervals that hold them: start <= t < end. Each such pair comes once.

    A dyadic index: an interval of any length is in three cells at most, and a point asks one cell of
    each level, so that what is shuffled does not grow with the lengths. ``width`` is the length of
    the finest cells. Null ends and times meet nothing.
    """
    indexed = _cells(intervals, start, end, width)
    met = _asked(points, at, indexed, width).join(indexed, ["session_id", "_level", "_cell"])
    return met.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_cell")


def overlap_join(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs of one session whose half-open ranges overlap; right's columns are ``r_start, r_end, ...``.

    Of two ranges that overlap one begins within the other: either left within right, or right
    within left and later. Both are found in a dyadic index, and each pair by one of them.
    """
    columns = [*left.columns, *[c for c in right.columns if c != "session_id"]]
    overlap = (F.col("start_sec") < F.col("r_end")) & (F.col("r_start") < F.col("end_sec"))
    earlier = stab_join(left, "start_sec", right, "r_start", "r_end", width)
    later = stab_join(right, "r_start", left, "start_sec", "end_sec", width).filter("r_start > start_sec")
    return earlier.filter(overlap).select(*columns).unionByName(later.filter(overlap).select(*columns))


def overlap_duration(windows: DataFrame, keys: list[str], intervals: DataFrame, width: float) -> DataFrame:
    """Seconds of each window that the merged intervals cover, at most its length."""
    merged = merge_intervals(intervals).select("session_id", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"))
    part = F.least("end_sec", "r_end") - F.greatest("start_sec", "r_start")
    found = overlap_join(windows, merged, width).groupBy(*keys).agg(F.sum(part).alias("covered"))
    return windows.join(found, keys, "left").withColumn("covered", F.least(F.coalesce("covered", F.lit(0.0)), F.col("end_sec") - F.col("start_sec")))


def overlap_reasons(windows: DataFrame, keys: list[str], intervals: DataFrame, width: float) -> DataFrame:
    """Sorted distinct non-empty reasons of the intervals that overlap each window."""
    raw = intervals.filter("reason <> ''").select("session_id", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"), "reason")
    found = overlap_join(windows, raw, width).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return windows.join(found, keys, "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def points_in_intervals(points: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Adds ``inside``: whether some interval has start <= t < end. Merged intervals hold a point once at most."""
    merged = merge_intervals(intervals).select("session_id", "start_sec", "end_sec")
    times = points.select("session_id", F.col("t_sec").alias("_t")).distinct()
    found = stab_join(times, "_t", merged, "start_sec", "end_sec", width).select("session_id", F.col("_t").alias("t_sec"), F.lit(True).alias("_hit"))
    return points.join(found, ["session_id", "t_sec"], "left").withColumn("inside", F.coalesce("_hit", F.lit(False))).select(*points.columns, "inside")


def align_by_midpoint(utterances: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """Each utterance with the first range that holds its midpoint."""
    mids = utterances.withColumn("mid", (F.col("start_sec") + F.col("end_sec")) / 2)
    return stab_join(mids, "mid", ranges, "r_start", "r_end", width).groupBy("session_id", "utterance_id").agg(F.min("segment_id").alias("segment_id"))


def align_by_overlap(utterances: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """Each utterance with the range it overlaps most; ties go to the smaller segment."""
    part = F.least("end_sec", "r_end") - F.greatest("start_sec", "r_start")
    rows = overlap_join(utterances, ranges, width).withColumn("overlap", part)
    best = F.row_number().over(Window.partitionBy("session_id", "utterance_id").orderBy(F.desc("overlap"), "segment_id"))
    return rows.withColumn("n", best).filter("n = 1").select("session_id", "utterance_id", "segment_id", "overlap")
