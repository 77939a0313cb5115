"""Aggregates of measured values by window, session or frame group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def iqr(c: Column) -> Column:
    return F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))


def expected_count(duration: Column, rate: Column) -> Column:
    return F.greatest(F.lit(1.0), F.bround(duration * rate))


def quality_level(ratio: Column, unavailable: Column) -> Column:
    return F.when(unavailable, "unavailable").when(F.isnan(ratio) | (ratio < 0.3), "low_quality").when(ratio < 0.8, "partial").otherwise("good")


def availability(ratio: Column, reasons: Column) -> Column:
    """Status and reasons: none valid, partial, or present without reasons."""
    own = F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())))
    status = F.when(ratio <= 0, "unavailable").when((ratio < 0.8) | (F.size(own) > 0), "partial").otherwise("present")
    named = F.when((ratio <= 0) & (F.size(own) == 0), F.array(F.lit("no_valid_measurements"))).when(status == "present", F.array().cast("array<string>")).otherwise(own)
    return F.struct(status.alias("status"), named.alias("reasons"))


def session_stats(values: DataFrame, keys: list[str], value: str = "value", time: str = "t_sec") -> DataFrame:
    """Count, mean, population deviation, median, deciles, range and the slope over time."""
    v, t = F.col(value), F.col(time)
    rows = values.filter(finite(value))
    slope = F.when((F.count(v) >= 2) & (F.max(t) > F.min(t)), F.regr_slope(v, t)).otherwise(F.lit(0.0))
    own = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"), slope.alias("slope"),
    )
    q = lambda i: F.col("_q")[i]
    return own.select(*keys, "n", "mean", "std", q(1).alias("median"), q(0).alias("q10"), q(2).alias("q90"), "lowest", "highest", "slope")


def consecutive_change(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Median over neighbouring row indices of |difference| / sqrt(length); ``features`` are arrays."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    rows = frames.withColumns({"last": F.lag("features").over(w), "gap": F.col("row_idx") - F.lag("row_idx").over(w)}).filter("gap = 1")
    step = F.expr("sqrt(aggregate(zip_with(features, last, (a, b) -> pow(cast(a as double) - b, 2)), 0D, (s, x) -> s + x) / size(features))")
    return rows.withColumn("step", step).filter(finite("step")).groupBy(*keys).agg(F.median("step").alias("change"), F.count("*").alias("pairs"))


def dispersion(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Median over points (x, y pairs of ``features``) of the root of the summed variances."""
    points = frames.select(*keys, F.posexplode("features").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    per = points.groupBy(*keys, F.expr("i div 2").alias("point"), F.expr("i % 2").alias("axis")).agg(F.var_pop("v").alias("var"))
    return per.groupBy(*keys, "point").agg(F.sqrt(F.sum("var")).alias("d")).groupBy(*keys).agg(F.median("d").alias("dispersion"))


def valid_speed(values: DataFrame, keys: list[str]) -> DataFrame:
    """Median |step| / time between valid neighbours more than a microsecond apart."""
    w = Window.partitionBy(*keys).orderBy("t_sec", "row_id")
    rows = values.filter("valid").withColumns({"dv": F.col("value") - F.lag("value").over(w), "dt": F.col("t_sec") - F.lag("t_sec").over(w)})
    return rows.filter("dt > 1e-6").groupBy(*keys).agg(F.median(F.abs(F.col("dv")) / F.col("dt")).alias("speed"))
