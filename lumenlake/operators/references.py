"""Robust references fitted on training sessions, and values judged by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.quantiles import PLAIN, exact_quantiles, largest_group

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
TINY = 1e-12


def robust_scale(mad: Column, iqr: Column, std: Column) -> Column:
    """1.4826 MAD, else IQR / 1.349, else the population deviation, else 0."""
    return F.when(1.4826 * mad > TINY, 1.4826 * mad).when(iqr / 1.349 > TINY, iqr / 1.349).when(std > TINY, std).otherwise(F.lit(0.0))


def fit(values: DataFrame, keys: list[str], value: str = "value", bucketed: bool | None = None) -> DataFrame:
    """``n, median, mad, scale, knots`` of the finite values for each key.

    Up to ``PLAIN`` values of a key are ranked by one aggregate, more by bucket counts; both are exact.
    """
    v = F.col(value)
    finite = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if bucketed if bucketed is not None else finite.count() > PLAIN and largest_group(finite, keys) > PLAIN:
        return _fit_by_buckets(finite, keys, value)
    basic = finite.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(*map(F.lit, QUANTILES))).alias("knots")
    ).withColumn("median", F.element_at("knots", 4))
    spread = finite.join(basic.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(v - F.col("median"))).alias("mad"))
    iqr = F.element_at("knots", 5) - F.element_at("knots", 3)
    return basic.join(spread, keys).withColumn("scale", robust_scale(F.col("mad"), iqr, F.col("std"))).drop("std")


def _fit_by_buckets(finite: DataFrame, keys: list[str], value: str) -> DataFrame:
    std = finite.groupBy(*keys).agg(F.stddev_pop(value).alias("std"))
    basic = exact_quantiles(finite, keys, value, list(QUANTILES)).withColumnRenamed("q", "knots").join(std, keys).withColumn("median", F.element_at("knots", 4))
    apart = finite.join(F.broadcast(basic.select(*keys, "median")), keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))  # one row a key that has over PLAIN values
    mad = exact_quantiles(apart, keys, "_d", [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    iqr = F.element_at("knots", 5) - F.element_at("knots", 3)
    return basic.join(mad, keys).withColumn("scale", robust_scale(F.col("mad"), iqr, F.col("std"))).drop("std")


def curve(knots: str) -> Column:
    """The points (x, y) through which percentiles are read: equal knots share their mean, and the last is repeated
    up to the number of knots. Made once for a reference, not for each value."""
    p = ", ".join(f"{q * 100:g}D" for q in QUANTILES)
    points = f"""transform(array_distinct({knots}), k -> named_struct('x', k, 'y',
        aggregate(filter(zip_with({knots}, array({p}), (a, b) -> named_struct('x', a, 'p', b)), z -> z.x = k), named_struct('s', 0D, 'c', 0D),
        (a, z) -> named_struct('s', a.s + z.p, 'c', a.c + 1D), a -> a.s / a.c)))"""
    return F.expr(f"transform(array({points}), u -> concat(u, array_repeat(element_at(u, -1), {len(QUANTILES)} - size(u))))[0]")


def percentile_of(value: Column, points: Column) -> Column:
    """Piecewise-linear percentile along a ``curve``; ends clamp, and a curve of one point says 50."""
    x, y = (lambda i: F.element_at(points, i + 1)["x"]), (lambda i: F.element_at(points, i + 1)["y"])
    last = len(QUANTILES) - 1
    out = F.when(x(0) == x(last), F.lit(50.0)).when(value <= x(0), y(0))
    for i in range(last):
        out = out.when(value < x(i + 1), y(i) + (y(i + 1) - y(i)) * (value - x(i)) / (x(i + 1) - x(i)))
    return out.otherwise(y(last))


def robust_z(value: Column, median: Column, scale: Column) -> Column:
    return F.when(scale > 0, (value - median) / scale).otherwise(F.lit(0.0))


def category(percentile: Column) -> Column:
    return (
        F.when(percentile < 5, "very_low").when(percentile < 25, "low").when(percentile <= 75, "typical").when(percentile < 95, "high").otherwise("very_high")
    )


def enrich(values: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``percentile, robust_z, category``; nulls where no reference is known."""
    known = values.join(reference.select(*keys, "median", "scale", "knots", curve("knots").alias("_curve")), keys, "left")
    known = known.withColumn("percentile", F.when(F.col("knots").isNotNull(), percentile_of(F.col("value"), F.col("_curve")))).drop("_curve")
    z = F.when(F.col("knots").isNotNull(), robust_z(F.col("value"), F.col("median"), F.col("scale")))
    return known.withColumn("robust_z", z).withColumn("category", F.when(F.col("knots").isNull(), "unreferenced").otherwise(category(F.col("percentile")))).drop("median", "scale", "knots")


def subject_z(values: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the robust z within ``keys``; null under three values or without spread."""
    own = fit(values, keys, bucketed=False).select(*keys, "n", "median", "scale")  # one session's values
    z = F.when((F.col("n") >= 3) & (F.col("scale") > 0), (F.col("value") - F.col("median")) / F.col("scale"))
    return values.join(own, keys, "left").withColumn("subject_z", z).drop("n", "median", "scale")
