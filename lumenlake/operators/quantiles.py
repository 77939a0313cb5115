"""Exact quantiles and running sums that no single task has to sort.

A window over a few keys would put all values of a key into one task. Here values are dealt to
ranges or buckets first; only their totals are accumulated key by key, and values are ordered
within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.sources.scratch import stored

BUCKETS = 4096
#: Values of one key that a single aggregate may hold.
PLAIN = 1 << 20


def ranged(rows: DataFrame, keys: list[str], order: list[Column], part: str = "_p") -> DataFrame:
    """``rows`` dealt to ranges of (keys, order) with sampled borders; ``part`` numbers the ranges in that order.

    Equal values of the first columns are split by the later ones. The dealt rows are stored, since
    borders sampled twice may differ.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges")


def prefix_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: list[str], last: str | None = None) -> DataFrame:
    """Adds ``<name>_before``: the sums over the rows of the same keys that come earlier in ``order``, and, for a
    column ``last``, ``last_before``: its value in the row before (null for the first).

    A scan over ranges: each range adds up its rows, the totals of the ranges are accumulated (a row for
    each key and range), and rows are ordered within their range only.
    """
    dealt = ranged(rows, keys, order)
    own = Window.partitionBy(*keys, "_p").orderBy(*order)
    edge = [F.max_by(last, "_n").alias("_last")] if last else []
    ends = dealt.withColumn("_n", F.row_number().over(own)) if last else dealt
    per = ends.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums], *edge)
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*keys, "_p", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums], *([F.last("_last").over(earlier).alias("_last")] if last else []))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    added = {f"{c}_before": F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}
    if last:
        added["last_before"] = F.coalesce(F.lag(last).over(own), F.col("_last"))
    return dealt.join(start, [*keys, "_p"]).withColumns(added).select(*rows.columns, *added)


def largest_group(rows: DataFrame, keys: list[str]) -> int:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys, n, q``: the linear-interpolated quantiles of ``value`` (finite), as an array in the order of ``shares``.

    Two rounds of bucket counts find the bucket of each order statistic; the values of these
    buckets alone are counted by value.
    """
    v = F.col(value).cast("double")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    place = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("up"), f((F.col("n") - 1) * F.lit(p)).cast("long").alias("at")) for side, f in enumerate((F.floor, F.ceil))]) for i, p in enumerate(shares)]))).alias("t")
    targets = ends.select(*keys, "n", "_lo", "_hi", place).select(*keys, "n", "_lo", "_hi", "t.*").withColumn("_before", F.lit(0).cast("long"))
    rest = rows.select(*keys, v.alias("_v"))
    for _ in range(2):
        bounds = targets.select(*keys, "_lo", "_hi").distinct()  # the ranges that still matter, a few a key
        within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")
        inside = rest.join(F.broadcast(bounds), keys).filter(within).withColumn("_b", bucket)
        counts = inside.groupBy(*keys, "_lo", "_hi", "_b").agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        earlier = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_c", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
        hit = (F.col("at") >= F.col("_before") + F.col("_c")) & (F.col("at") < F.col("_before") + F.col("_c") + F.col("_m"))
        targets = targets.join(counts, [*keys, "_lo", "_hi"]).filter(hit).select(*keys, "n", "i", "up", "at", F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), (F.col("_before") + F.col("_c")).alias("_before"))
    bounds = targets.select(*keys, "_lo", "_hi").distinct()
    values = rest.join(F.broadcast(bounds), keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(*keys, "_lo", "_hi", "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v"))
    found = targets.join(values.withColumn("_c", upto), [*keys, "_lo", "_hi"]).filter((F.col("at") < F.col("_before") + F.col("_c")) & (F.col("at") >= F.col("_before") + F.col("_c") - F.col("_m")))
    sides = found.groupBy(*keys, "n", "i").agg(F.max(F.when(F.col("up") == 0, F.col("_v"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("_v"))).alias("b"))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1)
    at = (F.col("n") - 1) * share
    q = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
    return sides.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("q"))
