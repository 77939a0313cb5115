"""Distributed ranks, folds, quotas and even choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.quantiles import prefix_sums


def hash_rank(rows: DataFrame, stratum: str, key: str, seed: int, digits: int = 3) -> DataFrame:
    """Adds ``place``, from 0: the row's rank in its stratum by sha256(seed:key).

    A stratum may hold most rows, so ranks are counted in buckets of the first hash digits and
    moved by the buckets before: at most 16 ** digits bucket counts for each stratum.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    own = rows.withColumn("_hash", digest).withColumn("_bucket", F.substring("_hash", 1, digits))
    before = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(stratum, "_bucket").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_hash", key)) - 1
    return own.withColumn("_n", within).join(counts, [stratum, "_bucket"]).withColumn("place", F.col("_n") + F.col("_before")).drop("_hash", "_bucket", "_m", "_before", "_n")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``; each label's rows are dealt evenly."""
    return hash_rank(rows, label, key, seed).withColumn("fold", (F.col("place") % folds).cast("int")).drop("place")


def balanced_subset(rows: DataFrame, label: str, key: str, per_class: int, seed: int) -> DataFrame:
    return hash_rank(rows, label, key, seed).filter(F.col("place") < per_class).drop("place")


def lowest_quota(rows: DataFrame, value: str, key: str, share: float) -> DataFrame:
    """The max(1, round(share * n)) rows of smallest (value, key), whatever ties there are."""
    quota = F.greatest(F.lit(1), F.bround(F.count("*") * share).cast("long"))
    total = rows.groupBy().agg(quota.alias("_k"))
    counted = prefix_sums(rows.withColumn("_one", F.lit(1)), [], [F.col(value), F.col(key)], ["_one"])
    return counted.crossJoin(F.broadcast(total)).filter("_one_before < _k").select(*rows.columns)  # one row


def even_places(n: Column, k: int) -> Column:
    """``k`` places spread evenly over ``n``, ends included, rounding half to even."""
    if k == 1:
        return F.array(F.floor(n / 2).cast("long"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("long"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(spread)


def uniform_places(n: Column, k: int) -> Column:
    """The same, rounding half up; a single place is the lower middle."""
    if k == 1:
        return F.array(F.floor((n - 1) / 2).cast("long"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1) + 0.5).cast("long"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(spread)


def spread(rows: DataFrame, group: str, order: str, places) -> DataFrame:
    """The rows of each group at ``places(size)``."""
    w = Window.partitionBy(group)
    own = rows.withColumns({"_n": F.row_number().over(w.orderBy(order)) - 1, "_size": F.count("*").over(w)})
    return own.filter(F.array_contains(places(F.col("_size")), F.col("_n").cast("long"))).drop("_n", "_size")


def id_range(ids: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How a group's ids are told: ``a to b`` for consecutive E-ids, up to four others one by one, and else the ends
    with their number; ``none`` for none."""
    own = ids.filter(F.col(name).isNotNull()).select(*keys, name).distinct()
    n = F.regexp_extract(name, r"(\d+)$", 1).cast("long")
    c = own.groupBy(*keys).agg(F.count("*").alias("_c"), F.min_by(name, n).alias("_a"), F.max_by(name, n).alias("_b"), (F.max(n) - F.min(n) + 1).alias("_w"), F.bool_and(F.col(name).rlike("^E[0-9]+$")).alias("_e"))
    ordered = Window.partitionBy(*keys).orderBy(n, name)
    few = own.withColumn("_n", F.row_number().over(ordered)).filter("_n <= 4").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda x: x[name]), ", ").alias("_l"))
    span = F.concat("_a", F.lit(" to "), "_b")
    label = F.when(F.col("_c").isNull(), "none").when(F.col("_e") & (F.col("_c") == 1), F.col("_a")).when(F.col("_e") & (F.col("_w") == F.col("_c")), span).when(~F.col("_e") & (F.col("_c") <= 4), F.col("_l")).otherwise(F.concat(span, F.lit(" ("), F.col("_c").cast("string"), F.lit(" refs; exact list in segment plan)")))
    return ids.select(*keys).distinct().join(c, keys, "left").join(few, keys, "left").select(*keys, label.alias("label"))
