"""Scores of atomic windows for structured queries, and a diverse choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(slots: DataFrame) -> DataFrame:
    """Adds each slot's change of percentile / 100 against the previous atomic window of its segment."""
    w = Window.partitionBy("session_id", "segment_id", "slot_id").orderBy("start_sec", "atomic_no")
    step = (F.col("percentile") - F.lag("percentile").over(w)) / 100
    return slots.withColumn("delta", F.when(F.col("atomic_no") - F.lag("atomic_no").over(w) == 1, step))


def extreme(pct: Column) -> Column:
    return F.coalesce(F.max(F.abs(pct - 50) / 50), F.lit(0.0))


def change(delta: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.max(F.abs(delta)), F.lit(0.0)))


def cross_modal(delta: Column, modality: Column) -> Column:
    side = lambda m: F.coalesce(F.max(F.when(modality == m, F.abs(delta))), F.lit(0.0))
    return F.least(F.lit(1.0), F.least(side("audio"), side("visual")))


def representative(pct: Column, median: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.coalesce(F.avg(F.abs(pct - median) / 50), F.lit(1.0)))


def final_score(pattern: Column, coverage: Column, reliability: Column) -> Column:
    return 0.70 * pattern + 0.20 * coverage + 0.10 * reliability


def candidate_limit(most: Column, n: Column, budget: Column) -> Column:
    return F.least(most, n, F.greatest(2 * budget, budget + 2))


def diverse(candidates: DataFrame, keys: list[str], budget: int, penalty: float = 0.12) -> DataFrame:
    """Greedy choice of ``budget`` rows by score less ``penalty`` times closeness to those chosen.

    A row outside the best by score loses at most the penalty, so rows below the ``budget``-th score
    less the penalty are left out first, exactly. Each choice is one window over the groups' rest;
    ties go to the earlier row (``mid``, then ``atomic_no``).
    """
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc("score"), "mid", "atomic_no"))
    bar = F.max(F.when(F.col("_n") == budget, F.col("score"))).over(w)
    rows = candidates.withColumn("_n", best).withColumn("_bar", bar).filter("_bar is null or score >= _bar - %r" % penalty)
    rows = rows.withColumns({"_near": F.lit(0.0), "pick": F.lit(None).cast("int")})
    for k in range(1, budget + 1):
        value = F.when(F.col("pick").isNull(), F.round(F.col("score") - penalty * F.col("_near"), 12))
        place = F.row_number().over(w.orderBy(F.desc_nulls_last(value), "mid", "atomic_no", "_n"))
        rows = rows.withColumn("_place", place).withColumn("pick", F.when(F.col("pick").isNull() & (F.col("_place") == 1), k).otherwise(F.col("pick")))
        taken = F.max(F.when(F.col("pick") == k, F.col("mid"))).over(w)
        closeness = F.greatest(F.lit(0.0), 1 - F.abs(F.col("mid") - taken) / (2 * F.greatest("duration", F.lit(1e-9))))
        rows = rows.withColumn("_near", F.greatest("_near", closeness))
    return rows.filter("pick is not null").drop("_n", "_bar", "_near", "_place")
