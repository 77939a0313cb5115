"""Scores of binary predictions. Rankings aggregate by distinct score where ties count as one, and
running sums are scans over ranges of (score, key), so that no task has a whole ranking.

A score that is null or NaN has no rank: it is an error. Rows without a label are the caller's to
leave out: they add to no sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.quantiles import prefix_sums


def confusion(predictions: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Counts at a threshold and the rates they give; an empty denominator gives 0."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    n = predictions.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({
        "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2,
    })


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, eps: float) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def ranked(score: str) -> Column:
    """The score, or an error where it is null or NaN."""
    return F.when(F.col(score).isNull() | F.isnan(score), F.raise_error(F.lit(f"{score} is null or NaN"))).otherwise(F.col(score))


def _by_score(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.withColumn("p", ranked("p")).groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def auc(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs won plus half the ties, over all pairs; null with one class."""
    rows = prefix_sums(_by_score(predictions, keys), keys, [F.col("p")], ["neg"])
    total = F.sum("pos") * F.sum("neg")
    return rows.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / total).alias("auc"))


def average_precision(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of recall times precision at each distinct score; null without positives."""
    rows = prefix_sums(_by_score(predictions, keys), keys, [F.desc("p")], ["pos", "neg"])
    tp = F.col("pos_before") + F.col("pos")
    rows = rows.withColumns({"tp": tp, "seen": tp + F.col("neg_before") + F.col("neg")})
    return rows.groupBy(*keys).agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def average_precision_ranked(predictions: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The same with ties broken by row index."""
    rows = prefix_sums(predictions.withColumns({"_one": F.lit(1), "p": ranked("p")}), keys, [F.desc("p"), F.col(index)], ["y", "_one"])
    rows = rows.withColumns({"rank": F.col("_one_before") + 1, "tp": F.col("y_before") + F.col("y")})
    return rows.groupBy(*keys).agg(F.when(F.sum("y") > 0, F.sum(F.col("y") * F.col("tp") / F.col("rank")) / F.sum("y")).alias("average_precision"))


def best_threshold(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of largest balanced accuracy among 0.5, the scores and their midpoints.

    Ties go to the one nearest 0.5, then to the larger. One running pass over distinct scores: a
    midpoint or 0.5 classifies as the next score above it does.
    """
    scores = _by_score(predictions, keys)
    total = scores.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    below = prefix_sums(scores, keys, [F.col("p")], ["pos", "neg"], last="p").select(*keys, "p", F.col("pos_before").alias("pos_below"), F.col("neg_before").alias("neg_below"), F.col("last_before").alias("last"))
    own = below.select(*keys, F.explode(F.array("p", (F.col("p") + F.col("last")) / 2)).alias("threshold"), "pos_below", "neg_below").filter("threshold is not null")
    half = scores.groupBy(*keys).agg(
        F.lit(0.5).alias("threshold"), F.sum(F.when(F.col("p") < 0.5, F.col("pos")).otherwise(0)).alias("pos_below"), F.sum(F.when(F.col("p") < 0.5, F.col("neg")).otherwise(0)).alias("neg_below")
    )
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    ba = (rate(F.col("all_pos") - F.col("pos_below"), F.col("all_pos")) + rate(F.col("neg_below"), F.col("all_neg"))) / 2
    rows = own.unionByName(half).join(total, keys).withColumn("ba", F.round(ba, 12))
    best = F.max_by(F.struct("threshold", "ba"), F.struct("ba", -F.round(F.abs(F.col("threshold") - 0.5), 12), "threshold"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.ba").alias("balanced_accuracy"))


def transition(y: Column, before: Column, after: Column, referred: Column) -> Column:
    first = F.when(before == y, "correct").otherwise("wrong")
    return F.when(referred, F.concat(first, F.lit("_referred"))).otherwise(F.concat(first, F.lit("_to_"), F.when(after == y, "correct").otherwise("wrong")))


def selective(predictions: DataFrame, keys: list[str], index: str, limit: float) -> DataFrame:
    """The largest share, most confident first, whose miss rate stays within ``limit``."""
    own = predictions.withColumns({"_miss": ((F.col("y") == 1) & (F.col("p") < 0.5)).cast("int"), "_pos": (F.col("y") == 1).cast("int"), "_one": F.lit(1), "confidence": ranked("confidence")})
    rows = prefix_sums(own, keys, [F.desc("confidence"), F.col(index)], ["_miss", "_pos", "_one"])
    pos = F.col("_pos_before") + F.col("_pos")
    rows = rows.withColumns({"n": F.col("_one_before") + 1, "fnr": F.when(pos > 0, (F.col("_miss_before") + F.col("_miss")) / pos)})
    return rows.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col("fnr") <= limit + 1e-12, F.col("n"))), F.lit(0)) / F.count("*")).alias("coverage"))
