"""Cohort checks, samples and weights of training records, and the access ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(seed: int, key: Column) -> Column:
    """A share in [0, 1] from bytes 4 to 8 of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("double") / float(2**32 - 1)


def inverse_frequency(rows: DataFrame, key: str, cap: float = 10.0) -> DataFrame:
    """Adds ``weight``: total / (classes * count) of the row's class, at most ``cap``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_m"))
    totals = counts.groupBy().agg(F.sum("_m").alias("_all"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(F.broadcast(totals)).select(key, F.least(F.lit(cap), F.col("_all") / (F.col("_classes") * F.col("_m"))).alias("weight"))
    return rows.join(weights, key)


def round_robin(rows: DataFrame, stratum: str, order: list, limit: int) -> DataFrame:
    """The first of each stratum, then the second of each, and so on, up to ``limit``."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("turn", n).filter(F.col("turn") <= limit).orderBy("turn", stratum).limit(limit)


def balanced_epoch(rows: DataFrame, stratum: str, order: list) -> DataFrame:
    """Repeats rows so that every stratum has as many as the largest; ``copy`` counts from 0. Which rows of a stratum get
    one copy more goes by ``order``, ranked within 1,024 hash buckets of it and these in turn."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_m"))
    most = counts.groupBy().agg(F.max("_m").alias("_most"))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(1024)))
    sizes = dealt.groupBy(stratum, "_b").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy(*order)) - 1
    ranked = dealt.withColumn("_n", within).join(sizes.withColumn("_before", before), [stratum, "_b"]).withColumn("_n", F.col("_n") + F.col("_before")).drop("_b", "_k", "_before")
    all_ = ranked.join(counts, stratum).crossJoin(F.broadcast(most))
    copies = F.floor((F.col("_most") - F.col("_n") - 1) / F.col("_m"))
    return all_.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("_n", "_m", "_most")


def cohort_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, or more than once."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.filter("n_left <> 1 or n_right <> 1")


def overlapping_splits(rows: DataFrame, key: str, split: str) -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def chain(events: DataFrame) -> DataFrame:
    """Sequence, previous hash and own hash of each run's ``payload`` rows (run_id, order_key, payload).

    Entry n's hash covers its sequence, payload and the previous hash, so a run is folded in order:
    rows stream through their partition, sorted, and only the last hash is kept.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n, last, started = None, 0, "", False
        for batch in batches:
            runs, payloads = batch.column("run_id").to_pylist(), batch.column("payload").to_pylist()
            at, before, own = [], [], []
            for r, payload in zip(runs, payloads, strict=True):
                if not started or r != run:
                    run, n, last, started = r, 0, "0" * 64, True
                at.append(n)
                before.append(last)
                last = hashlib.sha256(f"{n}|{payload or ''}|{last}".encode()).hexdigest()
                own.append(last)
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), pa.array(at, pa.int32()), batch.column("payload"), pa.array(before, pa.string()), pa.array(own, pa.string())], names=["run_id", "sequence", "payload", "previous", "entry"])

    ordered = events.select("run_id", "order_key", "payload").repartition("run_id").sortWithinPartitions("run_id", "order_key")
    return ordered.mapInArrow(fold, f"run_id {events.schema['run_id'].dataType.simpleString()}, sequence int, payload string, previous string, entry string")


def chain_violations(ledger: DataFrame) -> DataFrame:
    """Entries whose sequence, previous hash or own hash does not follow."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    rows = ledger.withColumns({"_last": F.coalesce(F.lag("entry").over(w), F.repeat(F.lit("0"), 64)), "_n": F.row_number().over(w) - 1})
    own = F.sha2(F.concat(F.col("sequence").cast("string"), F.lit("|"), F.coalesce("payload", F.lit("")), F.lit("|"), "previous"), 256)
    return rows.filter((F.col("sequence") != F.col("_n")) | (F.col("previous") != F.col("_last")) | (F.col("entry") != own)).drop("_last", "_n")


def within_budget(requests: DataFrame, run: str, order: str, cost: str, limit: float) -> DataFrame:
    """Adds ``used`` before each request, ``remaining`` and whether it would still fit."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(cost).over(w), F.lit(0))
    return requests.withColumn("used", used).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used"))).withColumn("fits", F.col(cost) <= F.col("remaining"))
