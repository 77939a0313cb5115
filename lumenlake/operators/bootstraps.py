"""Bootstraps in one pass over the rows, whatever the number of replicates.

A row counts Poisson(1) times in each replicate, drawn from a hash of seed, key and replicate: so
the same row counts alike for every statistic, and a rerun gives the same. Weights are made as
matrices of rows by ``BLOCK`` replicates and added up at once; a task emits a row for each
replicate. Nothing is repeated by the number of replicates before a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.quantiles import ranged

BLOCK, CHUNK = 64, 2048
#: Beyond the last the chance is below 1e-12.
CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])


def weights(hashes: np.ndarray, first: int, n: int) -> np.ndarray:
    """Poisson(1) draws of rows (down) in the replicates from ``first`` (across)."""
    x = hashes.view(np.uint64)[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(CUTS, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def blocks(samples: int) -> Iterator[tuple[int, int]]:
    for first in range(0, samples, BLOCK):
        yield first, min(BLOCK, samples - first)


def ends(c: str) -> list[Column]:
    q = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return [q[0].alias("low"), q[1].alias("high")]


def means(rows: DataFrame, key: str, values: list[str], samples: int, seed: int, stratum: str | None = None) -> DataFrame:
    """``b, statistic, m``: the mean of each of ``values`` in each replicate, over the rows that have the value.

    With a stratum, replicates weigh each one by its share of the rows; strata are few.
    """
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    told = rows.select(F.xxhash64(F.lit(seed), key).alias("h"), group.alias("g"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    names = [f"v{i}" for i in range(len(values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column("g").to_pylist(), object)
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            here = ~np.isnan(x)
            both = np.hstack([np.where(here, x, 0.0), here])
            h = batch.column("h").to_numpy()
            for g in set(groups.tolist()):
                own = np.flatnonzero(groups == g)
                total = sums.setdefault(g, np.zeros((samples, both.shape[1])))
                for start in range(0, len(own), CHUNK):
                    part = own[start : start + CHUNK]
                    for first, n in blocks(samples):
                        total[first : first + n] += weights(h[part], first, n).T @ both[part]
        for g, total in sums.items():
            columns = [pa.array(total[:, i]) for i in range(total.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([g] * samples), pa.array(np.arange(samples)), *columns], names=["g", "b", *[f"x{i}" for i in range(len(names))], *[f"n{i}" for i in range(len(names))]])

    cells = [f"{c}{i}" for c in "xn" for i in range(len(names))]
    sums = told.mapInArrow(run, "g string, b long, " + ", ".join(f"{c} double" for c in cells)).groupBy("g", "b").agg(*[F.sum(c).alias(c) for c in cells])
    shares = told.groupBy("g").agg(*[F.count(c).alias(f"m{i}") for i, c in enumerate(names)])
    each = sums.join(F.broadcast(shares), "g")  # a row for each stratum
    one = lambda i: F.sum(F.when(F.col(f"n{i}") > 0, F.col(f"m{i}") * F.col(f"x{i}") / F.col(f"n{i}"))) / F.sum(F.when(F.col(f"n{i}") > 0, F.col(f"m{i}")))
    wide = each.groupBy("b").agg(*[one(i).alias(f"r{i}") for i in range(len(names))])
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("statistic"), F.col(f"r{i}").alias("m")) for i, v in enumerate(values)]))
    return wide.select("b", cells.alias("x")).select("b", "x.*").filter("m is not null")


def rankings(rows: DataFrame, key: str, score: str, samples: int, seed: int) -> DataFrame:
    """``b, auc, average_precision`` of one score of ``rows`` (key, y, score) in each replicate that has both classes.

    Rows lie sorted in ranges of the score, where ties stay together. A first pass adds up the
    classes' weights in each range, a second goes through each range from the totals of those above
    it. Each class is weighted back to its number of rows, as if replicates were drawn class by class.
    """
    told = rows.filter(F.col("y").isin(0, 1)).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col("y").cast("int").alias("y"), F.col(score).cast("double").alias("p"))
    dealt = ranged(told, [], [F.desc("p")])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part, h, y = (batch.column(c).to_numpy() for c in ("_p", "h", "y"))
            classes = np.stack([y == 1, y == 0], axis=1).astype(float)
            for k in np.unique(part).tolist():
                own = np.flatnonzero(part == k)
                total = sums.setdefault(k, np.zeros((samples, 2)))
                for start in range(0, len(own), CHUNK):
                    some = own[start : start + CHUNK]
                    for first, n in blocks(samples):
                        total[first : first + n] += weights(h[some], first, n).T @ classes[some]
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(samples, k, np.int32)), pa.array(np.arange(samples)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["part", "b", "pos", "neg"])

    per = dealt.mapInArrow(totals, "part int, b long, pos double, neg double").groupBy("part", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # two numbers for each range and replicate
    found = per.toArrow().to_pydict()
    parts = sorted(set(found["part"]))
    sums = np.zeros((len(parts), samples, 2))
    sums[np.searchsorted(parts, found["part"]), found["b"]] = np.stack([found["pos"], found["neg"]], axis=1)
    whole = sums.sum(axis=0)
    above = np.cumsum(sums, axis=0) - sums
    n = told.groupBy().agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
    back = np.array([n.pos, n.neg]) / np.maximum(whole, 1)
    sent = rows.sparkSession.sparkContext.broadcast((parts, above, whole, back))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, above, whole, back = sent.value
        sums, at = np.zeros((samples, 2)), None
        seen = open_tie = None

        def close(tie: np.ndarray) -> None:
            """Adds ties (score, replicate, class) that are complete."""
            upto = seen + np.cumsum(tie, axis=0)
            pos, neg = tie[:, :, 0], tie[:, :, 1]
            sums[:, 0] += (pos * (whole[:, 1] - upto[:, :, 1] + neg / 2)).sum(axis=0)
            tp, fp = upto[:, :, 0] * back[:, 0], upto[:, :, 1] * back[:, 1]
            sums[:, 1] += np.where(pos > 0, pos * tp / np.maximum(tp + fp, 1e-300), 0).sum(axis=0)
            seen[:] = upto[-1]

        for batch in batches:
            part, h, y, p = (batch.column(c).to_numpy() for c in ("_p", "h", "y", "p"))
            for start in range(0, batch.num_rows, CHUNK // 8):
                rest = slice(start, start + CHUNK // 8)
                for k in np.unique(part[rest]).tolist():
                    own = np.flatnonzero(part[rest] == k) + start
                    starts = np.flatnonzero(np.append(True, p[own][1:] != p[own][:-1]))
                    tie = np.zeros((len(starts), samples, 2))
                    for first, m in blocks(samples):
                        w = weights(h[own], first, m)
                        tie[:, first : first + m, 0] = np.add.reduceat(w * (y[own] == 1)[:, None], starts, axis=0)
                        tie[:, first : first + m, 1] = np.add.reduceat(w * (y[own] == 0)[:, None], starts, axis=0)
                    if open_tie is not None and at == k and open_tie[0] == p[own[0]]:
                        tie[0] += open_tie[1]
                    elif open_tie is not None:
                        close(open_tie[1][None])
                    if at != k:
                        at, seen = k, above[parts.index(k)].copy()
                    if len(tie) > 1:
                        close(tie[:-1])
                    open_tie = p[own[-1]], tie[-1]
        if open_tie is not None:
            close(open_tie[1][None])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["b", "auc", "ap"])

    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = dealt.repartition(n_tasks, "_p").sortWithinPartitions("_p", F.desc("p"))
    got = sorted_rows.mapInArrow(run, "b long, auc double, ap double").groupBy("b").agg(F.sum("auc").alias("auc"), F.sum("ap").alias("ap"))
    totals_of = per.groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = got.join(totals_of, "b").filter("pos > 0 and neg > 0")
    return both.select("b", (F.col("auc") / (F.col("pos") * F.col("neg"))).alias("auc"), (F.col("ap") / F.col("pos")).alias("average_precision"))


def ranking_intervals(rows: DataFrame, key: str, scores: list[str], samples: int, seed: int) -> DataFrame:
    """``score, statistic, estimate, low, high`` of the area under the curve and the average precision of several
    scores of the same rows (key, y), and of the first score's lead over each other (``first - other``):
    for two scores these are the six paired statistics. ``estimate`` is of the rows themselves.

    Rows without a label of 0 or 1 take no part; replicates without one of the classes are left out.
    """
    from lumenlake.operators import metrics

    each = None
    own = rows.filter(F.col("y").isin(0, 1))
    for s in scores:  # a few scores, each sorted once
        drawn = rankings(own, key, s, samples, seed)
        plain = own.select(F.lit(1).alias("g"), "y", F.col(s).cast("double").alias("p"))
        point = metrics.auc(plain, ["g"]).join(metrics.average_precision(plain, ["g"]), "g").select(F.lit(-1).cast("long").alias("b"), "auc", "average_precision")
        part = drawn.unionByName(point).select(F.lit(s).alias("score"), "b", "auc", "average_precision")
        each = part if each is None else each.unionByName(part)
    first = each.filter(F.col("score") == scores[0]).select("b", F.col("auc").alias("_a"), F.col("average_precision").alias("_p"))
    leads = each.filter(F.col("score") != scores[0]).join(first, "b").select(F.concat(F.lit(f"{scores[0]} - "), "score").alias("score"), "b", (F.col("_a") - F.col("auc")).alias("auc"), (F.col("_p") - F.col("average_precision")).alias("average_precision"))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("m")) for s in ("auc", "average_precision")]))
    long = each.unionByName(leads).select("score", "b", cells.alias("x")).select("score", "b", "x.*")
    drawn = F.when(F.col("b") >= 0, F.col("m"))
    return long.withColumn("drawn", drawn).groupBy("score", "statistic").agg(F.max(F.when(F.col("b") < 0, F.col("m"))).alias("estimate"), *ends("drawn"))
