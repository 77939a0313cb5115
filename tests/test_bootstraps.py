"""Bootstraps against plain replicates with the same weights, and against resampling."""

import numpy as np
import pytest
from test_forests import rank_auc

from pyspark.sql import functions as F

from lumenlake.operators import bootstraps


def plain_ap(y, p, w):
    out, tp, fp = 0.0, 0.0, 0.0
    for v in sorted(set(p), reverse=True):
        pos, neg = w[(p == v) & (y == 1)].sum(), w[(p == v) & (y == 0)].sum()
        tp, fp = tp + pos, fp + neg
        out += pos * tp / (tp + fp) if pos else 0
    return out / w[y == 1].sum()


def plain_auc(y, p, w):
    pos, neg = y == 1, y == 0
    more = (p[pos][:, None] > p[neg]) + 0.5 * (p[pos][:, None] == p[neg])
    return (w[pos][:, None] * w[neg] * more).sum() / (w[pos].sum() * w[neg].sum())


def test_weights_are_poisson():
    w = bootstraps.weights(np.arange(4000, dtype=np.int64) * 7919, 3, 50)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    again = bootstraps.weights(np.array([7919], dtype=np.int64), 10, 1)
    assert again[0, 0] == w[1, 7]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 700)
    a = np.round(np.clip(0.5 + 0.2 * (y - 0.5) + 0.2 * rng.normal(size=700), 0, 1), 1)
    b = np.round(rng.random(700), 2)
    b[:300] = 0.5  # a run of ties longer than a chunk
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(700)] + [(700, None, 0.1, 0.2)], "id int, y int, a double, b double").repartition(5)
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64(F.lit(11), "id").alias("h")).collect()}
    return df, y, a, b, np.array([hashes[i] for i in range(700)])


def test_rankings(rows, monkeypatch):
    df, y, a, b, h = rows
    monkeypatch.setattr(bootstraps, "BLOCK", 16)
    monkeypatch.setattr(bootstraps, "CHUNK", 320)
    w = bootstraps.weights(h, 0, 40)
    for name, p in (("a", a), ("b", b)):
        got = {r.b: r for r in bootstraps.rankings(df, "id", name, 40, 11).collect()}
        assert sorted(got) == list(range(40))
        for k in range(40):
            own = w[:, k].copy()
            assert got[k].auc == pytest.approx(plain_auc(y, p, own))
            own = own * np.where(y == 1, y.sum() / own[y == 1].sum(), (1 - y).sum() / own[y == 0].sum())
            assert got[k].average_precision == pytest.approx(plain_ap(y, p, own))


def test_six_statistics_equal_resampling(rows):
    df, y, a, b, _ = rows
    got = {(r.score, r.statistic): r for r in bootstraps.ranking_intervals(df, "id", ["a", "b"], 1500, 11).collect()}
    assert sorted(got) == sorted((s, t) for s in ("a", "b", "a - b") for t in ("auc", "average_precision"))
    one = np.ones(700)
    assert got["a", "auc"].estimate == pytest.approx(rank_auc(y, a)) and got["a - b", "average_precision"].estimate == pytest.approx(plain_ap(y, a, one) - plain_ap(y, b, one))
    rng, drawn = np.random.default_rng(5), []
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(600):
        at = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        x = [rank_auc(y[at], a[at]), rank_auc(y[at], b[at]), plain_ap(y[at], a[at], one), plain_ap(y[at], b[at], one)]
        drawn.append([x[0], x[1], x[0] - x[1], x[2], x[3], x[2] - x[3]])
    low, high = np.percentile(drawn, [2.5, 97.5], axis=0)
    for i, key in enumerate([("a", "auc"), ("b", "auc"), ("a - b", "auc"), ("a", "average_precision"), ("b", "average_precision"), ("a - b", "average_precision")]):
        width = high[i] - low[i]
        assert abs(got[key].low - low[i]) < 0.15 * width and abs(got[key].high - high[i]) < 0.15 * width


def test_means(rows, spark):
    df, y, a, _, h = rows
    w = bootstraps.weights(h, 0, 90)
    own = df.filter("y is not null").withColumn("c", F.when(F.col("id") % 3 > 0, F.col("b")))
    got = {(r.b, r.statistic): r.m for r in bootstraps.means(own, "id", ["a", "c"], 90, 11).collect()}
    b, there = rows[3], np.arange(700) % 3 > 0
    for k in range(90):
        assert got[k, "a"] == pytest.approx((w[:, k] * a).sum() / w[:, k].sum())
        assert got[k, "c"] == pytest.approx((w[there, k] * b[there]).sum() / w[there, k].sum())
    got = {r.b: r.m for r in bootstraps.means(own, "id", ["a"], 90, 11, "y").collect()}
    for k in range(90):
        assert got[k] == pytest.approx(sum((y == c).sum() * (w[y == c, k] * a[y == c]).sum() / w[y == c, k].sum() for c in (0, 1)) / 700)
    none = bootstraps.means(own.filter("id < 0"), "id", ["a"], 5, 1)
    assert none.collect() == []
