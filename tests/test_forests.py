"""Extremely randomised trees against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import forests


def rank_auc(y, p):
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        ranks[p == v] = ranks[p == v].mean()
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def plain_tree(x, y, w, rng, tries, least):
    """A leaf's share, or (feature, cut, left, right)."""
    if len(y) >= 2 * least and 0 < y.sum() < len(y):
        best = None
        for f in [f for f in rng.permutation(x.shape[1]) if x[:, f].min() < x[:, f].max()][:tries]:
            cut = rng.uniform(x[:, f].min(), x[:, f].max())
            left = x[:, f] <= cut
            if least <= left.sum() <= len(y) - least:
                cost = sum(w[s].sum() - sum(w[s & (y == c)].sum() ** 2 for c in (0, 1)) / w[s].sum() for s in (left, ~left))
                if best is None or cost < best[0]:
                    best = cost, f, cut, left
        if best:
            _, f, cut, left = best
            return f, cut, plain_tree(x[left], y[left], w[left], rng, tries, least), plain_tree(x[~left], y[~left], w[~left], rng, tries, least)
    return w[y == 1].sum() / w.sum()


def asked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_out_of_fold(x, y, fold, trees):
    out, rng = np.zeros(len(y)), np.random.default_rng(99)
    for k in np.unique(fold):
        own, held = fold != k, fold == k
        gone = np.isnan(x)
        full = np.hstack([np.where(gone, np.nanmedian(x[own], axis=0), x), gone[:, gone[own].any(axis=0)]])
        w = np.where(y[own] == 1, own.sum() / (2 * y[own].sum()), own.sum() / (2 * (1 - y[own]).sum()))
        for _ in range(trees):
            tree = plain_tree(full[own], y[own], w, rng, int(np.sqrt(full.shape[1])), 3)
            out[held] += [asked(tree, r) for r in full[held]]
    return out / trees


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 9))
    x[:, 7], x[:, 8] = 3.0, rng.integers(0, 2, 300)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + 0.7 * rng.normal(size=300) > 0.4).astype(int)
    x[rng.random((300, 9)) < 0.05] = np.nan
    return x, y, np.arange(300) % 3


def rows_of(spark, x, y, fold):
    rows = [(i, int(y[i]), int(fold[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "session_id int, label int, fold int, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


@pytest.mark.parametrize("local_rows", [20_000, 60])
def test_out_of_fold_trees(spark, data, local_rows):
    x, y, fold = data
    names = [f"f{j}" for j in range(9)]
    trees = 120
    got = forests.out_of_fold_trees(rows_of(spark, x, y, fold).repartition(5), names, "label", "fold", 3, trees, local_rows=local_rows, block=50).collect()
    assert len(got) == 300 and {r.session_id: (r.label, r.fold) for r in got} == {i: (int(y[i]), int(fold[i])) for i in range(300)}
    p = np.array([r.probability for r in sorted(got, key=lambda r: r.session_id)])
    want = plain_out_of_fold(x, y, fold, trees)
    assert abs(rank_auc(y, p) - rank_auc(y, want)) < 0.02 and rank_auc(y, p) > 0.75
    assert np.corrcoef(p, want)[0, 1] > 0.97


@pytest.mark.parametrize("local_rows", [20_000, 60])
def test_leaves(spark, data, local_rows):
    """The leaves of a tree hold each training row once, and three at least; a rerun grows the same."""
    x, y, fold = data
    run = lambda: forests.out_of_fold_trees(rows_of(spark, x, y, fold), ["f0", "f1", "f2"], "label", "fold", 3, 4, local_rows=local_rows, leaves=True)
    leaves = run().filter("n > 0")
    per = leaves.groupBy("tree").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.count("*").alias("m")).collect()
    assert len(per) == 12 and all(r.n == 200 and r.least >= 3 and r.w0 == pytest.approx(100) and r.w1 == pytest.approx(100) and r.m > 5 for r in per)
    assert sorted(leaves.collect()) == sorted(run().filter("n > 0").collect())


def test_few_rows(spark):
    ddl = "session_id int, label int, fold int, a double"
    own = lambda rows: forests.out_of_fold_trees(spark.createDataFrame(rows, ddl), ["a"], "label", "fold", 2, 3).collect()
    assert own([]) == []
    got = own([(1, 1, 0, 1.0), (2, 0, 1, None), (2, 0, 1, None), (3, None, 0, 1.0), (4, 1, None, 2.0)])
    assert sorted((r.session_id, r.label, r.probability) for r in got) == [(1, 1, 0.0), (2, 0, 1.0), (2, 0, 1.0)]


def test_rows_of_a_task_are_not_split_by_passes(spark):
    """Tens of thousands of rows go to tasks once for a block of trees: no passes level by level, no copy for each tree."""
    rows = spark.range(24_000).selectExpr("id as session_id", "int(pmod(hash(id), 7) < 2) as label", "int(id % 2) as fold", "double(pmod(hash(id, 1), 1000)) as a", "pow(2.0, id % 400) as b")
    spark.sparkContext.setJobGroup("trees", "trees")
    try:
        got = forests.out_of_fold_trees(rows, ["a", "b"], "label", "fold", 2, 3).agg(F.count("*").alias("n"), F.avg("probability").alias("p")).first()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.n == 24_000 and 0.3 < got.p < 0.7
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) < 15
