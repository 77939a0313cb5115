"""The text baseline against a dense solver."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenlake.operators import textmodels


def plain(docs, folds, most):
    """Newton steps on dense TF-IDF rows, fold by fold."""
    terms = []
    for _, _, _, t in docs:
        w = re.findall(r"\w\w+", (t or "").lower())
        terms.append(Counter([*w, *[f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]))
    out = {}
    for k in range(folds):
        own = [i for i, d in enumerate(docs) if d[2] != k]
        df, n = Counter(), Counter()
        for i in own:
            df.update(terms[i].keys())
            n.update(terms[i])
        names = sorted(t for t in df if df[t] >= 2)
        names = sorted(sorted(names, key=lambda t: (-n[t], t))[:most])
        x = np.array([[(1 + math.log(c[t])) * (math.log((1 + len(own)) / (1 + df[t])) + 1) if c[t] else 0.0 for t in names] for c in terms])
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([d[1] for d in docs])
        z, t = x[own], y[own]
        c = len(own) / (2 * np.where(t == 1, t.sum(), (1 - t).sum()))
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (c * (p - t)) + w)
        for i, d in enumerate(docs):
            if d[2] == k:
                out[d[0]] = 1 / (1 + np.exp(-x[i] @ w))
    return out


@pytest.mark.parametrize("most", [200, 30])
def test_out_of_fold_text(spark, most):
    r = random.Random(1)
    words = [f"w{i}é" for i in range(40)] + ["Good", "bad", "x", "a_b", "12"]
    docs = []
    for i in range(90):
        y = int(i % 3 == 0)
        docs.append((i, y, i % 4, " ".join(r.choice(words) for _ in range(r.randrange(1, 25))) + (" good good day" if y and i % 2 else "") + ("," * (i % 2))))
    docs += [(90, 1, 0, None), (91, 0, 1, ""), (92, 1, 2, "unseen words only")]
    df = spark.createDataFrame([*docs, (93, None, 0, "x y"), (94, 1, None, "x y")], "session_id int, label int, fold int, text string").repartition(3)
    got = textmodels.out_of_fold_text(df, "text", "label", "fold", 4, most=most, tolerance=1e-7).collect()
    want = plain(docs, 4, most)
    assert {x.session_id: x.probability for x in got} == pytest.approx(want, abs=1e-5)
    assert all((x.label, x.fold) == docs[x.session_id][1:3] for x in got)


def test_empty(spark):
    df = spark.createDataFrame([], "session_id int, label int, fold int, text string")
    assert textmodels.out_of_fold_text(df, "text", "label", "fold", 3).collect() == []


def test_few_passes(spark):
    """A word of all texts makes the problem a badly scaled one, which must not cost passes over the data."""
    r = random.Random(5)
    docs = [(i, int(r.random() < 0.1), i % 2, "the " * 9 + " ".join(f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(60))) for i in range(1500)]
    df = spark.createDataFrame(docs, "session_id int, label int, fold int, text string").coalesce(2)
    spark.sparkContext.setJobGroup("passes", "passes")
    try:
        assert textmodels.out_of_fold_text(df, "text", "label", "fold", 2, tolerance=1e-3).count() == 1500
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("passes")) < 50
