"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The n-grams lie within words that carry boundary marks, and are hashed to a fixed number of
buckets. A text's feature is its bucket's occurrences for each hundred words, times the log of the
ratio of the bucket's smoothed document counts in toxic and other texts. A word counts for at most
``SHARE`` of its text, so that one word repeated does not drown the rest. Buckets whose ratio is
not ``certain`` standard errors from none are left out. Logistic regression with an L2 penalty
weighs the scaled features. The score is linear in the words, so each distinct word is scored once
for a bounded table.

Training reads labelled rows only: at most ``per_class`` of each class in hash order of the key,
none above ``longest`` characters. The model has a fixed size and may be broadcast.

Edge cases: null and empty texts have the score of the intercept alone; labels that are null or
repeat with a contradiction count as toxic if any row says so, null ones are left out; without
labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import arrow_batch, give_back, map_texts, text_slices, with_fields

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 20
SHARE = 0.02


def rates(text: str | None) -> dict[str, float]:
    """Occurrences of each lower-case word for a hundred words."""
    counts = Counter((text or "").lower().split())
    n = counts.total()
    most = max(1.0, SHARE * n)
    return {w: 100 * min(c, most) / n for w, c in counts.items()}


def buckets_of(word: str) -> list[int]:
    """Buckets of a lower-case word's n-grams, repeats included."""
    w = f"\x02{word}\x03".encode("utf-8", "surrogatepass")
    return [zlib.crc32(w[i : i + n]) % BUCKETS for n in ORDERS for i in range(len(w) - n + 1)]


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scorer(self, limit: int = 200_000):
        """A function from text to score with a bounded table of word scores."""
        weights, known = self.weights, {}

        def word_score(word: str) -> float:
            return float(weights[buckets_of(word)].sum())

        def score(text: str | None) -> float:
            if len(known) > limit:
                known.clear()
            z = self.intercept
            for w, rate in rates(text).items():
                s = known.get(w)
                if s is None:
                    s = word_score(w)
                    if len(w) <= 64:
                        known[w] = s
                if s:
                    z += s * rate
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def fit(texts: list[str], toxic: list[int], prior: float | None = None, smoothing: float = 0.5, certain: float = 3.0, penalty: float = 1e-3, rounds: int = 300) -> Model:
    """``prior``: the share of toxic rows outside the sample, by which the classes are weighed."""
    y = np.array(toxic, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS, dtype=np.float32), -1e3)
    words: dict[str, np.ndarray] = {}

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        own = rates(text)
        for w in own:
            if w not in words:
                words[w] = np.array(buckets_of(w), dtype=np.int32)
        at = np.concatenate([words[w] for w in own]) if own else np.zeros(0, dtype=np.int32)
        of = np.repeat(list(own.values()), [len(words[w]) for w in own]) if own else np.zeros(0)
        found, where = np.unique(at, return_inverse=True)
        return found, np.bincount(where, of, len(found))

    # the texts' buckets are made twice, since those of all texts at once would fill the driver
    p, q = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    for text, t in zip(texts, toxic, strict=True):
        (p if t else q)[features(text)[0]] += 1
    n_toxic = y.sum()
    ratio = np.log(p / (n_toxic + 2 * smoothing)) - np.log(q / (len(y) - n_toxic + 2 * smoothing))
    used = np.flatnonzero(np.abs(ratio) >= certain * np.sqrt(1 / p + 1 / q))
    column = np.full(BUCKETS, -1, dtype=np.int64)
    column[used] = np.arange(len(used))
    index, values, starts = [], [], [0]
    for text in texts:
        found, rate = features(text)
        keep = column[found] >= 0
        index.append(column[found[keep]])
        values.append(rate[keep] * ratio[found[keep]])
        starts.append(starts[-1] + int(keep.sum()))
    index, values = np.concatenate(index), np.concatenate(values)
    owner = np.repeat(np.arange(len(y)), np.diff(starts))
    share = y.mean() if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
    cost = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    w, b = np.zeros(len(used)), math.log(share / (1 - share))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):  # Adam over the whole sample
        z = np.bincount(owner, values * w[index], len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * cost
        g, gb = np.bincount(index, values * error[owner], len(used)) + penalty * w, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = lambda m, v: 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)  # noqa: B023, E731
        w, b = w - step(m, v), b - 5 * float(step(mb, vb))
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = 1500, longest: int = 60_000) -> Model:
    """Fits on labelled rows whose crc32(key as text) mod 3 is not 1: at most ``per_class`` keys of each class, and of
    rows that share a key the one with the smallest hash of its text."""
    own = labels.filter(f"`{key}` is not null and toxic is not null and crc32(cast(cast(`{key}` as string) as binary)) % 3 <> 1")
    own = own.groupBy(key).agg(F.max("toxic").alias("toxic"))
    n, n_toxic = own.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # at most 2 * per_class keys
    order = [F.xxhash64(key), F.col(key)]
    picked = own.filter("toxic = 1").orderBy(*order).limit(per_class).union(own.filter("toxic = 0").orderBy(*order).limit(per_class))
    met = docs.select(key, text).join(F.broadcast(picked), key).filter(F.length(text) <= longest)
    # one row a key, so that no key brings more than its share to the driver
    rows = met.groupBy(key, "toxic").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias(text)).collect()
    rows.sort(key=lambda r: (r[key], r[text]))
    texts, toxic = [r[text] for r in rows], [int(r["toxic"]) for r in rows]
    del rows
    model = fit(texts, toxic, n_toxic / n if n else None)
    del texts
    give_back()  # the driver goes on for long after this
    return model


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            for part in text_slices(batch, text):
                yield arrow_batch(part, keep, score=pa.array([score(x) for x in part.column(text).to_pylist()], pa.float64()))

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), run, with_fields(docs, keep, score="double"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, ["doc_id"]).select(
        "doc_id",
        F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
