"""The text baseline: TF-IDF of words and word pairs with a class-balanced logistic regression, out of fold.

All folds are fitted at once. Term statistics of a fold's training rows are those of all rows less
its own; each fold has its vocabulary of at most ``most`` terms, so weights and gradients have a
bound that does not grow with the texts. Terms are counted row by row within tasks, and what is
shuffled is a batch's count of each term. A row's terms are stored once for all folds. A pass of the
solver is one scan of the stored vectors: each task adds up its rows' gradient for every fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.sources.scratch import stored

WORDS = r"[\p{L}\p{N}_]{2,}"
BLOCK = ["r", "y", "fold", "length", "n", "term", "tf"]
#: Bytes of sums that a pass sends to the driver.
SENT = 48 << 20
#: Bytes of text whose words a task takes at once.
PART = 3 << 20


class Lbfgs:
    """Limited-memory BFGS that asks for one value and gradient at a time, so that many run in step.

    ``curvature`` bounds the second derivatives from above; steps start from its inverse.
    """

    def __init__(self, curvature: np.ndarray, tolerance: float, memory: int = 20):
        self.x, self.curvature, self.tolerance, self.memory = np.zeros(len(curvature)), curvature, tolerance, memory
        self.value, self.gradient, self.pairs, self.step, self.done = np.inf, None, [], 1.0, False
        self.way = np.zeros(len(curvature))

    def asks(self) -> np.ndarray:
        return self.x + self.step * self.way

    def told(self, value: float, gradient: np.ndarray) -> None:
        """Takes the step if it lowers the value enough, else halves it."""
        if self.gradient is not None:
            if value > self.value + 1e-4 * self.step * (self.gradient @ self.way) and self.step > 1e-12:
                self.step /= 2
                return
            s, y = self.step * self.way, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.x, self.value, self.gradient = self.asks(), value, gradient
        self.done = np.abs(gradient).max() <= self.tolerance or self.step <= 1e-12
        q, back = gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        q /= self.curvature
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ (y / self.curvature))
        for (s, y), a in zip(self.pairs, reversed(back), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        self.way = -q
        self.step = 1.0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PART`` bytes of text, a row at least."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy()) // PART
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(starts, starts[1:], strict=False) if b > a)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The row and the code of each word, the words by code, and where a word has its row's next one behind it."""
    lists = pc.split_pattern(batch.column("text"), " ")
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
    coded = lists.flatten().dictionary_encode()
    return row, coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.flatnonzero(row[1:] == row[:-1])


def _counted(row: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and how often the row has it, in this order."""
    own, tf = np.unique(row * terms + term, return_counts=True)
    return own // terms, own % terms, tf


def term_counts(rows: DataFrame, folds: int) -> DataFrame:
    """``term, fold, df, n`` of words and word pairs, added up within a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            row, code, names, at = _words(batch)
            m = max(len(names), 1)
            own, term, tf = _counted(np.append(row, row[at]), np.append(code, m + code[at] * m + code[at + 1]), m * (m + 1))
            key, place = np.unique(term * folds + batch.column("fold").to_numpy()[own], return_inverse=True)
            df, n = np.bincount(place, minlength=len(key)), np.bincount(place, tf, len(key)).astype(np.int64)
            for k in range(0, len(key), 50_000):
                part = key[k : k + 50_000] // folds
                single, pair = part[part < m], part[part >= m] - m
                text = pa.concat_arrays([names.take(pa.array(single)), pc.binary_join_element_wise(names.take(pa.array(pair // m)), names.take(pa.array(pair % m)), " ")])
                yield pa.RecordBatch.from_arrays([text, *[pa.array(x[k : k + 50_000]) for x in (key % folds, df, n)]], names=["term", "fold", "df", "n"])

    return rows.select("fold", "text").mapInArrow(run, "term string, fold long, df long, n long")


def fold_vocabularies(rows: DataFrame, folds: int, min_df: int, most: int) -> tuple[list[str], np.ndarray]:
    """The terms of all folds' models in order, and each term's weight in each model (0 where it is no term of it).

    At most ``folds * most`` terms, so they come to the driver and go to all tasks.
    """
    own = lambda c, m: F.sum(F.when(F.col("fold") != m, F.col(c)))
    sums = term_counts(rows, folds).groupBy("term").agg(F.sum("df").alias("_all"), *[own(c, m).alias(f"{c}{m}") for c in ("df", "n") for m in range(folds)])
    terms = stored(sums.filter(F.col("_all") >= min_df).drop("_all"), "text-terms")
    size = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    found, weights = {}, []
    for m in range(folds):
        top = terms.filter(F.col(f"df{m}") >= min_df).orderBy(F.desc(f"n{m}"), "term").limit(most).select("term", F.col(f"df{m}").alias("df")).toArrow()
        n = sum(c for f, c in size.items() if f != m)
        at = np.array([found.setdefault(t, len(found)) for t in top.column("term").to_pylist()], np.int64)
        weights.append((at, np.log((1.0 + n) / (1 + top.column("df").to_numpy())) + 1))
    names = sorted(found)
    place = np.empty(len(names), np.int64)
    place[[found[t] for t in names]] = np.arange(len(names))
    idf = np.zeros((folds, len(names)))
    for m, (at, w) in enumerate(weights):
        idf[m, place[at]] = w
    return names, idf


def fold_vectors(rows: DataFrame, names: list[str], idf: np.ndarray) -> DataFrame:
    """Blocks of rows: ``r``, ``y`` and ``fold`` of each, its length in each model, and its terms with their counts.

    Arrays are stored as bytes, since each pass of the solver reads them.
    """
    context = rows.sparkSession.sparkContext
    split = [t.split(" ") for t in names]
    known = sorted({w for t in split for w in t})
    number = {w: k for k, w in enumerate(known)}
    single = np.full(len(known), -1)
    single[[number[t[0]] for t in split if len(t) == 1]] = [k for k, t in enumerate(split) if len(t) == 1]
    pairs = sorted((number[t[0]] * len(known) + number[t[1]], k) for k, t in enumerate(split) if len(t) == 2)
    sent = context.broadcast((known, single, np.array(pairs, np.int64).reshape(-1, 2), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, single, pairs, idf = sent.value
        values = pa.array(known, pa.string())
        for batch in _parts(batches):
            row, code, words, at = _words(batch)
            word = pc.index_in(words, values).fill_null(-1).to_numpy()[code] if len(code) else code
            key = np.where((word[at] >= 0) & (word[at + 1] >= 0), word[at].astype(np.int64) * len(known) + word[at + 1], -1)
            i = np.minimum(np.searchsorted(pairs[:, 0], key), max(len(pairs) - 1, 0))
            pair = np.where(pairs[i, 0] == key, pairs[i, 1], -1) if len(pairs) else np.full(len(key), -1)
            own, term = np.append(row, row[at]), np.append(np.where(word >= 0, single[word], -1) if len(known) else word, pair)
            own, term, tf = _counted(own[term >= 0], term[term >= 0], max(idf.shape[1], 1))
            square = lambda w: np.bincount(own, ((1 + np.log(tf)) * w[term]) ** 2, batch.num_rows)  # noqa: B023, E731
            length = np.sqrt(np.stack([square(w) for w in idf]))
            told = [batch.column(c).to_numpy().astype(np.int64) for c in ("_r", "y", "fold")]
            told += [length, np.bincount(own, minlength=batch.num_rows), term.astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in told], names=BLOCK)

    return rows.select("_r", "y", "fold", "text").mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK))


class Block:
    """A stored block's arrays, and its rows' scores by ``weights`` (model, term; the last is the intercept)."""

    def __init__(self, batch: pa.RecordBatch, k: int, folds: int):
        raw = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)
        self.r, self.y, self.fold, self.n = (raw(c, np.int64) for c in ("r", "y", "fold", "n"))
        self.length = np.maximum(raw("length", np.float64).reshape(folds, -1), 1e-300)
        self.term, self.value = raw("term", np.int32), 1 + np.log(raw("tf", np.int32))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        z, some = np.zeros((len(weights), len(self.n))), self.n > 0
        if len(self.term):
            starts = (np.cumsum(self.n) - self.n)[some]
            for m, w in enumerate(weights):
                z[m, some] = np.add.reduceat(w[self.term] * self.value, starts)
        return z / self.length + weights[:, -1:]


def fit_folds(blocks: DataFrame, counts: np.ndarray, idf: np.ndarray, penalty: float, tolerance: float = 1e-5, rounds: int = 200) -> np.ndarray:
    """Each fold's weights (of a term's count, then the intercept) over its training rows in stored ``blocks``;
    ``counts`` are its training rows of each class.

    Minimises half the squared length of all weights of unit vectors, the intercept's among them,
    plus ``penalty`` times the class-balanced log loss. A pass sends back one sum for each task, in
    at most as many tasks as keep these within ``SENT`` bytes.
    """
    folds, width = idf.shape
    balance = penalty * counts.sum(axis=1, keepdims=True) / np.maximum(2 * counts, 1)
    own = [np.append(np.flatnonzero(w), width) for w in idf]  # a model's terms and the intercept
    context = blocks.sparkSession.sparkContext
    few = blocks.coalesce(max(1, min(64, SENT // (8 * sum(len(x) + 1 for x in own)))))
    scale = [np.append(w, 1.0)[x] for w, x in zip(idf, own, strict=True)]
    kept = context.broadcast((own, balance))

    def spread(m: int, values: np.ndarray) -> np.ndarray:
        out = np.zeros(width + 1)
        out[own[m]] = values * scale[m]
        return out

    def passed(weights: np.ndarray, going: np.ndarray, squares: bool = False) -> list[np.ndarray]:
        """For each model its own terms' sums, the intercept's and the loss: of the gradient, or of squares weighted by class."""
        sent = context.broadcast((weights, going))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (weights, going), (own, balance) = sent.value, kept.value
            sums = np.zeros((len(going), width + 2))  # terms, intercept, loss
            for batch in batches:
                for k in range(batch.num_rows):
                    b = Block(batch, k, folds)
                    b.length = b.length[going]
                    w = balance[going][:, b.y] * (b.fold != going[:, None])
                    if squares:
                        error, length, value = w, b.length**2, b.value**2
                    else:
                        z, length, value = b.scores(weights), b.length, b.value
                        sums[:, -1] += (w * np.logaddexp(0, np.where(b.y == 1, -z, z))).sum(axis=1)
                        error = w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - b.y)
                    sums[:, -2] += error.sum(axis=1)
                    for m, e in enumerate(error / length):
                        sums[m, :-2] += np.bincount(b.term, np.repeat(e, b.n) * value, width)
            told = np.concatenate([np.append(x[own[m]], x[-1]) for m, x in zip(going, sums, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([told.tobytes()], pa.binary())], names=["sums"])

        total = np.zeros(sum(len(own[m]) + 1 for m in going))
        for x in few.mapInArrow(run, "sums binary").toArrow().column("sums"):
            total += np.frombuffer(x.as_buffer())
        sent.unpersist()
        return np.split(total, np.cumsum([len(own[m]) + 1 for m in going])[:-1])

    everyone = np.arange(folds)
    solvers = [Lbfgs(1 + x[:-1] * w * w / 4, tolerance) for x, w in zip(passed(np.zeros((folds, 1)), everyone, True), scale, strict=True)]
    for _ in range(rounds):
        going = np.flatnonzero([not s.done for s in solvers])
        if not len(going):
            break
        asked = [solvers[m].asks() for m in going]
        got = passed(np.array([spread(m, x) for m, x in zip(going, asked, strict=True)]), going)
        for m, x, sums in zip(going, asked, got, strict=True):
            solvers[m].told(0.5 * (x @ x) + sums[-1], x + sums[:-1] * scale[m])
    return np.array([spread(m, s.x) for m, s in enumerate(solvers)])


def out_of_fold_text(rows: DataFrame, text: str, label: str, fold: str, folds: int, min_df: int = 2, most: int = 50_000, penalty: float = 1.0, tolerance: float = 1e-5) -> DataFrame:
    """``session_id, label, probability, fold, prediction_origin`` of models that never see the fold they predict.

    Rows with a label other than 0 and 1 or without a fold take no part; a null text has no terms,
    and a text without known terms gets the intercept's probability.
    """
    words = F.expr(f"nullif(array_join(regexp_extract_all(lower(`{text}`), '{WORDS}', 0), ' '), '')".replace("\\", "\\\\"))
    base = rows.filter(F.col(label).isin(0, 1) & F.col(fold).between(0, folds - 1)).select("session_id", F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"), words.alias("text"))
    base = stored(base.withColumn("_r", F.monotonically_increasing_id()), "text-rows")
    names, idf = fold_vocabularies(base, folds, min_df, most)
    blocks = stored(fold_vectors(base, names, idf), "text-vectors")
    per = {(r.fold, r.y): r.n for r in base.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    counts = np.array([[sum(n for (f, c), n in per.items() if f != m and c == k) for k in (0, 1)] for m in range(folds)])
    sent = base.sparkSession.sparkContext.broadcast(fit_folds(blocks, counts, idf, penalty, tolerance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block(batch, k, folds)
                z = b.scores(sent.value)[b.fold, np.arange(len(b.fold))]
                yield pa.RecordBatch.from_arrays([pa.array(b.r), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["_r", "probability"])

    asked = blocks.mapInArrow(run, "_r long, probability double")
    return base.select("_r", "session_id", "y", "fold").join(asked, "_r").select("session_id", F.col("y").alias("label"), "probability", "fold", F.lit("participant_out_of_fold").alias("prediction_origin"))
