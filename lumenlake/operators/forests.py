"""Extremely randomised trees, grown over all rows at once.

Nodes of more than ``local_rows`` training rows are split level by level: each task sums what its
rows say of the open nodes (ranges of the drawn features, then class weights on both sides of the
drawn cuts), and only these sums are shuffled. Once a node is small, its rows go to one task that
finishes its subtree. So a task never holds more than ``local_rows`` training rows of a tree, and
while all rows are that few, a task gets them once for a block of trees. Held-out rows travel with
the node they fall in and are answered there; no tree is ever gathered.

Features and cuts are drawn from a generator or a hash seeded by tree and node, so a lost task draws
the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.quantiles import PLAIN, exact_quantiles
from lumenlake.sources.scratch import stored

#: Open nodes whose drawn features a pass sends to all tasks; beyond it trees are grown in several passes.
MOST_OPEN = 1 << 18


def generator(seed: int, tree: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, tree, node])


def best_cut(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, least: int) -> int:
    """The candidate with the purest sides by Gini, -1 where none leaves ``least`` rows on both.

    ``left`` and ``right`` have a row of class weights for each candidate.
    """
    impurity = lambda w: w.sum(axis=1) - (w * w).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300)
    cost = np.where((n_left >= least) & (n_right >= least), impurity(left) + impurity(right), np.inf)
    at = int(np.argmin(cost)) if len(cost) else -1
    return at if at >= 0 and np.isfinite(cost[at]) else -1


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of a hash (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _uniform(keys: np.ndarray, columns: int, stream: int) -> np.ndarray:
    """A number from 0 to 1 for each column (down) and key (across)."""
    own = _mixed(np.arange(columns, dtype=np.uint64) + np.uint64(stream << 32))
    return (_mixed(keys[None, :] ^ own[:, None]) >> np.uint64(11)) * 2.0**-53


def grown(x: np.ndarray, y: np.ndarray, weights: np.ndarray, held: np.ndarray, seed: int, tree: int, node: int, tries: int, least: int) -> tuple[np.ndarray, list[tuple]]:
    """Class 1's share in the leaf of each held-out row, and the leaves as (node, weight of 0, weight of 1, rows).

    ``x`` and ``y`` are of the training rows below ``node``, ``weights`` of the two classes. A node
    draws features until ``tries`` of them vary within it, each with one cut between its ends. All
    nodes of a level are split together, their rows side by side; draws are hashes of seed, tree and
    way. Numbers of nodes more than 62 levels down repeat.
    """
    shares, leaves = np.zeros(len(held)), []
    if not len(y):
        return shares + 0.5, [(node, 0.0, 0.0, 0)]
    varied = np.flatnonzero(x.min(axis=0) < x.max(axis=0))
    columns, asked, one = np.ascontiguousarray(x[:, varied].T), np.ascontiguousarray(held[:, varied].T), (y == 1).astype(np.int64)
    keys = generator(seed, tree, node).integers(1 << 63, size=1, dtype=np.uint64)
    own, sizes, ids = np.arange(len(y)), np.array([len(y)]), np.array([node], np.uint64)
    who, where = np.arange(len(held)), np.zeros(len(held), np.int64)
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        n1 = np.add.reduceat(one[own], starts)
        best, feature, cut = np.full(len(sizes), np.inf), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        able = (sizes >= 2 * least) & (n1 > 0) & (n1 < sizes)
        if len(varied) and able.any():
            mine, size, m1 = own[np.repeat(able, sizes)], sizes[able], n1[able]
            at, nodes = np.cumsum(size) - size, np.arange(len(size))
            group = np.repeat(nodes, size)
            code = 1 + (one[mine] << 32)  # a row, and whether it is of class 1
            order, u = np.argsort(_uniform(keys[able], len(varied), 1), axis=0), _uniform(keys[able], len(varied), 2)
            cost, its, its_cut, met = np.full(len(size), np.inf), np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size), np.int64)
            for k in range(len(varied)):
                rest = met < tries
                if not rest.any():
                    break
                if not rest.all():  # nodes that have not met enough features that vary
                    some = np.repeat(rest[nodes], size)
                    mine, code, size, m1, nodes = mine[some], code[some], size[rest[nodes]], m1[rest[nodes]], nodes[rest[nodes]]
                    at, group = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
                f = order[k, nodes]
                values = columns[f[group], mine]
                low, high = np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)
                c = low + u[k, nodes] * (high - low)
                c = np.where(c >= high, low, c)
                left = np.add.reduceat(np.where(values <= c[group], code, 0), at)
                n_left, left1 = left & 0xFFFFFFFF, left >> 32
                sides = [((n - o) * weights[0], o * weights[1]) for n, o in ((n_left, left1), (size - n_left, m1 - left1))]
                impure = sum(w0 + w1 - (w0 * w0 + w1 * w1) / np.maximum(w0 + w1, 1e-300) for w0, w1 in sides)
                impure = np.where((high > low) & (n_left >= least) & (size - n_left >= least), impure, np.inf)
                better = impure < cost[nodes]
                now = nodes[better]
                cost[now], its[now], its_cut[now] = impure[better], f[better], c[better]
                met[nodes] += high > low
            best[able], feature[able], cut[able] = cost, its, its_cut
        split = np.isfinite(best)
        w0, w1 = (sizes - n1) * weights[0], n1 * weights[1]
        done = ~split
        leaves += zip(ids[done].astype(np.int64).tolist(), w0[done].tolist(), w1[done].tolist(), sizes[done].tolist(), strict=True)
        ends = done[where]
        shares[who[ends]] = (w1 / (w0 + w1))[where[ends]]
        place = np.cumsum(split) - 1
        who, where = who[~ends], where[~ends]
        if len(who):
            where = 2 * place[where] + (asked[feature[where], who] > cut[where])
        own, group = own[np.repeat(split, sizes)], np.repeat(place[split], sizes[split])
        if not len(own):
            break
        right = columns[feature[split][group], own] > cut[split][group]
        at = np.cumsum(sizes[split]) - sizes[split]
        n_right = np.add.reduceat(right.astype(np.int64), at)
        before = np.cumsum(right) - right
        before -= before[at][group]
        to = np.where(right, (at + sizes[split] - n_right)[group] + before, np.arange(len(own)) - before)
        moved = np.empty_like(own)
        moved[to] = own
        own, sizes = moved, np.stack([sizes[split] - n_right, n_right], axis=1).ravel()
        ids = (2 * ids[split][:, None] + np.arange(2, dtype=np.uint64)).ravel()
        keys = _mixed(keys[split][:, None] + np.arange(1, 3, dtype=np.uint64)).ravel()
    return shares, leaves


class Splits:
    """The splits found so far: by (tree, node), the feature and the cut."""

    def __init__(self, found: dict[tuple[int, int], tuple[int, float]]):
        keys = sorted(found)
        self.keys = np.array([t << 32 | n for t, n in keys], dtype=np.int64)
        self.features = np.array([found[k][0] for k in keys], dtype=np.int64)
        self.cuts = np.array([found[k][1] for k in keys], dtype=np.float64)

    def nodes(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """The deepest node of each row (down) in each tree (across)."""
        at = np.ones((len(x), len(trees)), dtype=np.int64)
        if not len(self.keys):
            return at
        moving, rows = np.ones(at.shape, bool), np.arange(len(x))[:, None]
        while moving.any():
            key = trees[None, :] << 32 | at
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            moving = self.keys[i] == key
            at = np.where(moving, 2 * at + (x[rows, self.features[i]] > self.cuts[i]), at)
        return at


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _imputed(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    """Missing values take the median, and for each feature one more says where they were."""
    gone = np.isnan(x)
    return np.hstack([np.where(gone, medians, x), gone])


class Forest:
    """What all passes share: the fold's medians and class weights, and how trees are numbered: ``model * trees + tree``."""

    def __init__(self, medians: np.ndarray, weights: np.ndarray, tries: np.ndarray, trees: int, least: int, seed: int):
        self.medians, self.weights, self.tries, self.trees, self.least, self.seed = medians, weights, tries, trees, least, seed

    def slices(self, batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[tuple]:
        """(batch, model, imputed rows, trees of the model among ``own``)."""
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                x = _matrix(part)
                for model in np.unique(own // self.trees).tolist():
                    yield part, model, _imputed(x, self.medians[model]), own[own // self.trees == model]


def _fitted(rows: DataFrame, folds: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fold's training rows: medians, balanced class weights, and how many features a node tries."""
    trained = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col("model") != F.col("fold"))
    counts = {(r.model, r.y): r.n for r in trained.groupBy("model", "y").agg(F.count("*").alias("n")).collect()}
    total = max([sum(counts.get((m, c), 0) for c in (0, 1)) for m in range(folds)])
    cells = trained.select("model", F.posexplode("x").alias("i", "v"))
    here = cells.filter(~F.isnan("v"))
    found = here.groupBy("model", "i").agg(F.count("*").alias("n"), F.median("v").alias("m")) if total <= PLAIN else exact_quantiles(here, ["model", "i"], "v", [0.5]).select("model", "i", "n", F.col("q")[0].alias("m"))
    medians, known = np.zeros((folds, width)), np.zeros((folds, width), np.int64)
    for r in found.collect():  # a row for each fold and feature
        medians[r.model, r.i], known[r.model, r.i] = r.m, r.n
    n = np.array([[counts.get((m, c), 0) for c in (0, 1)] for m in range(folds)])
    weights = n.sum(axis=1, keepdims=True) / np.maximum(2 * n, 1)
    tries = np.sqrt(width + (known < n.sum(axis=1, keepdims=True)).sum(axis=1)).astype(int)
    return medians, weights, np.maximum(tries, 1)


def _level(rows: DataFrame, forest: Forest, splits: Splits, open_nodes: list[tuple[int, int]], width: int) -> dict[tuple[int, int], tuple]:
    """For each open node (tree, node) that can be split: feature, cut, and the training rows left and right.

    Two passes of map-side sums. Of twice as many drawn features the first ``tries`` that vary are tried.
    """
    spark = rows.sparkSession
    keys = np.array(sorted(t << 32 | n for t, n in open_nodes), dtype=np.int64)
    most = 2 * int(forest.tries.max())
    drawn = np.array([generator(forest.seed, int(k >> 32), int(k & 0xFFFFFFFF)).permutation(2 * width)[:most] for k in keys])
    sent = spark.sparkContext.broadcast((keys, drawn, splits))

    def met(batches: Iterator[pa.RecordBatch], own: np.ndarray, at_splits: Splits, at_keys: np.ndarray):
        for part, model, x, trees in forest.slices(batches, own):
            trains = part.column("fold").to_numpy() != model
            x, y = x[trains], part.column("y").to_numpy()[trains]
            if len(x):
                key = trees[None, :] << 32 | at_splits.nodes(x, trees)
                i = np.minimum(np.searchsorted(at_keys, key), len(at_keys) - 1)
                row, column = np.nonzero(at_keys[i] == key)
                yield x, y, row, i[row, column]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_keys, features, at_splits = sent.value
        low, high = np.full(features.shape, np.inf), np.full(features.shape, -np.inf)
        for x, _, row, node in met(batches, np.unique(at_keys >> 32), at_splits, at_keys):
            values = x[row[:, None], features[node]]
            np.minimum.at(low, node, values)
            np.maximum.at(high, node, values)
        there = np.flatnonzero(np.isfinite(low[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(low[there].tolist(), pa.list_(pa.float64())), pa.array(high[there].tolist(), pa.list_(pa.float64()))], names=["node", "low", "high"])

    ends = rows.mapInArrow(ranges, "node long, low array<double>, high array<double>").select("node", F.posexplode(F.arrays_zip("low", "high")).alias("i", "e"))
    ends = ends.groupBy("node", "i").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).toArrow().to_pydict()
    low, high = np.zeros(drawn.shape), np.zeros(drawn.shape)
    low[ends["node"], ends["i"]], high[ends["node"], ends["i"]] = ends["low"], ends["high"]
    features, cuts = np.zeros((len(keys), most // 2), np.int64), np.full((len(keys), most // 2), np.inf)
    for k, key in enumerate(keys.tolist()):
        own = np.flatnonzero(high[k] > low[k])[: forest.tries[(key >> 32) // forest.trees]]
        rng = generator(forest.seed + 1, key >> 32, key & 0xFFFFFFFF)
        cut = low[k, own] + rng.random(len(own)) * (high[k, own] - low[k, own])
        features[k, : len(own)], cuts[k, : len(own)] = drawn[k, own], np.where(cut >= high[k, own], low[k, own], cut)
    told = spark.sparkContext.broadcast((keys, features, cuts, splits))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_keys, own, at_cuts, at_splits = told.value
        sums = np.zeros((*own.shape, 4), np.int64)
        for x, y, row, node in met(batches, np.unique(at_keys >> 32), at_splits, at_keys):
            side = 2 * (x[row[:, None], own[node]] > at_cuts[node]) + y[row][:, None]
            np.add.at(sums, (node[:, None], np.arange(own.shape[1])[None, :], side), 1)
        there = np.flatnonzero(sums.any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there].reshape(len(there), -1).tolist(), pa.list_(pa.int64()))], names=["node", "n"])

    summed = rows.mapInArrow(sides, "node long, n array<bigint>").select("node", F.posexplode("n").alias("i", "n"))
    summed = summed.groupBy("node", "i").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts = np.zeros((len(keys), features.shape[1] * 4), np.int64)
    counts[summed["node"], summed["i"]] = summed["n"]
    out = {}
    for k, key in enumerate(keys.tolist()):
        c = counts[k].reshape(-1, 4)
        w = forest.weights[(key >> 32) // forest.trees]
        n_left, n_right = c[:, 0] + c[:, 1], c[:, 2] + c[:, 3]
        best = best_cut(c[:, :2] * w, c[:, 2:] * w, n_left, n_right, forest.least)
        if best >= 0 and c[best, 0::2].sum() and c[best, 1::2].sum():
            out[key >> 32, key & 0xFFFFFFFF] = int(features[k, best]), float(cuts[k, best]), int(n_left[best]), int(n_right[best])
    return out


def _finish(forest: Forest, leaves: bool):
    """Grows the trees of one group below its node, and answers its held-out rows or lists the leaves."""

    def run(table: pa.Table) -> pa.Table:
        first, n_trees, node, model = (table.column(c)[0].as_py() for c in ("tree", "n_trees", "node", "model"))
        batch = table.combine_chunks().to_batches()[0]
        x = _imputed(_matrix(batch), forest.medians[model])
        held = batch.column("fold").to_numpy() == model
        y, total, found = batch.column("y").to_numpy(), np.zeros(int(held.sum())), []
        for tree in range(first, first + n_trees):
            shares, own = grown(x[~held], y[~held], forest.weights[model], x[held], forest.seed, tree, node, int(forest.tries[model]), forest.least)
            total += shares
            found += [(tree, *leaf) for leaf in own]
        if leaves:
            return pa.table(dict(zip(("tree", "node", "w0", "w1", "n"), map(list, zip(*found, strict=True)), strict=True)), schema=pa.schema([("tree", pa.int64()), ("node", pa.int64()), ("w0", pa.float64()), ("w1", pa.float64()), ("n", pa.int64())]))
        return pa.table({"row": batch.column("row").filter(pa.array(held)), "total": total, "n_trees": np.full(len(total), n_trees, np.int64)})

    return run


def out_of_fold_trees(rows: DataFrame, features: list[str], label: str, fold: str, folds: int, trees: int = 500, least: int = 3, seed: int = 0, local_rows: int = 500_000, block: int = 50, leaves: bool = False) -> DataFrame:
    """``session_id, label, probability, fold, prediction_origin`` of extremely randomised trees that never see the fold
    they predict: the mean over ``trees`` trees of class 1's weighted share in the row's leaf.

    Classes are balanced by weight, a node tries as many features as the root of their number, a
    leaf has ``least`` training rows at least; missing values take the training median, with an
    indicator for each feature. Null or NaN counts as missing, an infinite value is an error of
    the caller; labels other than 0 and 1 and null folds are left out. ``leaves`` returns the
    leaves instead: (tree, node, w0, w1, n), trees numbered fold by fold. ``local_rows`` bounds a
    task's memory: about a kilobyte a row with a dozen features. Up to so many rows, all are
    dealt once for each ``block`` of trees, else once for each tree.
    """
    spark = rows.sparkSession
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    base = rows.filter(F.col(label).isin(0, 1) & F.col(fold).between(0, folds - 1)).select("session_id", F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"), values.alias("x"))
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "forest-rows")
    n, width = base.count(), len(features)
    origin = F.lit("participant_out_of_fold").alias("prediction_origin")
    if not n:
        return base.select("session_id", F.col("y").alias("label"), F.lit(0.0).alias("probability"), "fold", origin)
    forest = Forest(*_fitted(base, folds, width), trees, least, seed)
    answered = "tree long, node long, w0 double, w1 double, n long" if leaves else "row long, total double, n_trees long"
    narrow = base.select("row", "y", "fold", "x")
    if n <= local_rows:
        at = F.explode(F.expr(f"flatten(transform(sequence(0, {folds - 1}), m -> transform(sequence(0, {trees - 1}, {block}), t -> struct(m as model, bigint(m * {trees} + t) as tree, bigint(least({block}, {trees} - t)) as n_trees, 1L as node))))"))
        dealt = narrow.select("*", at.alias("g")).select("row", "y", "fold", "x", "g.*")
        parts = dealt.groupBy("model", "tree").applyInArrow(_finish(forest, leaves), answered)
    else:
        per = max(1, MOST_OPEN * local_rows // (4 * n * 2 * int(forest.tries.max())))
        parts = None
        for start in range(0, folds * trees, per):
            own = np.arange(start, min(folds * trees, start + per))
            found: dict[tuple[int, int], tuple[int, float]] = {}
            open_nodes = [(int(t), 1) for t in own]
            while open_nodes:
                new = _level(narrow, forest, Splits(found), open_nodes, width)
                found |= {k: s[:2] for k, s in new.items()}
                open_nodes = [(t, c) for (t, node), s in new.items() for c, m in ((2 * node, s[2]), (2 * node + 1, s[3])) if m > local_rows and c < 1 << 30]
            sent = spark.sparkContext.broadcast(Splits(found))

            def route(batches: Iterator[pa.RecordBatch], own=own, sent=sent) -> Iterator[pa.RecordBatch]:
                for part, model, x, its in forest.slices(batches, own):
                    nodes = sent.value.nodes(x, its)
                    at = pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, len(its)).astype(np.int32)), pa.array(nodes.ravel()))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "y", "fold", "x")], pa.array(np.full(len(x), model)), pa.array(np.full(len(x), int(its[0]))), at], names=["row", "y", "fold", "x", "model", "first", "nodes"])

            routed = narrow.mapInArrow(route, "row long, y int, fold int, x array<double>, model long, first long, nodes array<bigint>")
            routed = routed.select("row", "y", "fold", "x", "model", "first", F.posexplode("nodes").alias("i", "node")).withColumns({"tree": F.col("first") + F.col("i"), "n_trees": F.lit(1).cast("long")})
            done = routed.select("row", "y", "fold", "x", "model", "tree", "n_trees", "node").groupBy("model", "tree", "node").applyInArrow(_finish(forest, leaves), answered)
            parts = done if parts is None else parts.unionByName(done)
    if leaves:
        return parts
    shares = parts.groupBy("row").agg((F.sum("total") / F.sum("n_trees")).alias("probability"))
    return base.select("row", "session_id", F.col("y").alias("label"), "fold").join(shares, "row").select("session_id", "label", "probability", "fold", origin)
