"""Exact top-k inner products through a pivot-distance index.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and queries get 0, so
that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the largest products are the smallest distances. A vector
is keyed by its nearest pivot and its distance to it. Pivots and the edges of the annuli are fitted
on ``sample`` rows; every row is indexed.

A query starts from the k-th best score of the sample rows. Triangle inequality with the range of
distances of an annulus bounds every score in it; queries go only to annuli that can still matter,
in blocks. There a query expands the sorted distances outwards from its own and stops once the
bound falls below its k-th best score. Large annuli are split, so equal vectors do not meet in one
task. Scores are exact integers; bounds carry a margin above the rounding of doubles.

Edge cases: vectors that are null or hold null or non-finite components take no part; only vectors
of equal length are compared; repeated rows are candidates of each other, a row never of itself;
fewer candidates than k are all returned; keys may be numbers or strings, ties go to the smaller one,
null last; an empty table gives no row; components or products beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenlake.llm.common import stored

#: Share of |q|^2 + M^2 that rounding may take from a bound: a distance from cancelled squares has an
#: error of up to the square root of double precision.
MARGIN = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors, as packed 64-bit integers, to rows of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<i8").reshape(len(column), -1).astype(np.float64) if raw else np.zeros((len(column), 0))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, by Python's integers beyond double precision; what does not fit is an error."""
    top = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, vectors.shape[-1])
    if top < 2**53:
        return (vectors @ query).astype(np.int64)
    exact = vectors.astype(object) @ query.astype(object) if vectors.shape[-1] else np.zeros(len(vectors), dtype=object)
    return np.array([int(x) for x in exact], dtype=np.int64)  # an OverflowError beyond 64 bits


class Index:
    """Pivots and annuli for vectors of one length."""

    def __init__(self, sample: np.ndarray, largest: float, pivots: int, rings: int):
        self.largest, rng = largest, np.random.default_rng(7)
        self.sample = sample
        lifted = self.lift(sample)
        chosen = [0]
        best = ((lifted - lifted[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(sample)) and best.sum() > 0:
            chosen.append(int(rng.choice(len(sample), p=best / best.sum())))
            best = np.minimum(best, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = lifted[chosen]
        near, dist = self.nearest(sample)
        q = np.linspace(0, 1, rings + 1)[1:-1]
        self.edges = [np.unique(np.quantile(dist[near == p], q)) if (near == p).any() else np.zeros(0) for p in range(len(chosen))]

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.largest - (vectors**2).sum(axis=1))
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum(0, (lifted**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * lifted @ p.T))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lift(vectors))
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def ring(self, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(self.edges[p], x) for p, x in zip(near, dist, strict=True)], dtype=np.int64)


def top_k(vectors: DataFrame, key: str, embedding: str, is_query: str, k: int = 10, scale: int = 1024, pivots: int = 32, rings: int = 8, sample: int = 2048, cell: int = 8192) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows that ``is_query`` selects."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType
    ddl, arrow = kind.simpleString(), to_arrow_type(kind)
    e = f"`{embedding}`"
    fits = f"if(abs({scale}D * cast(x as double)) < 9.2e18D, cast(floor({scale}D * cast(x as double)) as bigint), cast(raise_error('a component does not fit in 64 bits') as bigint))"
    rows = vectors.filter(f"{e} is not null and forall({e}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").select(
        F.col(key).alias("id"),
        F.expr(f"transform({e}, x -> {fits})").alias("v"),
        F.expr(f"coalesce({is_query.format(key=f'`{key}`')}, false)").alias("asks"),
    )
    rows = rows.mapInArrow(_pack, f"id {ddl}, v binary, asks boolean, dim int, norm double").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "topk-rows")
    largest = {r["dim"]: r["m"] for r in rows.groupBy("dim").agg(F.max("norm").alias("m")).collect()}
    picked = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(r)
    known = {}
    for dim, top in largest.items():
        own = by_dim.get(dim, [])
        m = np.array([np.frombuffer(r["v"], "<i8") for r in own], dtype=np.float64).reshape(len(own), dim) if own else np.zeros((1, dim))
        known[dim] = (Index(m, top, pivots, rings), [r["row"] for r in own])
    sent = spark.sparkContext.broadcast(known)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), dtype=np.int64)
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                index = sent.value[int(dim)][0]
                near, dist = index.nearest(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "id", "v", "asks", "dim")), pa.array(near), pa.array(index.ring(near, dist)), pa.array(dist)],
                    names=["row", "id", "v", "asks", "dim", "pivot", "ring", "dist"],
                )

    placed = stored(rows.mapInArrow(place, f"row long, id {ddl}, v binary, asks boolean, dim int, pivot long, ring long, dist double"), "topk-placed")
    # one row for each annulus: pivots times rings at most
    stats = [tuple(r) for r in placed.groupBy("dim", "pivot", "ring").agg(F.min("dist"), F.max("dist"), F.count("*")).orderBy("dim", "pivot", "ring").collect()]
    cells: dict[int, list] = {}
    for i, (dim, pivot, _, low, high, n) in enumerate(stats):
        cells.setdefault(dim, []).append((i, pivot, low, high, -(-n // cell)))
    sizes = spark.createDataFrame([(i, d, p, r, -(-n // cell)) for i, (d, p, r, _, _, n) in enumerate(stats)], "cell long, dim int, pivot long, ring long, parts long")
    dealt = placed.join(F.broadcast(sizes), ["dim", "pivot", "ring"]).select("cell", F.expr("pmod(xxhash64(row), parts)").alias("part"), "row", "id", "v", "dist")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                block = whole.slice(begin, 256)
                dims = np.array(block.column("dim").to_pylist(), dtype=np.int64)
                for dim in np.unique(dims):
                    part = block.take(pa.array(np.flatnonzero(dims == dim)))
                    index, own = sent.value[int(dim)]
                    q, rid = _matrix(part.column("v")), part.column("row").to_numpy()
                    floor = np.full(len(q), -np.inf)
                    if len(own) > k:
                        for i in range(len(q)):
                            s = products(index.sample[np.array(own) != rid[i]], q[i])
                            floor[i] = np.partition(s, len(s) - k)[len(s) - k]
                    norm = (q**2).sum(axis=1)
                    d = index.distances(np.hstack([q, np.zeros((len(q), 1))]))
                    out = []
                    for number, pivot, low, high, parts in cells[int(dim)]:
                        gap = np.maximum(0, np.maximum(d[:, pivot] - high, low - d[:, pivot]))
                        best = (norm + index.largest - gap**2) / 2
                        ask = np.flatnonzero(best + MARGIN * (norm + index.largest) >= floor)
                        if len(ask):
                            payload = part.take(pa.array(ask))
                            for p in range(parts):
                                out.append((number, p, payload.column("row").to_pylist(), payload.column("id").to_pylist(), b"".join(payload.column("v").to_pylist()), d[ask, pivot].tolist(), floor[ask].tolist(), index.largest))
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(arrow), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["cell", "part", "rows", "ids", "vs", "dists", "floors", "largest"])

    asked = placed.filter("asks").select("row", "id", "v", "dim").mapInArrow(route, f"cell long, part long, rows array<long>, ids array<{ddl}>, vs binary, dists array<double>, floors array<double>, largest double")
    found = dealt.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(_search(k, arrow), f"query_row long, query_id {ddl}, vec_id {ddl}, score long")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vs = [np.array(v, dtype="<i8") for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([v.tobytes() for v in vs], pa.binary()), batch.column("asks"), pa.array([len(v) for v in vs], pa.int32()), pa.array([float((v.astype(np.float64) ** 2).sum()) for v in vs], pa.float64())],
            names=["id", "v", "asks", "dim", "norm"],
        )


def _search(k: int, arrow: pa.DataType, step: int = 512):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("dist").combine_chunks()
            dist, rows = (left.column(c).to_numpy() for c in ("dist", "row"))
            ids = np.array(left.column("id").to_pylist(), dtype=object)
            v = _matrix(left.column("v").combine_chunks())
            for block in right.to_pylist():
                qs = np.frombuffer(block["vs"], "<i8").reshape(len(block["rows"]), -1).astype(np.float64)
                for q, row, id_, dq, floor in zip(qs, block["rows"], block["ids"], block["dists"], block["floors"], strict=True):
                    for s, i in _expand(v, dist, rows, ids, q, row, dq, floor, block["largest"], k, step):
                        out.append((row, id_, i, s))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), arrow, arrow, pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    return run


def _expand(v, dist, rows, ids, q, row, dq, floor, largest, k, step) -> list[tuple[int, int]]:
    """The best k of one part, from the nearest distances outwards."""
    low = high = int(np.searchsorted(dist, dq))
    reach, best = float((q**2).sum()) + largest, []
    while low > 0 or high < len(dist):
        down = dq - dist[low - 1] if low > 0 else np.inf
        up = dist[high] - dq if high < len(dist) else np.inf
        bound = (reach - max(0.0, min(down, up)) ** 2) / 2
        if bound + MARGIN * reach < floor:
            break
        if down <= up:
            a, b = max(0, low - step), low
            low = a
        else:
            a, b = high, min(len(dist), high + step)
            high = b
        others = a + np.flatnonzero(rows[a:b] != row)
        scores = products(v[others], q)
        keep = np.flatnonzero(scores >= floor)
        if len(keep):
            best += zip(scores[keep].tolist(), ids[others[keep]].tolist(), strict=True)
            best.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            del best[k:]
            if len(best) == k:
                floor = max(floor, best[-1][0])
    return best


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, "vec_id", "embedding", "{key} % 100 = 0")


OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
