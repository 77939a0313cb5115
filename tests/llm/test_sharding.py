"""The shuffle's exact sizes, its distribution, and its files."""

import math
import random
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import sharding


@pytest.mark.parametrize("good,bad,drawn", [(5, 7, 4), (3, 20, 21), (0, 4, 2), (4, 0, 3), (6, 6, 12), (10, 5, 0), (40, 300, 100)])
def test_hypergeometric(good, bad, drawn):
    rng, n = random.Random(1), 20_000
    got = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    for k in range(drawn + 1):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) if k <= good and drawn - k <= bad else 0
        assert abs(got[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1e-9


def test_large_draws():
    rng = random.Random(2)
    own = [sharding.hypergeometric(rng, 10**9, 7 * 10**9, 10**6) for _ in range(300)]
    mean, sd = 125_000, math.sqrt(1e6 / 8 * 7 / 8)
    assert abs(sum(own) / 300 - mean) < 5 * sd / math.sqrt(300)
    assert 0.8 < math.sqrt(sum((x - mean) ** 2 for x in own) / 300) / sd < 1.2


def test_matrix():
    rng = random.Random(3)
    for _ in range(200):
        blocks = [rng.randrange(0, 9) for _ in range(rng.randrange(1, 6))]
        n, k = sum(blocks), rng.randrange(1, 6)
        shards = [n // k + (s < n % k) for s in range(k)]
        matrix = sharding.communication_matrix(blocks, shards, rng)
        assert [sum(r) for r in matrix] == blocks and [sum(c) for c in zip(*matrix, strict=True)] == shards


def test_matrix_is_that_of_a_uniform_shuffle():
    """Each table's share is its number of permutations."""
    items, cut = "aabbc", [3, 2]
    want = Counter()
    for p in permutations(range(5)):
        row = [items[i] for i in p]
        want[tuple(tuple(row[s:e].count(b) for s, e in ((0, 3), (3, 5))) for b in "abc")] += 1
    rng, n = random.Random(4), 30_000
    got = Counter(tuple(map(tuple, sharding.communication_matrix([2, 2, 1], cut, rng))) for _ in range(n))
    assert set(got) == set(want)
    for t, m in want.items():
        p = m / 120
        assert abs(got[t] - n * p) < 5 * math.sqrt(n * p * (1 - p))


def gapless(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("n,shards", [(0, 8), (1, 8), (5, 8), (8, 8), (1003, 8), (1003, 3), (50, 1)])
def test_shuffled(spark, n, shards):
    df = spark.range(n).selectExpr("id % 7 as _number", "if(id % 3 = 0, null, id) as _block", "'x' as _part")
    rows = sharding.shuffled(df, shards).collect()
    gapless(rows, shards)
    assert Counter((r._number, r._block) for r in rows) == Counter((i % 7, None if i % 3 == 0 else i) for i in range(n))


def test_parts_in_order(spark, monkeypatch):
    """Many blocks and parts: slots stay gapless over the parts' borders, and each seed gives its own order."""
    monkeypatch.setattr(sharding, "BLOCKS", 64)
    rows = sharding.shuffled(spark.range(0, 3000, 1, 5).withColumn("x", F.lit(1)), 4).collect()
    gapless(rows, 4)
    other = sharding.shuffled(spark.range(0, 3000, 1, 5).withColumn("x", F.lit(1)), 4, seed=7).collect()
    assert {r.id: r.slot for r in rows} != {r.id: r.slot for r in other}
    again = sharding.shuffled(spark.range(0, 3000, 1, 5).withColumn("x", F.lit(1)), 4).collect()
    assert {r.id: (r.shard, r.slot) for r in rows} == {r.id: (r.shard, r.slot) for r in again}


def test_places_are_uniform(spark):
    """Over seeds, each quarter of the input comes to each shard and half of the slots alike."""
    met, trials = Counter(), 12
    df = spark.range(0, 400, 1, 4)
    for seed in range(trials):
        for r in sharding.shuffled(df, 4, seed * 100).collect():
            met[r.id // 100, r.shard, r.slot // 50] += 1
    want = trials * 400 / 32
    assert sum((met[q, s, h] - want) ** 2 / want for q in range(4) for s in range(4) for h in range(2)) < 60


def test_files(spark, tmp_path):
    docs = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text"))
    sharding.write_shards(docs, 3, f"{tmp_path}/out", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    gapless(back, 3)
    assert sorted((r.id, r.text) for r in back) == [(i, f"text {i}") for i in range(100)]
    assert all(r.file == r.slot // 10 for r in back)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sharding.op13_sharding(spark, "/root/testdata/sf0.001").collect()
    gapless(rows, 8)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
