"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks. The matrix says how many rows of each block go to each shard; it is drawn from
the distribution that a uniform shuffle of all rows would give, so shard sizes are exact. Each
block permutes its rows and deals them out by the matrix; shards permute what they got. Every
assignment of rows to places is equally likely, up to the quality of the hash and generator.

The matrix has ``BLOCKS`` rows at most, whatever the number of rows, and is all that the driver
sees. Permutations are orders of a seeded hash of the row's number, so a lost task gives the same
rows again; the numbers are fixed by storing the rows first.

Edge cases: rows that repeat are placed each; nulls in any column are values like others; with
fewer rows than shards some shards stay empty; an empty table gives no row.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import fresh, stored

#: The most blocks, and the most parts into which the places of all shards are cut.
BLOCKS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, taken without replacement, are good.

    Inversion outwards from the mode, by the ratios of neighbouring probabilities. The mode's own
    is taken a little too small, and what is then left over is drawn again: so the ratios alone
    decide, and the rounding of the logarithms does not matter.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = 0.99 * math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    while True:
        left = rng.random() - top
        if left <= 0:
            return mode
        up = down = top
        a = b = mode
        while a < high or b > low:
            if a < high:
                up *= (good - a) * (drawn - a) / ((a + 1) * (bad - drawn + a + 1))
                a += 1
                left -= up
                if left <= 0:
                    return a
            if b > low:
                down *= b * (bad - drawn + b) / ((good - b + 1) * (drawn - b + 1))
                b -= 1
                left -= down
                if left <= 0:
                    return b
            if up < 1e-300 and down < 1e-300:
                break


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], rng: random.Random) -> list[list[int]]:
    """How many rows of each block go to each shard: rows add up to the blocks' sizes, columns to the shards'."""
    free, out = list(shard_sizes), []
    for size in block_sizes:
        rest, others, row = size, sum(free), []
        for s, room in enumerate(free):
            others -= room
            n = hypergeometric(rng, room, others, rest)
            row.append(n)
            free[s] -= n
            rest -= n
        out.append(row)
    return out


def shuffled(df: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform permutation cut into shards whose sizes differ by one at most.

    A column of ``df`` named so too is an error.
    """
    spark = df.sparkSession
    number, block, rank, key, part = (fresh(df, c) for c in ("_number", "_block", "_rank", "_key", "_part"))
    rows = stored(df.withColumn(number, F.monotonically_increasing_id()), "sharding-rows")
    total = rows.count()
    blocks = max(16, min(BLOCKS, total >> 17))
    placed = rows.withColumn(block, F.expr(f"pmod(xxhash64({seed}, `{number}`), {blocks})"))
    sizes = {r[0]: r[1] for r in placed.groupBy(block).count().collect()}
    names = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in names], [total // shards + (s < total % shards) for s in range(shards)], random.Random(seed))
    ends = [(b, [sum(row[: s + 1]) for s in range(shards)]) for b, row in zip(names, matrix, strict=True)]
    # a row for each block: at most BLOCKS
    deal = F.broadcast(spark.createDataFrame(ends, f"{block} long, {part} array<long>"))
    local = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), number), number)
    dealt = placed.withColumn(rank, F.row_number().over(local) - 1).join(deal, block)
    dealt = dealt.withColumn("shard", F.expr(f"size(filter(`{part}`, e -> e <= `{rank}`))")).drop(block, rank, part)
    # the second permutation: an order by hash, cut into parts by the hash's first bits
    parts = max(2, min(BLOCKS, total >> 17))
    dealt = dealt.withColumn(key, F.xxhash64(F.lit(seed + 2), number)).withColumn(part, F.expr(f"int(shiftrightunsigned(`{key}`, 32) * {parts} div {1 << 32})"))
    dealt = stored(dealt, "sharding-dealt")
    counts = dealt.groupBy("shard", part).agg(F.count("*").alias(rank))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each shard and part
    bases = counts.select("shard", part, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(block))
    unsigned = F.expr(f"`{key}` ^ {-1 << 63}")
    inside = Window.partitionBy("shard", part).orderBy(unsigned, number)
    out = dealt.withColumn(rank, F.row_number().over(inside) - 1).join(F.broadcast(bases), ["shard", part])
    return out.withColumn("slot", F.col(block) + F.col(rank)).select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")


def write_shards(df: DataFrame, shards: int, folder: str, seed: int = 42, rows_per_file: int = 1 << 20) -> None:
    """Writes a uniform shuffle of whole rows as Parquet: a folder for each shard, with files of at most
    ``rows_per_file`` rows that are sorted by slot."""
    placed = shuffled(df, shards, seed)
    placed = placed.withColumn("file", F.expr(f"slot div {rows_per_file}"))
    placed.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").write.partitionBy("shard", "file").parquet(folder)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(rows, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
