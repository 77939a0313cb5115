"""SimHash fingerprints and near-duplicate groups through sharded BK-trees.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks.
Each choice of that many blocks and their bits names a shard; two linked fingerprints meet in at
least one. A shard has a BK-tree: a node's children are keyed by their integer distance to it, and
a search follows only the edges within the radius of its own distance. With 8 blocks of 8 bits and
radius 2 a shard's fingerprints differ in 16 bits only, so it holds at most 65,536 of them, however
large the corpus or a group of copies. The trees are built where their shards are shuffled to: all
of them together grow with the corpus and are not broadcast.

Copies count once, since the trees hold distinct fingerprints. A shard returns a link from each
fingerprint to the smallest of its connected ones, not all pairs.

Edge cases: null and empty texts have fingerprint 0 and are linked like any other; repeated rows
fall into one group; a null key counts as larger than any in choosing a group's smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import arrow_batch, map_texts, stored, text_slices, with_fields
from lumenlake.llm.components import components


def shingle_hashes(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The hashes of all shingles, in arrays of at most 65,536; none for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), 1 << 16):
        yield np.fromiter([digest(s, seed) for s in shingles[i : i + (1 << 16)]], dtype="<u8")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bits that over half of the shingles' hashes have."""
    n, counts = 0, np.zeros(64, dtype=np.int64)
    for hashes in shingle_hashes(text, words, seed):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                fps = np.array([fingerprint(x or "", words) for x in part.column(text).to_pylist()], dtype=np.uint64)
                yield arrow_batch(part, keep, fp=pa.array(fps.view(np.int64)))

    return map_texts(df.select(*dict.fromkeys([*keep, text])), run, with_fields(df, keep, fp="long"))


class BkTree:
    """Integers of 64 bits under Hamming distance; (value, {distance: child})."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, ahead = [], [self.root] if self.root else []
        while ahead:
            own, children = ahead.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                ahead += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


    def first_within(self, value: int, radius: int) -> int | None:
        """One within the radius, the first that the search meets."""
        ahead = [self.root] if self.root else []
        while ahead:
            own, children = ahead.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                return own
            if children:
                ahead += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return None


def group_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect all distinct ``values`` within the radius of each other.

    Each group that is connected so far has a tree of its own. A value needs one hit in it, so a crowd of
    like values costs a few steps each and not its square.
    """
    groups: list[tuple[BkTree, list[int]]] = []
    links = []
    for v in values:
        met, apart = [], []
        for g in groups:
            u = g[0].first_within(v, radius)
            if u is None:
                apart.append(g)
            else:
                met.append(g)
                links.append((v, u))
        tree, own = max(met, key=lambda g: len(g[1]), default=(BkTree(), []))
        for x in [v, *(x for g in met if g[1] is not own for x in g[1])]:
            tree.add(x)
            own.append(x)
        groups = [*apart, (tree, own)]
    return links


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """For each value linked to others of its shard: the value and the smallest it reaches."""
    tree, seen, links = BkTree(), set(), []
    for v in values:
        tree.add(v)
    for start in sorted(values):
        if start in seen:
            continue
        seen.add(start)
        ahead = [start]
        while ahead:
            for other in tree.within(ahead.pop(), radius):
                if other not in seen:
                    seen.add(other)
                    ahead.append(other)
                    links.append((other, start))
    return links


def links(fps: DataFrame, radius: int = 2, blocks: int = 8) -> DataFrame:
    """Distinct fingerprints ``fp`` to links (a, b) that connect all within ``radius``."""
    width = 64 // blocks
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("shard"),
    )
    shards = keyed.groupBy("shard").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for values in batch.column(0).to_pylist():
                found.update(shard_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius))
            ends = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return shards.select("fps").mapInArrow(run, "a long, b long")


def near_duplicates(prints: DataFrame, key: str = "doc_id", radius: int = 2) -> DataFrame:
    """``prints`` (a stored table with ``key`` and ``fp``) with ``component_id``, the smallest key
    of those reachable over links."""
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the stored table has few files
    roots = components(links(distinct.repartition(tasks, "fp"), radius))
    grouped = roots.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = stored(grouped, "simhash-groups")
    of_fp = roots.join(grouped, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("in_group"))
    ids = distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("in_group", "first").alias("component_id"))
    return prints.join(stored(ids, "simhash-ids"), "fp", "left")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = stored(fingerprints(docs, ["doc_id"]), "simhash-prints")
    return near_duplicates(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
