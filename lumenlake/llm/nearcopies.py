"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. SimHash: each text has a fingerprint of 512 bits, each bit the majority over its distinct shingles. At a
   similarity of 0.8 a bit differs with a chance of acos(8/9) / pi = 0.15, and of 3/16 at most for sets of four
   and five, so 144 bits are a radius that such pairs pass with a chance of 10^-7 at most. 64 bits are too few:
   at the radius that they need (24), most texts of similarity 0.4 are candidates as well.
2. Shards: at a radius of over a quarter of the bits no choice of bit blocks keeps shards small, so a fingerprint
   is put into ``BANDS`` shards, each keyed by ``ROWS`` minima of the shingles' hashes. A pair of similarity 0.8
   shares none with a chance of (1 - 0.8^4)^32, about 5 in 10^8.
3. BK-trees: a shard's trees link the fingerprints within the radius. A shard of over ``CROWD`` is linked to
   its first row without a search: the exact check has more to compare then, and nothing is lost.
4. Exact check: what is linked is a cluster. Its texts meet inside a task, where pairs within the radius are
   compared on whole sets until they are in one group. A cluster too large for a task is cut into blocks, each
   with the cluster's first row. Rows that are not in its largest group after that are queries: in blocks of
   bounded size each meets each row of the cluster and returns one link for each group that it reaches.

So no pairs are written but links, and clusters of any size have bounded tasks.

Edge cases: a text of fewer than five words is one shingle; null, empty and blank texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import arrow_batch, fresh, map_texts, stored, text_slices, texts_of, with_fields
from lumenlake.llm.components import components
from lumenlake.llm.simhash import group_links, shingle_hashes

BANDS, ROWS = 32, 4
_draw = np.random.default_rng(42)
_TIMES = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_MIX = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: Words of a fingerprint, and the bits in which near copies may differ.
WORDS, RADIUS = 8, 144
_WORD_TIMES = _draw.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
_WORD_PLUS = _draw.integers(0, 1 << 64, WORDS, dtype=np.uint64)
#: Fingerprints of a shard that trees are built over.
CROWD = 4096


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, words)]))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; no shingle at all counts as one."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 512):
        np.minimum(least, (np.multiply.outer(hashes[i : i + 512], _TIMES) + _PLUS).min(axis=0), out=least)
    least ^= least >> np.uint64(29)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(32)) ^ _MIX[:, 0]


def fingerprint(hashes: np.ndarray) -> bytes:
    """The bits that over half of the distinct shingles have, each shingle with ``WORDS`` hashes of 64 bits."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(hashes), 1024):
        h = np.multiply.outer(hashes[i : i + 1024], _WORD_TIMES) + _WORD_PLUS
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def banded(df: DataFrame, keep: list[str], text: str = "text", words: int = 5, bands: str = "bands") -> DataFrame:
    """``keep`` and, as ``bands``, the keys of a text's shards, its fingerprint and its number of shingles."""
    kind = pa.struct([("keys", pa.list_(pa.int64())), ("print", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                sets = [shingle_set(t, words) for t in texts_of(part, text)]
                found = [{"keys": band_keys(x).view(np.int64), "print": fingerprint(x), "size": len(x)} for x in sets]
                yield arrow_batch(part, keep, **{bands: pa.array(found, kind)})

    return map_texts(df.select(*dict.fromkeys([*keep, text])), run, with_fields(df, keep, **{bands: "struct<keys: array<long>, print: binary, size: long>"}))


def split(table: DataFrame, rows: DataFrame, key: str = "_row") -> tuple[DataFrame, DataFrame]:
    """``table`` without and with a chance of its ``key`` being in ``rows`` (stored), told by a filter of at
    most 8 MB whatever the corpus, so that little is shuffled."""
    bits = 1 << min(26, max(16, (32 * rows.count()).bit_length()))
    word, bit = F.expr(f"shiftright(pmod(xxhash64(`{key}`), {bits}), 6)"), f"cast(pmod(xxhash64(`{key}`), 64) as int)"
    w, b, bits_ = (fresh(table, c) for c in ("_word", "_bit", "_bits"))
    words = rows.groupBy(word.alias(w)).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits_))
    marked = table.withColumns({w: word, b: F.expr(bit)}).join(F.broadcast(words), w, "left")
    hit = F.coalesce(F.expr(f"shiftright(`{bits_}`, `{b}`) & 1 = 1"), F.lit(False))
    return marked.filter(~hit).select(*table.columns), marked.filter(hit).select(*table.columns)


def shard_links(table: DataFrame) -> DataFrame:
    """Links (a, b) between rows of ``table`` that share a shard and are within the radius, as many as connect them."""
    keys = table.select("_row", F.explode("bands.keys").alias("band"))
    shared = keys.groupBy("band").agg(F.min("_row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(shared, "near-shards")
    keyed = table.select("_row", F.col("bands.print").alias("print"), F.explode("bands.keys").alias("band"))
    members = split(keyed, shared, "band")[1].join(shared, "band")
    stars = members.filter(f"n > {CROWD} and _row <> first").select(F.col("first").alias("a"), F.col("_row").alias("b"))
    shards = members.filter(f"n <= {CROWD}").groupBy("band").agg(F.collect_list(F.struct("_row", "print")).alias("prints"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for prints in batch.column(0):
                first: dict[int, int] = {}
                for x in sorted(prints.as_py(), key=lambda x: x["_row"]):
                    row, own = x["_row"], int.from_bytes(x["print"], "little")
                    if first.setdefault(own, row) != row:
                        found.add((first[own], row))
                found.update((min(first[u], first[v]), max(first[u], first[v])) for u, v in group_links(list(first), RADIUS))
            ends = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return stored(shards.select("prints").mapInArrow(run, "a long, b long").unionByName(stars).distinct(), "near-candidates")


def with_sets(rows: DataFrame, keep: list[str], text: str, words: int) -> DataFrame:
    """``keep`` and ``hashes``, the set of a text's shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                yield arrow_batch(part, keep, hashes=pa.array([shingle_set(t, words).tobytes() for t in texts_of(part, text)], pa.binary()))

    return map_texts(rows.select(*keep, text), sets, with_fields(rows, keep, hashes="binary"))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return not either or both / either >= similarity


def _read(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers, sets, their sizes and fingerprints."""
    sets = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    prints = np.frombuffer(b"".join(rows.column("print").to_pylist()), "<u8").reshape(-1, WORDS)
    return rows.column("_row").to_numpy(), sets, np.array([len(x) for x in sets], dtype=np.int64), prints


def _near(size: int, own: np.ndarray, sizes: np.ndarray, prints: np.ndarray, similarity: float) -> np.ndarray:
    """Places of those that may be near copies, by fingerprint and size, the nearest first."""
    far = np.bitwise_count(prints ^ own).sum(axis=1)
    may = np.flatnonzero((far <= RADIUS) & (np.minimum(sizes, size) >= similarity * np.maximum(sizes, size)))
    return may[np.argsort(far[may], kind="stable")]


def _link_table(pairs: list[tuple[int, int]]) -> pa.Table:
    ends = np.sort(np.array(pairs, dtype=np.int64).reshape(-1, 2), axis=1)
    return pa.table([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _linked(similarity: float):
    """Rows of a block (_row, print, hashes) to links (a, b) that connect all near copies among them."""

    def run(rows: pa.Table) -> pa.Table:
        ids, sets, sizes, prints = _read(rows)
        group, found = np.arange(len(ids)), []
        for i in range(1, len(ids)):
            for j in _near(sizes[i], prints[i], sizes[:i], prints[:i], similarity):
                if group[j] != group[i] and similar(sets[i], sets[j], similarity):
                    group[group == group[i]] = group[j]
                    found.append((ids[i], ids[j]))
        return _link_table(found)

    return run


def _reached(similarity: float):
    """Rows and queries of a block (_row, root, print, hashes) to links (a, b), one for each other root that a query reaches."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, sets, sizes, prints = _read(rows)
        roots, found = rows.column("root").to_numpy(), []
        for row, own, x, n, p in zip(queries.column("_row").to_numpy(), queries.column("root").to_numpy(), *_read(queries)[1:], strict=True):
            seen = {own}
            for j in _near(n, p, sizes, prints, similarity):
                if roots[j] not in seen and similar(x, sets[j], similarity):
                    seen.add(roots[j])
                    found.append((row, ids[j]))
        return _link_table(found)

    return run


#: Rows and shingles of a cluster's block in one task.
TEXTS, MOST = 512, 1 << 19


def cluster_links(clusters: DataFrame, table: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Links between near copies within the blocks of the stored ``clusters`` (_row, home, blocks); stored."""
    rows = split(table.select("_row", text, F.col("bands.print").alias("print")), clusters)[1].join(clusters, "_row")
    sets = with_sets(rows, ["_row", "home", "blocks", "print"], text, words)
    own, first = F.array(F.expr("pmod(xxhash64(_row), blocks)")), F.expr("sequence(0L, blocks - 1)")
    dealt = sets.withColumn("block", F.explode(F.when(F.col("_row") == F.col("home"), first).otherwise(own)))
    return stored(dealt.select("home", "block", "_row", "print", "hashes").groupBy("home", "block").applyInArrow(_linked(similarity), "a long, b long"), "near-links")


def block_links(rows: DataFrame, table: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Links between the queries of the stored ``rows`` (_row, home, root, query) and the rows of their homes; stored."""
    texts = split(table.select("_row", text, F.col("bands.print").alias("print")), rows)[1].join(rows, "_row")
    sets = stored(with_sets(texts, ["_row", "home", "root", "query", "print"], text, words), "near-sets")
    size = F.octet_length("hashes") / 8
    shape = sets.groupBy("home").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(size) / MOST), F.ceil(F.count("*") / TEXTS)).alias("row_blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("query"), size)) / MOST), F.ceil(F.count_if("query") / TEXTS)).alias("query_blocks"),
    )
    placed = sets.join(stored(shape, "near-shapes"), "home")

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        df = df.withColumn(mine, F.expr(f"pmod(xxhash64(_row), {own})"))
        df = df.withColumn(theirs, F.explode(F.expr(f"sequence(0L, {other} - 1)")))
        columns = ["home", "r", "q", "_row", "root", "print", "hashes"]
        return df.select(*columns).toDF(*columns).groupBy("home", "r", "q")  # both sides come from one table: own attributes for each

    left, right = dealt(placed, "row_blocks", "query_blocks", "r", "q"), dealt(placed.filter("query"), "query_blocks", "row_blocks", "q", "r")
    return stored(left.cogroup(right).applyInArrow(_reached(similarity), "a long, b long").distinct(), "near-reached")


def near_copies(table: DataFrame, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``table`` (stored, with ``_row``, ``text`` and ``bands``) to (node, root): the rows that have a near copy,
    and the smallest row reachable over links."""
    homes = stored(components(shard_links(table)).select(F.col("node").alias("_row"), F.col("root").alias("home")), "near-homes")
    sizes = split(table.select("_row", F.col("bands.size").alias("size")), homes)[1].join(homes, "_row")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("size") / MOST)).alias("blocks")
    blocks = stored(sizes.groupBy("home").agg(blocks), "near-blocks")
    clusters = stored(homes.join(blocks, "home").select("_row", "home", "blocks"), "near-clusters")
    links = cluster_links(clusters, table, text, words, similarity)
    roots = stored(components(links), "near-roots")
    cut = clusters.filter("blocks > 1").join(roots.withColumnRenamed("node", "_row"), "_row", "left").select("_row", "home", F.coalesce("root", "_row").alias("root"))
    cut = stored(cut, "near-cut")
    groups = cut.groupBy("home", "root").count().groupBy("home").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("n"))
    apart = stored(cut.join(groups.filter("n > 1"), "home").select("_row", "home", "root", (F.col("root") != F.col("main")).alias("query")), "near-apart")
    if apart.isEmpty():
        return roots
    return components(links.unionByName(block_links(apart, table, text, words, similarity)))
