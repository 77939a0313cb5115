"""Best-two-fit packing of token sequences.

A document's piece has one of at most ``size - 1`` lengths, so the counts of the lengths say all
that packing needs: the driver packs the counts (at most ``size`` rows, whatever the corpus) and
gets patterns with the number of bins that repeat each. Pieces find their places by their rank
among the pieces of their length.

Each pattern is filled greedily with the longest pieces that fit; then the bin's smallest piece
gives way to two unpacked ones if these fill the expanded gap more tightly. A pattern is repeated
while the counts last, and so exhausts at least one length.

Edge cases: a null or empty text is the end id alone; repeated rows are packed once each; a null
key stays null; an empty table gives no piece.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.chunks import packed
from lumenlake.llm.common import arrow_batch, map_texts, stored, text_slices, texts_of, with_fields

_loaded: dict[str, Bpe] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """Byte-level BPE ids of whole texts, as the tokenizers library gives them.

    Where the vocabulary's ids are the ranks of its merges and its pre-tokens are the plain
    byte-level ones, a text goes to the tiktoken library with the same ranks and pattern, which is
    four times as fast; any other vocabulary stays with the tokenizers library. Added tokens
    are met in texts by both.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        kind = json.loads(self.lib.to_str())
        vocab, merges, added = kind["model"]["vocab"], kind["model"]["merges"], {t["content"]: t["id"] for t in kind["added_tokens"]}
        ranks = [vocab.get("".join(m if isinstance(m, list) else m.split(" ", 1)), -1) for m in merges]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.ranked = None
        if (
            not kind["normalizer"] and plain.items() <= (kind["pre_tokenizer"] or {}).items() and all(a < b for a, b in zip([255, *ranks], ranks, strict=False))
            and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in kind["added_tokens"])
        ):
            letters = byte_letters()
            own = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens=added)
        self.added = list(added)

    def code(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids as little-endian 32-bit bytes, closed by ``end``."""
        if self.ranked is None:
            return [packed(x.ids) + end for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        plain, special = self.ranked.encode_ordinary, self.ranked.encode
        return [packed(special(t, allowed_special="all") if any(a in t for a in self.added) else plain(t)) + end for t in texts]


def bpe(vocabulary: str | None = None) -> Bpe:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Bpe(vocabulary)
    return _loaded[vocabulary]


def tokenize(df: DataFrame, keep: list[str], text: str = "text", end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """``keep``, ``row`` (a number of the row within this evaluation) and ``ids`` (little-endian
    unsigned 32-bit, closed by ``end_id``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, end, row = bpe(vocabulary), packed([end_id]), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_slices(batch, text, 1 << 20):
                ids = b.code(texts_of(part, text), end)
                rows = pa.array(np.arange(row, row + len(ids), dtype=np.int64))
                row += len(ids)
                yield arrow_batch(part, keep, row=rows, ids=pa.array(ids, pa.binary()))

    return map_texts(df.select(*dict.fromkeys([*keep, text])), run, with_fields(df, keep, row="long", ids="binary"))


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, longest first, and the number of bins that follow each."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while (lengths := np.flatnonzero(left)).size:
        free = left.copy()
        filled, gap = [], size
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            filled.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= filled[-1]
        if gap and len(filled) > 1:
            smallest = filled[-1]
            free[smallest] += 1
            if two := _tightest_two(free, gap + smallest, smallest):
                filled[-1:] = two
        pattern = tuple(sorted(filled, reverse=True))
        used = Counter(pattern)
        times = min(int(left[n]) // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= m * times
        out.append((pattern, times))
    return out


def _tightest_two(free: np.ndarray, room: int, more_than: int) -> list[int] | None:
    """Two lengths with the largest sum up to ``room`` that exceeds ``more_than``."""
    there = free > 0
    for total in range(room, more_than, -1):
        half = there[1 : total // 2 + 1] & there[total - 1 : total - total // 2 - 1 : -1]
        if total % 2 == 0 and total >= 2 and free[total // 2] < 2:
            half[-1] = False
        if (found := np.flatnonzero(half)).size:
            a = int(found[0]) + 1
            return [total - a, a]
    return None


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, rank after the last, bin of the first rank, offset) and the number of bins."""
    rank: Counter[int] = Counter()
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], rank[length] + times, base, offset))
            rank[length] += times
            offset += length
        base += times
    return rows, base


def pack(tokens: DataFrame, keep: list[str], size: int = 1024) -> DataFrame:
    """Places pieces of at most ``size`` tokens in sequences.

    ``tokens`` has ``keep``, a number ``row`` for each row, ``n`` tokens and an array ``extra`` with
    a value for each piece; it must be a stored table. Returns per piece: ``keep``, ``piece``,
    ``start``, ``length``, ``extra``, ``sequence_id`` and ``offset``. The first piece is the shorter.
    """
    spark = tokens.sparkSession
    buckets = max(16, min(4096, tokens.count() >> 17))
    rows = tokens.withColumns(
        {
            "rem": F.expr(f"cast(n % {size} as int)"),
            "full": F.expr(f"n div {size}"),
            "bucket": F.expr(f"pmod(xxhash64(row), {buckets})"),
        }
    )
    counts = rows.groupBy("rem", "bucket").agg(F.count("*").alias("m"), F.sum("full").alias("full_m"))
    counts = stored(counts, "packing-counts")
    histogram = {r["rem"]: r["m"] for r in counts.groupBy("rem").agg(F.sum("m").alias("m")).collect() if r["rem"]}
    spots, bins = places(best_two_fit(histogram, size))
    before = Window.partitionBy("rem").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("rem", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("rank_base"))
    # a few thousand rows at most: one for each bucket
    totals = counts.groupBy("bucket").agg(F.sum("full_m").alias("m")).orderBy("bucket").collect()
    base, full_bases = bins, []
    for r in totals:
        full_bases.append((r["bucket"], base))
        base += r["m"]
    fulls = spark.createDataFrame(full_bases, "bucket long, full_base long")
    spot = spark.createDataFrame(spots, "rem int, lo long, hi long, bin long, offset long")
    ranked = (
        rows.withColumn("in_bucket", F.row_number().over(Window.partitionBy("rem", "bucket").orderBy("row")) - 1)
        .join(ranks, ["rem", "bucket"])
        .withColumn("rank", F.col("rank_base") + F.col("in_bucket"))
        .withColumn("full_before", F.coalesce(F.sum("full").over(Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(fulls), "bucket")
    )
    # the table of places is bounded by the sequence size, not by the corpus
    s = F.broadcast(spot).alias("s")
    r = ranked.alias("r")
    found = r.join(s, (F.col("r.rem") == F.col("s.rem")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    pieces = found.select(
        *[F.col(f"r.`{c}`") for c in keep],
        F.col("r.rem").alias("rem"),
        (F.col("bin") + F.col("rank") - F.col("lo")).alias("packed_id"),
        F.col("offset").alias("packed_offset"),
        (F.col("full_base") + F.col("full_before")).alias("full_id"),
        F.posexplode("extra").alias("piece", "extra"),
    )
    short = (F.col("piece") == 0) & (F.col("rem") > 0)
    whole = F.col("piece") - (F.col("rem") > 0).cast("int")
    return pieces.select(
        *keep,
        "piece",
        F.when(short, F.lit(0)).otherwise(F.col("rem") + whole * size).cast("long").alias("start"),
        F.when(short, F.col("rem")).otherwise(F.lit(size)).cast("long").alias("length"),
        "extra",
        F.when(short, F.col("packed_id")).otherwise(F.col("full_id") + whole).alias("sequence_id"),
        F.when(short, F.col("packed_offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, keep: list[str], size: int = 1024) -> DataFrame:
    """Tokenises and packs; ``ids_crc32`` stands for each piece's ids."""
    tokens = tokenize(docs, keep).select(
        *keep,
        "row",
        F.expr("cast(length(ids) / 4 as bigint)").alias("n"),
        F.expr(
            f"""transform(sequence(0, cast(ceil(length(ids) / {4 * size}) as int) - 1), i ->
            case when length(ids) % {4 * size} = 0 then crc32(substring(ids, i * {4 * size} + 1, {4 * size}))
                 when i = 0 then crc32(substring(ids, 1, length(ids) % {4 * size}))
                 else crc32(substring(ids, length(ids) % {4 * size} + (i - 1) * {4 * size} + 1, {4 * size})) end)"""
        ).alias("extra"),
    )
    return pack(stored(tokens, "packing-tokens"), keep, size).withColumnRenamed("extra", "ids_crc32")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
