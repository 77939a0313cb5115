"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each part of the table sorts the 64-bit fingerprints of its normalised texts and sends every
   owner its range of them as Golomb-Rice coded gaps (``encode_gaps``), about
   ``2 + log2(2**64 / n)`` bits for each of ``n`` fingerprints less the owner's share.
2. An owner decodes the streams of all parts, and answers each with a bitmap of the fingerprints
   that occur more than once (``_owner``). A part says itself which it holds twice.
3. Parts turn bitmaps into suspects. These set bits of a filter with 16 bits for each of them, which
   reaches the second scan as a broadcast of at most ``most_bits / 8`` bytes, whatever the corpus.
   Beyond that size it lets more unique texts through, up to all.
4. Only texts that pass the filter are shuffled. They are grouped by digest and by their bytes,
   with counts combined before the shuffle, so a group of copies of any size is one row a task.

False suspects cost a shuffle, not an error: the groups compare whole texts.

Edge cases: null counts as empty; of rows that repeat both key and text one stays; null keys are
smaller than any other; an empty table gives an empty result; columns of any name are carried in a
struct, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import arrow_batch, map_texts, stored, text_slices, with_fields


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def encode_gaps(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned numbers as Golomb-Rice coded gaps.

    Layout: the count (8 bytes), the first value (8 bytes), the remainder width (1 byte), the
    remainders' bits, then the quotients in unary.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values)
    mean = int(gaps.mean()) if n > 1 else 0
    width = max(0, mean.bit_length() - 1)
    head = np.array([n, values[0]], dtype="<u8").tobytes() + bytes([width])
    low = (gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n > 1 else 0, dtype=np.uint8)
    unary[ends] = 0
    return head + np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(unary).tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    n, first = (int(x) for x in np.frombuffer(data, "<u8", 2))
    width, m = data[16], n - 1
    cut = 17 + (m * width + 7) // 8
    low = np.unpackbits(np.frombuffer(data, np.uint8, cut - 17, 17), count=m * width).reshape(m, width)
    rest = (low.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -1, cut)) == 0)[:m]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(width)) + rest
    return np.concatenate([[np.uint64(first)], gaps]).cumsum(dtype=np.uint64)


def _send(owner_bits: int):
    """A part's fingerprints to (owner, part, data, twice): ``twice`` are the bits of those that
    the part itself holds more than once."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values, counts = np.unique(np.sort(table.column("h").to_numpy().view(np.uint64)), return_counts=True)
        owners = (values >> np.uint64(64 - owner_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners)) + 1
        rows = [
            (int(o[0]), key[0].as_py(), encode_gaps(v), np.packbits(c > 1).tobytes())
            for o, v, c in zip(np.split(owners, cuts), np.split(values, cuts), np.split(counts, cuts), strict=True)
        ]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["owner", "part", "data", "twice"])

    return run


def _owner(table: pa.Table) -> pa.Table:
    """All streams of one owner to (part, data, bitmap, n), n the number of bits set."""
    streams = [decode_gaps(x) for x in table.column("data").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(table.column("twice").to_pylist(), streams, strict=True)]
    values, counts = np.unique(np.concatenate(streams), return_counts=True)
    repeated = values[counts > 1]
    bitmaps, set_ = [], []
    for v, t in zip(streams, twice, strict=True):
        at = np.searchsorted(repeated, v)
        hit = np.zeros(len(v), dtype=bool)
        if len(repeated):
            hit = repeated[np.minimum(at, len(repeated) - 1)] == v
        bitmaps.append(np.packbits(hit | t).tobytes())
        set_.append(int((hit | t).sum()))
    return pa.table([table.column("part"), table.column("data"), pa.chunked_array([pa.array(bitmaps, pa.binary())]), pa.chunked_array([pa.array(set_, pa.int64())])], names=["part", "data", "bitmap", "n"])


def _words(bits_: int):
    """Bitmaps that came back to the parts, to the words of the filter of suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for data, bitmap in zip(batch.column("data").to_pylist(), batch.column("bitmap").to_pylist(), strict=True):
                v = decode_gaps(data)
                found.append(v[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(v)).astype(bool)])
            bits = np.unique(np.concatenate(found) % np.uint64(bits_))
            words, starts = np.unique(bits >> np.uint64(6), return_index=True)
            if len(words):
                values = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"])

    return run


def suspect_filter(docs: DataFrame, text: str = "text", owner_bits: int | None = None, most_bits: int = 1 << 27) -> np.ndarray:
    """The filter that every fingerprint held more than once passes.

    It comes to the driver: ``most_bits / 64`` words of 16 bytes at most.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for some in text_slices(batch, text):
                h = b"".join([hashlib.sha256(normalised(x)).digest()[:8] for x in some.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, part, dtype=np.int64)), pa.array(np.frombuffer(h, ">i8").astype(np.int64))], names=["part", "h"])

    prints = stored(map_texts(docs.select(text), hashes, "part long, h long"), "exact-prints")
    if owner_bits is None:
        owner_bits = max(3, min(16, (prints.count() >> 16).bit_length()))
    sent = prints.groupBy("part").applyInArrow(_send(owner_bits), "owner long, part long, data binary, twice binary")
    answered = stored(sent.groupBy("owner").applyInArrow(_owner, "part long, data binary, bitmap binary, n long"), "exact-answers")
    suspects = answered.agg(F.sum("n")).first()[0] or 0
    bits = min(most_bits, max(1 << 16, 1 << (16 * suspects).bit_length()))
    words = answered.mapInArrow(_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, **settings) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of ``carry``, the key by default, without the text),
    ``text`` if ``carry`` names it, ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``. Of equal texts the row
    with the largest key stays."""
    carry = carry or [key]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry if c != text] or [F.lit(None).alias("none")]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    names = ["row", "key", *(["text"] if text in carry else [])]
    bits = docs.sparkSession.sparkContext.broadcast(suspect_filter(rows.select("text"), **settings))

    def scan(suspects: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, words = TaskContext.get().partitionId() << 33, bits.value
            size = np.uint64(len(words) * 64)
            for batch in batches:
                for part in text_slices(batch, "text"):
                    texts = [normalised(x) for x in part.column("text").to_pylist()]
                    digests = [hashlib.sha256(x).digest() for x in texts]
                    at = np.frombuffer(b"".join([d[:8] for d in digests]), ">u8").astype(np.uint64) % size
                    hit = (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == (1 if suspects else 0)
                    which = np.flatnonzero(hit)
                    added = {"sha": pa.array([digests[i].hex() for i in which], pa.string())}
                    if suspects:
                        added |= {"n": pa.array(row + which), "norm": pa.array([texts[i] for i in which], pa.binary())}
                    row += part.num_rows
                    yield arrow_batch(part.take(pa.array(which)) if len(which) < part.num_rows else part, names, **added)

        return run

    alone = map_texts(rows, scan(False), with_fields(rows, names, sha="string"))
    suspects = stored(map_texts(rows, scan(True), with_fields(rows, names, sha="string", n="long", norm="binary")), "exact-suspects")
    groups = suspects.groupBy("sha", "norm").agg(F.count("*").alias("size"), F.max(F.struct(F.col("key").alias("k"), F.col("n").alias("r"))).alias("best"))
    together = suspects.join(stored(groups, "exact-groups"), ["sha", "norm"])
    own = [n for n in names if n != "key"]
    out = lambda df, keep, n, kept: df.select(*own, F.col("sha").alias("text_sha256"), keep.alias("keep_id"), n.alias("group_size"), kept.alias("kept"))
    return out(alone, F.col("key"), F.lit(1).cast("long"), F.lit(True)).unionByName(
        out(together, F.col("best.k"), F.col("size"), F.col("n") == F.col("best.r"))
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
"""
