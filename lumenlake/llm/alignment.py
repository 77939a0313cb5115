"""Alignment of two tokenisers, a distinct segment at a time.

A text is cut before those runs of white space over which neither vocabulary can merge. Each
distinct segment is tokenised by both vocabularies and aligned once for the whole corpus; the
alignments are joined back and documents are composed of them by position.

Texts travel in blocks of about ``BLOCK`` bytes: a block has a dictionary of its segments, and its
documents are lists of places in it. So what is joined by segment has a row for each segment of a
block and not for each word, and no segment is in more rows than there are blocks.

Edge cases: a text that is null, empty, or not spelled by both vocabularies byte for byte has no
tokens and counts nowhere; a null key stays null; repeated rows are each composed and counted; an
empty table gives no row. Columns of ``carry`` travel in a struct, so their names clash with none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import give_back, map_texts, stored, text_slices, texts_of, with_fields
from lumenlake.llm.packing import byte_letters

MARKER = "▁"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 16 << 20
_loaded: dict[tuple, Pair] = {}


class Pair:
    """A byte-level vocabulary A and a piece vocabulary B, with the bytes of their tokens."""

    #: White space that may begin a segment, where neither vocabulary joins it to what stands before.
    BLANKS = " \t\n\r\x0b\x0c"

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        kind = json.loads(self.a.to_str())
        if kind["normalizer"] or kind["pre_tokenizer"].get("type") != "ByteLevel" or kind["pre_tokenizer"]["add_prefix_space"] or not kind["pre_tokenizer"]["use_regex"]:
            raise ValueError("vocabulary A must be byte-level with plain pre-tokens")
        letters = byte_letters()
        entries = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_size = np.array([len(entries.get(i, b"")) for i in range(max(entries) + 1)])
        pieces = [self.b.id_to_piece(i).replace(MARKER, " ") for i in range(self.b.get_piece_size())]
        self.b_size = np.array([1 if self.b.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)])
        joined = {m for x in [*pieces, *(e.decode(errors="replace") for e in entries.values())] for m in re.findall(rf"\S([{self.BLANKS}])", x)}
        self.starts = "".join(c for c in self.BLANKS if c not in joined)
        if " " not in self.starts:
            raise ValueError("these vocabularies merge across spaces")
        self.cuts = re.compile(rf"(?<=\S)(?=[{self.starts}])")
        # the same where there is no other white space, and faster
        self.others, self.words = re.compile(rf"[^\S{self.starts}]"), re.compile(r"\s*\S+|\s+")
        self.guard = "a"
        self.guard_ids = len(self.b.encode(self.guard))

    def spelled(self, text: str) -> bool:
        """Whether B's pieces spell the text after a space; A's always do."""
        return MARKER not in text and self.b.normalize(text) == MARKER + text.replace(" ", MARKER)

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text; each but the first begins with the white space before a word."""
        text = " " + text
        return self.cuts.split(text) if self.others.search(text) else self.words.findall(text)

    def tokens(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments in A and in B, one after the other. Segments that do not end in white space
        stay apart when they are joined; a guard takes B's space of the beginning."""
        a, b, joined = [], [], []

        def flush() -> None:
            if joined:
                text = "".join(joined)
                a.append(self.a.encode(text, add_special_tokens=False).ids)
                b.append(self.b.encode(self.guard + text)[self.guard_ids :])
                joined.clear()

        for k, s in enumerate(segments):
            joined.append(s)
            if not k % 500 or len(s) > 500 or s[-1].isspace():  # the next must not run into white space at the end
                flush()
        flush()
        return np.array(list(chain.from_iterable(a)), np.int64), np.array(list(chain.from_iterable(b)), np.int64)

    def aligned(self, segments: list[str]) -> dict[str, np.ndarray | pa.Array]:
        """Of each segment: ``groups`` as text, ``n_a``, the ``links`` (A's id in the high half, B's in the low) and ``ends``,
        where the segment's links end.

        Between two neighbouring ends of tokens lies one A and one B token, and each two tokens that
        overlap do so between one such pair of ends.
        """
        a, b = self.tokens(segments)
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.cumsum([len(s.encode()) for s in segments])
        ends, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b)
        links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        # tokens in order of their group, A's before B's; what follows each: , within a side, | after A's, ; after a group, nothing after a segment
        ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        group = np.concatenate([np.searchsorted(both, end_a), np.searchsorted(both, end_b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, part = ids[order], (group * 2 + side)[order]
        last = np.append(part[1:] != part[:-1], True) if len(part) else np.zeros(0, bool)
        after = np.where(last, np.where(part % 2 == 0, 2, np.where(np.isin(both, cuts)[part // 2], 0, 3)), 1)
        data = "".join(chain.from_iterable(zip(map(str, ids.tolist()), map(["", ",", "|", ";"].__getitem__, after.tolist()), strict=True)))
        sizes = np.cumsum(np.floor(np.log10(np.maximum(ids, 1))).astype(np.int64) + 1 + (after > 0))
        segment_ends = np.concatenate([[0], sizes[after == 0]]).astype(np.int32)
        groups = pa.StringArray.from_buffers(len(segments), pa.py_buffer(segment_ends.tobytes()), pa.py_buffer(data.encode()))
        n_a = np.diff(np.searchsorted(end_a, cuts, side="right"), prepend=0)
        return {"groups": groups, "n_a": n_a, "links": links, "ends": np.searchsorted(ends, cuts, side="right")}


def pair(vocabulary: str | None = None, model: str | None = None) -> Pair:
    """The worker's pair; by default the public byte-level and piece vocabularies."""
    import public_tokenizers

    key = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), model or public_tokenizers.path("piece_bpe_32k.model")
    if key not in _loaded:
        _loaded[key] = Pair(*key)
    return _loaded[key]


class Numbered(dict):
    """Numbers its keys in the order in which they are first met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def blocks(rows: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``row``, ``block`` and ``places`` (their size in bytes, then 32-bit numbers, compressed; null without tokens) for each row, and for each
    block one more with ``segments``, its dictionary with how often each stands in its texts."""
    lists = pa.list_(pa.struct([("seg", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, block, size = pair(vocabulary, model), TaskContext.get().partitionId() << 33, 0
        numbers, counts = Numbered(), np.zeros(0, dtype=np.int64)
        kind = None

        def batch_of(row, places, segments) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([row, pa.array(np.full(len(row), block)), places, segments], names=["row", "block", "places", "segments"])

        def dictionary() -> pa.RecordBatch:
            entries = [{"seg": s, "n": n} for s, n in zip(numbers, counts.tolist(), strict=True)]
            return batch_of(pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([entries], lists))

        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                kind, places = part.column("row").type, []
                for t in texts_of(part):
                    places.append(np.array(list(map(numbers.__getitem__, p.segments(t))), np.int32) if t and p.spelled(t) else None)
                    size += len(t)
                now = np.bincount(np.concatenate([np.zeros(0, np.int32), *[x for x in places if x is not None]]), minlength=len(numbers))
                now[: len(counts)] += counts
                counts = now
                yield batch_of(part.column("row"), pa.array([None if x is None else x.nbytes.to_bytes(4, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True) for x in places], pa.binary()), pa.nulls(part.num_rows, lists))
                if size >= BLOCK:
                    yield dictionary()
                    block, size, numbers, counts = block + 1, 0, Numbered(), np.zeros(0, dtype=np.int64)
        if numbers:
            yield dictionary()

    kinds = with_fields(rows, [], block="bigint", places="binary", segments="array<struct<seg:string,n:bigint>>")
    return map_texts(rows, run, T.StructType([T.StructField("row", rows.schema["row"].dataType, True), *kinds]))


#: Segments that are aligned at a time.
CHUNK = 20_000
ALIGNED = "id long, groups string, n_a long, links array<bigint>, at array<struct<block:bigint,i:int>>, pairs array<struct<link:bigint,n:bigint>>"


def align_segments(met: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Aligns each segment of ``met`` (seg, n, block, i), sorted by segment within its partitions, once.

    A row has its ``groups``, ``n_a`` and ``links``, and ``at``, the places of blocks' dictionaries that it
    stands in. A chunk's first row also has ``pairs``, the chunk's links with their counts in the
    corpus. A segment that crosses chunks has a row in each.
    """
    places = pa.struct([("block", pa.int64()), ("i", pa.int32())])
    counted = pa.struct([("link", pa.int64()), ("n", pa.int64())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some, rows, size = [], 0, 0
        for batch in batches:
            for part in text_slices(batch, "seg"):
                some.append(part)
                rows, size = rows + part.num_rows, size + part.column("seg").nbytes
                if rows >= CHUNK or size >= 4 << 20:
                    yield pa.Table.from_batches(some).combine_chunks()
                    some, rows, size = [], 0, 0
        if some:
            yield pa.Table.from_batches(some).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = pair(vocabulary, model), TaskContext.get().partitionId() << 33
        for chunk in chunks(batches):
            runs = pc.run_end_encode(chunk.column("seg").combine_chunks())
            ends = runs.run_ends.to_numpy()
            done = p.aligned(runs.values.to_pylist())
            times = np.add.reduceat(chunk.column("n").to_numpy(), np.concatenate([[0], ends[:-1]]))
            own = np.repeat(times, np.diff(done["ends"], prepend=0))
            link, which = np.unique(done["links"], return_inverse=True)
            totals = np.zeros(len(link), np.int64)
            np.add.at(totals, which, own)
            n = len(ends)
            offsets = lambda x: pa.array(np.concatenate([[0], x]).astype(np.int32))
            where = pa.StructArray.from_arrays([chunk.column("block").combine_chunks(), chunk.column("i").combine_chunks()], fields=list(places))
            first = pa.StructArray.from_arrays([pa.array(link), pa.array(totals)], fields=list(counted))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(at, at + n)), done["groups"], pa.array(done["n_a"]), pa.ListArray.from_arrays(offsets(done["ends"]), pa.array(done["links"])),
                    pa.ListArray.from_arrays(offsets(ends), where), pa.ListArray.from_arrays(offsets([len(link)] * n), first),
                ], names=["id", "groups", "n_a", "links", "at", "pairs"],
            )
            at += n
        give_back()

    return met.select("seg", "n", "block", "i").mapInArrow(run, ALIGNED)


#: The most pairs of ids whose counts are sent to all tasks (24 bytes each); more are joined by a shuffle.
MOST_PAIRS = 4_000_000
ENTRY = ["groups", "n_a", "n_best", "count_sum"]


def scored(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(of, i, groups, n_a, n_best, count_sum) for each place of a stored ``align_segments``."""
    counts = stored(aligned.select(F.explode("pairs").alias("p")).groupBy("p.link").agg(F.sum("p.n").alias("n")), "alignment-counts")
    best = counts.groupBy(F.expr("int(link & 4294967295)").alias("b")).agg(F.max("n").alias("best"))
    judged = counts.withColumn("b", F.expr("int(link & 4294967295)")).join(best, "b").select("link", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    if counts.count() > most_pairs:
        scores = aligned.select("id", F.explode("links").alias("link")).join(judged, "link").groupBy("id").agg(F.sum("is_best").alias("n_best"), F.sum("n").alias("count_sum"))
        found = aligned.select("id", "groups", "n_a", "at").join(scores, "id").select(F.explode("at").alias("p"), *ENTRY)
        return found.select(F.col("p.block").alias("of"), "p.i", *ENTRY)
    table = judged.toArrow().sort_by("link")
    known = aligned.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("link", "n", "is_best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, is_best = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, at = batch.column("links"), batch.column("at")
            which = np.searchsorted(link, lists.flatten().to_numpy())
            starts = np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy())
            sums = [pa.array(np.add.reduceat(x[which], starts)[row]) for x in (is_best, n)]
            block, i = at.flatten().flatten()
            yield pa.RecordBatch.from_arrays([block, i, batch.column("groups").take(pa.array(row)), batch.column("n_a").take(pa.array(row)), *sums], names=["of", "i", *ENTRY])

    return map_texts(aligned.select("groups", "n_a", "links", "at"), run, "of long, i int, groups string, n_a long, n_best long, count_sum long")


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _compose(documents: pa.Table, entries: pa.Table) -> pa.Table:
    """A block's documents of their places and the alignments in its dictionary."""
    give_back()  # what the block before took
    order = entries.column("i").to_numpy()
    groups = np.empty(len(order), object)
    groups[order] = entries.column("groups").to_numpy()
    groups = groups.tolist()
    values = np.empty((3, len(order)), np.int64)
    for k, c in enumerate(("n_a", "n_best", "count_sum")):
        values[k, order] = entries.column(c).to_numpy()
    done, texts, sums, size = [], [], [], 0
    rows = documents.column("row").combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows

    def flush() -> None:
        columns = np.array(sums, dtype=np.int64).reshape(len(texts), len(SUMS))
        row = rows.slice(sum(len(x) for x in done), len(texts))
        done.append(pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string()), *[pa.array(columns[:, k]) for k in range(len(SUMS))]], names=["row", "groups", *SUMS]))
        texts.clear()
        sums.clear()

    for x in documents.column("places").to_pylist():
        places = np.frombuffer(pa.decompress(x[4:], int.from_bytes(x[:4], "little"), "zstd", asbytes=True) if x else b"", np.int32)
        text = ";".join([groups[i] for i in places.tolist()])
        n_a, n_best, count_sum = values[:, places].sum(axis=1).tolist()
        n_groups = text.count(";") + (text != "")
        n_b = text.count(",") + 2 * n_groups - n_a
        texts.append(text)
        sums.append((n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum))
        size += len(text)
        if size >= 8 << 20:
            flush()
            size = 0
    flush()
    return pa.Table.from_batches(done)


def align(docs: DataFrame, carry: list[str], text: str = "text", vocabulary: str | None = None, model: str | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """For each row of ``docs``: ``row`` (a struct of ``carry``), ``groups`` (``a1,a2|b1;a3|b2``), ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``n_best`` and ``count_sum``.

    A link joins an A token and a B token whose bytes overlap. The count of a pair of ids is the
    number of links that join it in the corpus; ``n_best`` counts the links whose pair has the
    highest count of its B id, and ``count_sum`` adds the counts of all links.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").alias("text"))
    table = stored(blocks(rows, vocabulary, model), "alignment-blocks")
    met = table.filter("segments is not null").select("block", F.posexplode("segments").alias("i", "s")).select("block", "i", "s.seg", "s.n")
    aligned = stored(align_segments(met.repartition("seg").sortWithinPartitions("seg"), vocabulary, model), "alignment-segments")
    entries = scored(aligned, most_pairs)
    documents = table.filter("segments is null").select("row", "block", "places")
    out = documents.select("row").schema.add("groups", "string")
    for c in SUMS:
        out = out.add(c, "long")
    return documents.groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(_compose, out)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("row.doc_id", *SUMS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
