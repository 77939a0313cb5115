"""SentencePiece encoding and decoding through a table of distinct chunks.

In the vocabulary no piece holds a word character before a whitespace marker, so a merge never
crosses from one marked word to the next. Each distinct marked word is therefore segmented once
for a table, and the ids of a text are those of its words joined by position.

The table belongs to a Python worker and is bounded (``ChunkTable``). One table for the whole
corpus would need every occurrence of every word to be shuffled to it, some forty bytes a word.

Edge cases: a null or empty text has only the begin and end ids; a null key stays null; repeated
rows are each encoded; columns that are not kept have no influence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.chunks import ChunkTable, packed
from lumenlake.llm.common import arrow_batch, map_texts, text_slices, texts_of, with_fields

MARKER = "▁"
_spaced = re.compile(r" ( *[^ ]+| *\Z)")
_loaded: dict[str, Coder] = {}


class Coder:
    """Encodes and decodes texts exactly as the library does, a distinct chunk at a time."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        if any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a whitespace marker")
        self.begin, self.end = packed([self.lib.bos_id()]), packed([self.lib.eos_id()])
        self.guard = self.lib.encode("a")
        self.odd: dict[str, str] = {}  # chunks that are not decoded to themselves
        self.table = ChunkTable(self._encode, marks=self.odd)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [x for i in range(0, len(chunks), 20_000) for x in self._encode_some(chunks[i : i + 20_000])]

    def _encode_some(self, chunks: list[str]) -> list[bytes]:
        ids = self.lib.encode(chunks, num_threads=1)
        for i, c in enumerate(chunks):
            if not c:  # a marker alone; the library encodes an empty string as nothing
                ids[i] = [self.lib.piece_to_id(MARKER)]
        texts = self.lib.decode([self.guard + x for x in ids], num_threads=1)
        for c, text in zip(chunks, texts, strict=True):
            if text[1:] != " " + c:
                self.odd[c] = text[1:]
        return [packed(x) for x in ids]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's marked words without their first marker."""
        if not text:
            return []
        text = text.replace(MARKER, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return _spaced.findall(" " + text)
        return text.split(" ")

    def code(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids with begin and end, and the text that they decode to."""
        documents = [self.chunks(t) for t in texts]
        ids = self.table.ids(documents)
        decoded, odd = [], self.odd
        for chunks in documents:
            if odd and not odd.keys().isdisjoint(chunks):
                decoded.append("".join([odd[c] if c in odd else " " + c for c in chunks])[1:])
            else:
                decoded.append(" ".join(chunks))
        return [self.begin + x + self.end for x in ids], decoded


def coder(model: str | None = None) -> Coder:
    """The worker's coder for a model file; by default the public vocabulary of 32,000 pieces."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    if model not in _loaded:
        _loaded[model] = Coder(model)
    return _loaded[model]


def encode_decode(df: DataFrame, keep: list[str], text: str = "text", model: str | None = None) -> DataFrame:
    """``keep``, then ``ids`` (little-endian unsigned 32-bit, begin and end included) and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for part in text_slices(batch, text):
                ids, decoded = c.code(texts_of(part, text))
                yield arrow_batch(part, keep, ids=pa.array(ids, pa.binary()), decoded=pa.array(decoded, pa.string()))

    return map_texts(df.select(*dict.fromkeys([*keep, text])), run, with_fields(df, keep, ids="binary", decoded="string"))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return coded.select(
        "doc_id",
        F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
