"""Tokenisers against their libraries, and packing."""

import random

import brute
import public_tokenizers
import pytest

from lumenlake.llm import packing, pieces
from lumenlake.llm.chunks import packed

HARD = [
    "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a \n b", "a\n b", "a \nb", "\n", "\n\n", " \n", "\n ", "x\n", "x y\n", "x y\n ", "x y \n",
    "don't I'll we've", "don't 've x'", "a\tb \t c", "▁x ▁ y▁", "  lead", "trail   ", "é ñ 漢字 漢 字", "🙂 🙂🙂", "a\x00b \x00", "12 345 a1 1a",
    "<|endoftext|> x", "<s> </s> <unk>", "a b  c", "é x́", "x" * 5000, "ab " * 3000, "% %% word%%% word###", "a.b,c;d (e) f)", "ⅷ ² ½ x²", "\x1c x \x1c",
]


def texts():
    r = random.Random(3)
    alphabet = ["a", "b", " ", " ", "\n", "'s", ".", "é", "1", "漢", "\t", "▁", "the", "ing", "\x02"]
    return HARD + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(1500)]


def test_pieces_equal_the_library():
    own = texts()
    c = pieces.coder()
    for _ in range(2):  # the second time from the table
        ids, decoded = c.code(own)
        assert ids == [packed(c.lib.encode(t, add_bos=True, add_eos=True)) for t in own]
        assert decoded == [c.lib.decode(c.lib.encode(t, add_bos=True, add_eos=True)) for t in own]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_equals_the_library():
    own = texts() + ["a<|endoftext|>b <|endoftext|> c", "<|endoftext|>", " <|endoftext|", "<|endoftext|><|endoftext|>\n"]
    b, lib = packing.bpe(), library("byte_bpe_50k.json")
    assert b.ranked is not None
    assert b.code(own, b"") == [packed(lib.encode(t, add_special_tokens=False).ids) for t in own]
    assert packed([50256]) in b.code(["a <|endoftext|> b"], b"")[0]


def test_bpe_of_every_letter():
    """Both libraries put each code point into the same kind of pre-token."""
    b, lib = packing.bpe(), library("byte_bpe_50k.json")
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    own = ["".join(f"a{c}b {c} 1{c}2 .{c}. {c}  {c}{c} " for c in every[i : i + 50]) for i in range(0, len(every), 50)]
    assert b.code(own, b"") == [packed(x.ids) for x in lib.encode_batch_fast(own, add_special_tokens=False)]


def test_other_vocabularies_stay_with_their_library():
    b, lib = packing.bpe(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    assert b.ranked is None
    assert b.code(HARD, b"") == [packed(lib.encode(t, add_special_tokens=False).ids) for t in HARD]


def indented():
    return [f"def f{i}:\n  if x{i}:\n    a{i % 7} \t▁b{i} = the\n the\x02{i} end" for i in range(60)] + HARD


class Lossy:
    """The library, but x is decoded to ?: the public vocabulary decodes every chunk to itself."""

    def __init__(self, lib):
        self.encode, self.piece_to_id, self.inner = lib.encode, lib.piece_to_id, lib

    def decode(self, ids, **options):
        out = self.inner.decode(ids, **options)
        return out.replace("x", "?") if isinstance(out, str) else [t.replace("x", "?") for t in out]


def test_pieces_past_the_limit_of_marks():
    own, c = indented(), pieces.Coder(public_tokenizers.path("piece_bpe_32k.model"))
    whole, c.lib = c.lib, Lossy(c.lib)
    c.table.limit = 3
    for i in [*range(0, len(own), 2), *range(len(own) - 2)]:
        ids, decoded = c.code(own[i : i + 2])
        assert ids == [packed(whole.encode(t, add_bos=True, add_eos=True)) for t in own[i : i + 2]]
        assert decoded == [c.lib.decode(whole.encode(t, add_bos=True, add_eos=True)) for t in own[i : i + 2]]


def test_bpe_of_indented_texts():
    own, b, lib = indented(), packing.Bpe(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    assert b.code(own, b"") == [packed(lib.encode(t, add_special_tokens=False).ids) for t in own]


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(500):
        n = r.choice([r.randrange(1, 100), r.randrange(1, 60)])
        counts[n] = counts.get(n, 0) + 1
    patterns = packing.best_two_fit(counts, 100)
    used = {}
    for pattern, times in patterns:
        assert sum(pattern) <= 100 and times > 0
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    bins = sum(t for _, t in patterns)
    assert bins <= -(-sum(n * c for n, c in counts.items()) // 100) * 1.02 + 1
    places, total = packing.places(patterns)
    assert total == bins
    for n, c in counts.items():
        own = sorted((lo, hi) for length, lo, hi, _, _ in places if length == n)
        assert own[0][0] == 0 and own[-1][1] == c and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_two_replace_one():
    assert packing.best_two_fit({60: 1, 35: 1, 25: 1, 15: 1}, 100)[0] == ((60, 25, 15), 1)


def test_pack_documents(spark):
    docs = [(1, "a b c"), (2, None), (2, None), (None, "x"), (3, "word " * 3000), (4, ""), (5, "é" * 700), (6, "x <|endoftext|> y")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, sequence_id long")
    rows = packing.pack_documents(frame, ["doc_id"]).collect()
    own = sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert own == sorted((d or 0, *x) for d, *x in brute.op2_pieces(docs))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(frame.limit(0), ["doc_id"]).collect() == []


def test_encode_decode_nulls(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a  b", 6), (1, None, 5)], "doc_id long, text string, ids long")
    rows = pieces.encode_decode(docs, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == [(0, "a  b"), (1, ""), (1, "")]
    assert pieces.encode_decode(docs.limit(0), ["doc_id"]).collect() == []
