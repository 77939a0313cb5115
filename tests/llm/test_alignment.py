"""The alignment of two tokenisers against whole texts encoded by the libraries."""

import random
from collections import Counter

import brute
import public_tokenizers
import pytest
from test_tokens import texts

from lumenlake.llm import alignment, packing
from lumenlake.llm.common import stored

LETTERS = packing.byte_letters()


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(libraries, "own"):
        a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        libraries.own = a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return libraries.own


def tokens(text):
    """(id, bytes) of both, or nothing where they do not spell the text."""
    a, b = libraries()
    if not text:
        return [], []
    own = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    other = [(i, piece(i)) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (own, other) if b"".join(x for _, x in own) == whole == b"".join(x for _, x in other) else ([], [])


def spans(own):
    at = 0
    for i, x in own:
        yield i, at, at + len(x)
        at += len(x)


def plain(docs):
    pairs, count, found = {}, Counter(), []
    for d, text in docs:
        a, b = (list(spans(x)) for x in tokens(text))
        links = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e] if len(a) < 400 else list(_links(a, b))
        count.update(links)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [f"{','.join(str(x) for x, s, e in a if lo <= s and e <= hi)}|{','.join(str(x) for x, s, e in b if lo <= s and e <= hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(a) < 400 else _groups(a, b, cuts)
        found.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    for (_, y), n in count.items():
        pairs[y] = max(pairs.get(y, 0), n)
    for d, n_a, n_b, n_groups, links, groups in found:
        yield d or 0, n_a, n_b, n_groups, len(links), sum(count[x] == pairs[x[1]] for x in links), sum(count[x] for x in links), brute.sha(groups.encode()) if groups else ""


def _links(a, b):
    i = j = 0
    while i < len(a):
        yield a[i][0], b[j][0]
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)


def _groups(a, b, cuts):
    out, i, j = [], 0, 0
    for hi in cuts:
        x, y = [], []
        while i < len(a) and a[i][2] <= hi:
            x.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= hi:
            y.append(str(b[j][0]))
            j += 1
        out.append(f"{','.join(x)}|{','.join(y)}")
    return out


def hard():
    r = random.Random(5)
    odd = ["x;\r\n y", "a\r b", "a\xa0  b", "a\xa0 b", "\x1c x\x1c  y", "a  b", "a᠎  b", "a​ b", " lead", "\t\tx  y\n", "<0x41> b", "<s>x</s> <|endoftext|> y", "a.\x1c b", "a \x85 b", "tail \xa0", "x\n\n\n  y"]
    marks = [" ", " ", "\n", "\r", "\t", "\xa0", "a", "b", ";", "é", "漢", "1", "\x1c", " ", "the", "ing"]
    return odd + ["".join(r.choice(marks) for _ in range(r.randrange(1, 30))) for _ in range(1500)]


def test_segments_give_the_ids_of_whole_texts():
    p = alignment.pair()
    a, b = libraries()
    assert "\r" not in p.starts and {" ", "\n", "\t"} <= set(p.starts)
    for text in texts() + hard():
        if not text or not p.spelled(text):
            assert tokens(text) == ([], [])
            continue
        segments = p.segments(text)
        assert "".join(segments) == " " + text and segments == p.cuts.split(" " + text)
        own, other = p.tokens(segments)
        assert own.tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert other.tolist() == b.encode(text)


@pytest.mark.parametrize("block,chunk,most_pairs", [(1, 7, 0), (4 << 20, 20_000, 10**6)])
def test_align(spark, monkeypatch, block, chunk, most_pairs):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    docs = [(i, t) for i, t in enumerate(texts()[::8] + hard()[::9], 1)]
    docs += [(9001, None), (9001, None), (None, "a word"), (None, "a word"), (9002, "▁x"), (9003, "long word " * 9000 + "y" * 3000), (9004, docs[3][1])]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, groups string, block long")
    got = alignment.align(frame.repartition(3), ["doc_id", "groups", "block"], most_pairs=most_pairs).collect()
    assert {(r.row.groups, r.row.block) for r in got} == {("x", 1)}
    own = sorted((r.row.doc_id or 0, *[r[c] for c in alignment.SUMS], brute.sha(r.groups.encode()) if r.groups else "") for r in got)
    assert own == sorted(plain(docs))


def test_no_rows(spark):
    docs = stored(spark.createDataFrame([], "doc_id long, text string"), "none")
    assert alignment.align(docs, ["doc_id"]).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.row.doc_id, r.n_a, r.groups) for r in alignment.align(only, ["doc_id"]).collect()) == [(1, 0, ""), (2, 0, "")]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = alignment.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(docs))
