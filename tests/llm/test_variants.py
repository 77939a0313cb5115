"""Spelling variants against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare

from lumenlake.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def plain_groups(counts, ratio=10):
    form, rows = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = n, len(near), counts[form[w]] if form[w] else None
    for w, (n, n_near, form_n) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, n_near, form_n


def plain_counts(docs):
    words = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def test_neighbourhoods_are_whole_and_distinct():
    every = np.full(64, 2**64 - 1, np.uint64)  # a filter that all pass
    around = variants.Neighbourhood("abé", every)
    words = ["aab", "a", "bbb", "éab", "ba"]
    got = [[] for _ in words]
    for word, h, at, kind, letter in around.edits(words):
        for w, x, i, k, c in zip(word.tolist(), h.tolist(), at.tolist(), kind.tolist(), letter.tolist(), strict=True):
            text = words[w][:i] + (chr(c) if c else "") + words[w][i + (k < 2) :]
            assert x == int(variants.hashes([text])[0])
            got[w].append(text)
    for w, own in zip(words, got, strict=True):
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for c in "abé" for k in (0, 1) for i in range(len(w) + 1)} - {w}
        assert sorted(own) == sorted(want - {w})


@pytest.mark.parametrize("most_bits", [1 << 6, 1 << 27])
def test_grouped(spark, monkeypatch, most_bits):
    monkeypatch.setattr(variants, "SLICE", 50)
    r = random.Random(2)
    counts = {}
    for _ in range(150):
        w = "".join(r.choice("abñ") for _ in range(r.randrange(1, 8)))
        counts[w] = r.choice([1, 2, 2, 20, 20, 400, 8000])
    counts["x" * 5000], counts["x" * 2500 + "y" + "x" * 2500], counts["漢字"], counts["漢"] = 3, 99, 5, 50
    rows = variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n int"), most_bits=most_bits).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows) == key(plain_groups(counts))


def test_query_on_hard_rows(spark, tmp_path):
    r = random.Random(4)
    base = ["Éclatante", "éclatante", "ECLATANTE", "straßen×weg", "morphologie", "morphologi", "morphologies", "xmorphologie", "zzzzzzz", "zzzzzzzz", "short"]
    docs = [(i, " ".join(r.choice(base[:10]) + r.choice([",", "1", "", "漢"]) for _ in range(40))) for i in range(60)]
    docs += [(None, "morphologie morphologie"), (None, "morphologie morphologie"), (7, None), (7, ""), (8, "morphologie " * 3000), (9, "w" * 30_000 + " " + "w" * 30_000)]
    spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in variants.op12_variants(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(plain_groups(plain_counts(docs)), key=repr)
    assert compare(spark, str(tmp_path), "op12_variants", variants.op12_variants, variants.OP12_SQL) is None


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert variants.op12_variants(spark, str(tmp_path)).collect() == []


def test_query(spark):
    assert compare(spark, "/root/testdata/sf0.001", "op12_variants", variants.op12_variants, variants.OP12_SQL) is None
