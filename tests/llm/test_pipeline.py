"""Stages and operators against plain versions, on small tables with hard rows."""

import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest

from lumenlake.llm import chat, components, exact, licences, pii, quality, simhash, topk, toxicity

INSULTS = ["fool", "nitwit", "dimwit"]


def prose(r, n=60):
    return " ".join("".join(r.choice(["ta", "ro", "mi", "ne", "sol", "ka"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        text = prose(r)
        toxic = i % 4 == 0
        if toxic:
            w = text.split()
            for at in range(0, len(w), 12):
                w[at] = r.choice(INSULTS)
            text = " ".join(w)
        docs.append((i, text))
        labels.append((i, i % 7 != 0, int(toxic)))
    base = prose(r, 200).split()
    for i in range(300, 310):  # near copies
        w = list(base)
        w[i % 200] = "changed"
        docs.append((i, " ".join(w)))
    docs += [(310, docs[1][1]), (311, docs[1][1].upper()), (312, None), (313, ""), (313, ""), (None, "mail bob@mail.example.com now"), (314, "x" * 5000), (315, "call +1 (555) 123-4567 or 4111 1111 1111 1111, 10.0.0.255")]
    rows = [(d, t, "en", "s", None if t is None else len(t), "extra", 1.5) for d, t in docs]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(q), t) for d, q, t in labels] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def rows_of(df, *columns):
    return sorted((tuple("" if v is None else v for v in r) for r in df.select(*columns).collect()), key=repr)


def plain(rows):
    return sorted((tuple("" if v is None else v for v in r) for r in rows), key=repr)


def test_exact(spark, tables):
    folder, docs = tables
    rows = exact.exact_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    own = rows_of(rows.select("row.doc_id", "keep_id", "group_size", "text_sha256"), "doc_id", "keep_id", "group_size", "text_sha256")
    want = []
    for d, t in docs:
        group = [e for e, u in docs if (u or "").lower() == (t or "").lower()]
        want.append((d, max((g for g in group if g is not None), default=None), len(group), brute.sha((t or "").lower().encode())))
    assert own == plain(want)
    assert rows.filter("kept").count() == len({(t or "").lower() for _, t in docs})
    keyed = [d for d in docs if d[0] is not None and docs.count(d) == 1]
    got = exact.exact_duplicates(spark.createDataFrame(keyed, "doc_id long, text string"), most_bits=1 << 7)  # a filter that is full
    assert rows_of(got.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256"), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain(brute.op8(keyed))


def test_gaps_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 100):
        for top in (200, 1 << 63):
            v = np.unique(r.integers(0, top, n, dtype=np.uint64)) + (np.uint64(1 << 63) if top > 200 else np.uint64(0))
            assert (exact.decode_gaps(exact.encode_gaps(v)) == v).all()


def test_simhash(spark, tables):
    folder, docs = tables
    got = simhash.near_duplicates(simhash.stored(simhash.fingerprints(spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is not null"), ["doc_id"]), "t"))
    own = rows_of(got.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) f", "component_id"), "doc_id", "f", "component_id")
    assert own == plain(brute.op3([d for d in docs if d[0] is not None]))


def test_bk_trees_find_all_links(spark):
    r = random.Random(4)
    values = {r.getrandbits(64) for _ in range(200)}
    for v in list(values)[:60]:
        for _ in range(3):
            v ^= 1 << r.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = components.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    group = {n & (2**64 - 1): x for n, x in found}
    todo, want = set(values), []
    while todo:
        part, ahead = set(), [todo.pop()]
        while ahead:
            v = ahead.pop()
            part.add(v)
            near = {u for u in todo if (u ^ v).bit_count() <= 2}
            todo -= near
            ahead += near
        if len(part) > 1:
            want.append(part)
    assert {frozenset(p) for p in want} == {frozenset(v for v in group if group[v] == x) for x in set(group.values())}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (98, 99), (7, 7)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


PII = [
    "a@b.c_d@e.f", "x.y@z", "a@b..c", "%+@q-w.e-r.t.", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "0.0.0.0001", "4111-1111-1111-1111 2", "4111  111111111111",
    "1 2 3", "+1 (555) 123-4567x +12 +123456789012345 6", "+1234567 89+1 555 123 4567", "é🙂 a@b.co 🙂 10.0.0.1", "9" * 30, "12-34 5678 9012-3", "a" * 3000 + "@x.y", "1 " * 4000, "a@" + "b." * 4000,
]


def test_pii_base(spark):
    r = random.Random(6)
    own = PII + ["".join(r.choice("0123456789  -.+@()ab%é") for _ in range(60)) for _ in range(400)] + [None, ""]
    docs = list(enumerate(own))
    found = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"])
    counts = [f"size(filter(base, x -> x.ord = {i})) c{i}" for i in range(4)]
    got = found.withColumn("h", pii.F.sha2(pii.listed("base"), 256)).selectExpr("row.doc_id", *counts, "h")
    assert sorted(tuple(x) for x in got.collect()) == sorted(brute.op10(docs))


def test_pii_terms(spark):
    docs = [(i, f"n{i} report{i} zorblax wrote with bob@mail.example.com today {i}") for i in range(5)] + [(i, f"the report number with today {i} wrote") for i in range(5, 60)]
    found = {r.row.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect()}
    for i, text in docs:
        terms = [text[s.start : s.end] for s in found[i].spans if s.ord == 4]
        assert terms == (["zorblax"] if i < 5 else [])
        assert [s for s in found[i].spans if s.ord < 4] == found[i].base


def terms_of(spark, docs):
    found = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect()
    text = dict(docs)
    return {r.row.doc_id: [text[r.row.doc_id][s.start : s.end] for s in r.spans if s.ord == 4] for r in found}


def test_pii_many_matches(spark):
    """Blocks of matches give the same spans and texts as a plain pass."""
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["a@b.co", "1.2.3.4", "+1 555 123 4567 8", "x" * r.randrange(9), "é🙂"]) for _ in range(n))) for i, n in enumerate([1, 2, 3, 10, 30, 5000])]
    rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).withColumn("new", pii.redacted("text", "base")).collect()
    for row in rows:
        text, out, at = dict(docs)[row.row.doc_id], [], 0
        for s in row.base:
            assert text[s.start : s.end] == s.value
            if s.start >= at:
                out += [text[at : s.start], f"[{pii.KINDS[s.ord].upper()}]"]
            at = max(at, s.end)
        assert row.new == "".join(out) + text[at:]


def test_pii_terms_of_rare_entities(spark):
    """Two texts tell of an entity, also if its case differs; one and its copies tell nothing."""
    docs = [(i, f"common words {'odd' if i % 2 else 'even'} {i}") for i in range(4000)]
    docs[:3] = [(i, f"common words quuxly {i} bob@mail.example.com") for i in range(2)] + [(2, "common words twicer eve@mail.example.com")]
    docs += [(4000, "common words twicer without"), (4001, "common lonely words 4001 joe@mail.example.com")]
    docs += [(5000 + i, f"common frobnix words {i} {a}@mail.example.com") for i, a in enumerate(["ann", "ANN"])]
    docs += [(6000 + i, docs[2][1]) for i in range(5)]
    got = terms_of(spark, docs)
    assert {d: t for d, t in got.items() if t} == {0: ["quuxly"], 1: ["quuxly"], 5000: ["frobnix"], 5001: ["frobnix"]}


@pytest.mark.parametrize("least", [0, 32 << 20])
def test_pii_terms_everywhere(spark, monkeypatch, least):
    """A term is masked beside its address, far from it, and in texts without it; with and without a broadcast."""
    monkeypatch.setattr(pii, "BROADCAST_BYTES", least)
    monkeypatch.setattr(pii, "BROADCAST_TERMS", least)
    gap = "common words " * 20
    docs = [(i, f"İ {i} bob@mail.example.com {gap}Zorblax wrote {i} zorblax, zorblaxes") for i in range(30)]
    docs += [(30, "only ZORBLAX, no address")] + [(i, f"{gap} wrote zorblaxes {i}") for i in range(31, 400)]
    got = terms_of(spark, docs)
    assert all(got[i] == ["Zorblax", "zorblax"] for i in range(30)) and got[30] == ["ZORBLAX"]
    assert not any(got[i] for i in range(31, 400))


def test_toxicity(spark, tables):
    folder, docs = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    held = [(d, t) for d, t in docs if d is not None and d < 300 and zlib.crc32(str(d).encode()) % 3 == 1]
    score = model.scorer()
    right = sum((score(t) >= 0.7) == (d % 4 == 0) for d, t in held)
    assert right >= 0.95 * len(held)
    rows = toxicity.scored(frame, model, ["doc_id"]).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(frame.limit(0), toxicity.train(frame.limit(0), spark.createDataFrame([], "doc_id long, toxic int")), ["doc_id"]).collect() == []


def test_pipeline_stages(spark, tables):
    folder, docs = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    now = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = corpus_pipeline.stored(stage(spark, now, folder), "t")
        assert now.columns == frame.columns
        texts = {r.doc_id: r.text for r in before.collect()}
        kept = now.collect()
        if name == "toxicity":
            assert {r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 300} == {i for i in range(300) if i % 4}
        elif name == "exact_dedup":
            assert len(kept) == len({(t or "").lower() for t in texts.values()})
        elif name == "near_dedup":
            assert sorted(10**6 if r.doc_id is None else r.doc_id for r in kept) == brute.first_of_near_copies(list(texts.items()))
        else:
            by = {r.doc_id: r for r in kept}
            assert by[None].text == "mail [EMAIL] now" and by[None].n_chars == 16
            assert by[315].text == "call [PHONE] or [CARD], [IP]"
            assert all(by[d].text == t for d, t in texts.items() if d not in (None, 315))
    packed = corpus_pipeline.pack(spark, now, folder).collect()
    assert sum(r.length for r in packed) == sum(len(brute.token_ids(r.text)) for r in now.collect())


def test_near_copies_by_five_words(spark):
    r = random.Random(9)
    docs = []
    for g in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([40, 120, 400]))]
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(None, docs[0][1] + " "), (200, "a b"), (201, "A  b"), (202, "a c"), (203, ""), (204, None), (205, " \n")]
    for k in range(150):  # a crowd on both sides of the threshold
        w = [f"c{i}" for i in range(80)]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(80)] = f"odd{r.randrange(10**6)}"
        docs.append((1000 + k, " ".join(w)))
    want = brute.first_of_near_copies(docs)
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(10**6 if k.doc_id is None else k.doc_id for k in kept) == want


def test_chat(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"</turn> \\ ### {i}\n") for i in range(200)]
    turns += [(None, None, None, None), (2, 0, "a: b\\", "x</turn>\n### assistant: y"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    rows = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), run=16).collect()}
    for conv in (1, 2, None):
        own = sorted(((r or "", t or "") for c, _, r, t in turns if c == conv), key=lambda x: 0) if conv == 1 else sorted((r or "", t or "") for c, _, r, t in turns if c == conv)
        assert chat.read_back(rows[conv].formatted) == own
        said = [chat.unescape(rows[conv].formatted[x.start : x.end]) for x in rows[conv].loss]
        assert said == [t for r, t in own if r == "assistant"]


def test_topk(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=8).astype(float).tolist()) for i in range(120)] + [(200, [0.5] * 8)] * 30 + [(0, [1.0] * 8), (100, None), (100, [float("nan")] * 8), (100, [1.0, None] * 4), (7, [1.0] * 3), (100, [2.0] * 3), (300, [1e9] * 8)]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding", "{key} % 100 = 0", sample=40, pivots=4, rings=3, cell=16)
    rows = sorted(tuple(x) for x in got.collect())
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(ok):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert rows == sorted(want)


def test_topk_keys_and_limits(spark):
    """String keys, an empty table, and sizes that 64 bits cannot hold."""
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.5, 0.0]), (None, [2.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "name string, e array<double>"), "name", "e", "{key} = 'a'", k=3, sample=3, pivots=2, rings=2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, None, 2097152), ("a", 2, "b", 1048576), ("a", 3, "c", 524288)]
    assert topk.top_k(spark.createDataFrame([], "name string, e array<double>"), "name", "e", "true").collect() == []
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([("a", [1e17])], "name string, e array<double>"), "name", "e", "true").collect()
    with pytest.raises(OverflowError):
        topk.products(np.array([[4e12]]), np.array([4e12]))


def test_kneser_ney(spark, tables):
    counts = {}
    for t in ("abracadabra", "abba", "barbara"):
        for g in quality.grams_of([t])[0].tolist():
            counts[g] = counts.get(g, 0) + 1
    model = quality.model_of(spark.createDataFrame([("en", g, c) for g, c in counts.items()], "lang string, gram long, c long")).collect()
    model.sort(key=lambda m: m.key)
    arrays = [np.array([m[c] for m in model]) for c in ("key", "alpha", "gamma")]
    for context in (b"abra", b"\n\n\nb", b"zzzz", b"zzzb"):
        head = int.from_bytes(context, "big") << 8
        assert quality.probabilities(np.arange(256) | head, *arrays).sum() == pytest.approx(1)
    folder, docs = tables
    rows = quality.judged(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert len(rows) == len(docs)
    kept = {r.doc_id: r.kept for r in rows}
    assert not kept[312] and not kept[314] and sum(kept[i] for i in range(1, 300)) > 280


def test_licences(spark):
    texts = ["Some text.\nReleased under the MIT License.", "a licence plate", None, "", "x\n\nLicensed under the Apache License, Version 2.0.\n\ny", "Permission is hereby granted to enter."]
    rows = sorted(licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect())
    named = [[f.family for f in r.findings if f.confirmed] for r in rows]
    assert named == [["MIT"], [], [], [], ["Apache-2.0"], []]
    at = rows[4].findings[0]
    assert texts[4][at.start : at.end] == "Licensed under the Apache License, Version 2.0."
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def test_licence_model():
    """Short forms, other licences, every paragraph against a plain scorer, and families never seen."""
    model = licences.Model()
    names = lambda x: [f["family"] for f in model.findings([x], 0.6, 0.8)[0]]
    short = {"Distributed under the GNU GPL v3.": "GPL", "CC BY-SA 4.0": "CC-BY-SA", "Available under the Apache 2.0 terms.": "Apache-2.0", "All rights reserved.": "proprietary", "MIT License": "MIT"}
    assert all(names(x) == [f] for x, f in short.items())
    assert all(names(x) == ["unknown"] for x in ("Licensed under the EUPL 1.2.", "ISC License", "This file is in the public domain.", "Released under the Quux License."))
    assert model.calibration_error < 0.05
    r = random.Random(3)
    words = [*model.words, "nie", "zero", "plum"]
    texts = ["\n".join(" ".join(r.choice(words) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 5))) for _ in range(60)] + [t for ts in licences.TEMPLATES.values() for t in ts]
    units = [licences.units_of(t) for t in texts]
    named, p = model._scores(texts, units)
    flat = [t[a:b] for t, own in zip(texts, units, strict=True) for a, b in own]
    want = model.probabilities(np.array([model.vector(t) for t in flat]))
    assert np.allclose(p, want[named])
    assert all(not model.vector(flat[i]).any() for i in set(range(len(flat))) - set(named.tolist()))
    left = licences.Model(leave="MPL-2.0").findings(licences.TEMPLATES["MPL-2.0"], 0.6, 0.8)
    assert {f["family"] for own in left for f in own} <= {"unknown"}
