"""Near copies through SimHash fingerprints and BK-trees, against plain versions."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from lumenlake.llm import common, nearcopies, simhash


def crowd(r, n, words=60):
    """Texts on both sides of the threshold, with short ones and some without words."""
    docs = [(i, t) for i, t in enumerate(["a b c d e f g h", "a b c d e f g h i", "A  b", "a b", "", None, " \n"])]
    base = [f"c{i}" for i in range(words)]
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(words)] = f"odd{r.randrange(10**6)}"
        docs.append((100 + i, " ".join(w)))
    r.shuffle(docs)
    return docs


def kept(spark, docs):
    rows = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    return sorted(r.doc_id for r in rows)


def test_group_links():
    r = random.Random(5)
    values = [r.getrandbits(512) for _ in range(12)]
    for _ in range(150):
        v = r.choice(values)
        for b in r.sample(range(512), r.randrange(1, 220)):
            v ^= 1 << b
        values.append(v)
    links = simhash.group_links(values, 144)
    assert all((u ^ v).bit_count() <= 144 for u, v in links)
    group = {v: {v} for v in values}

    def join(u, v):
        if group[u] is not group[v]:
            group[u] |= group[v]
            for x in group[u]:
                group[x] = group[u]

    for u, v in links:
        join(u, v)
    own = {frozenset(g) for g in group.values()}
    for i, v in enumerate(values):
        for u in values[:i]:
            if (u ^ v).bit_count() <= 144:
                join(u, v)
    assert own == {frozenset(g) for g in group.values()} and 1 < len(own) < len(values)


def test_fingerprints():
    r = np.random.default_rng(6)
    for n in (0, 1, 4, 5, 1024, 3000):
        hashes = r.integers(0, 1 << 64, n, dtype=np.uint64)
        counts = [0] * 512
        for h in hashes.tolist():
            for w, (times, plus) in enumerate(zip(nearcopies._WORD_TIMES.tolist(), nearcopies._WORD_PLUS.tolist(), strict=True)):
                x = (h * times + plus) % 2**64
                x = (x ^ (x >> 32)) * 0x9E3779B97F4A7C15 % 2**64
                x ^= x >> 29
                for b in range(64):
                    counts[64 * w + b] += x >> b & 1
        assert int.from_bytes(nearcopies.fingerprint(hashes), "little") == sum((2 * c > n) << i for i, c in enumerate(counts))


def test_radius():
    """Sets of similarity 0.8 are within the radius, unrelated ones are not."""
    r = np.random.default_rng(7)
    bits = lambda x: int.from_bytes(nearcopies.fingerprint(x), "little")
    for a, b, both in ((4, 5, 4), (5, 6, 5), (9, 9, 8), (18, 18, 16), (45, 45, 40), (40, 50, 40), (450, 450, 400)):
        assert both / (a + b - both) >= 0.8
        for _ in range(150):
            h = r.integers(0, 1 << 64, a + b - both, dtype=np.uint64)
            x, y = h[:a], np.concatenate([h[:both], h[a:]])
            assert (bits(x) ^ bits(y)).bit_count() <= nearcopies.RADIUS
            assert (bits(x) ^ bits(r.integers(0, 1 << 64, b, dtype=np.uint64))).bit_count() > nearcopies.RADIUS


def test_fingerprints_decide_candidates(spark, monkeypatch):
    docs = crowd(random.Random(8), 20)
    table = common.stored(nearcopies.banded(spark.createDataFrame(docs, "_row long, text string"), ["_row", "text"]), "t")
    assert nearcopies.shard_links(table).count() > 10
    monkeypatch.setattr(nearcopies, "RADIUS", -1)
    equal = {tuple(x) for x in nearcopies.shard_links(table).filter("a < 100").collect()}
    assert equal == {(2, 3), (4, 5), (4, 6)}  # equal sets have equal fingerprints


@pytest.mark.parametrize(("texts", "most", "most_in_trees"), [(512, 1 << 19, 4096), (8, 1 << 19, 4096), (512, 300, 4096), (8, 300, 3)])
def test_blocks_and_crowds(spark, monkeypatch, texts, most, most_in_trees):
    """Clusters in one task, cut into blocks by rows and by shingles, and shards without trees give the same."""
    monkeypatch.setattr(nearcopies, "TEXTS", texts)
    monkeypatch.setattr(nearcopies, "MOST", most)
    monkeypatch.setattr(nearcopies, "CROWD", most_in_trees)
    docs = crowd(random.Random(9), 90)
    assert kept(spark, docs) == brute.first_of_near_copies(docs)


def test_search_leaves_no_tables(spark):
    """Only what the result reads stays on disk: the rows and those that go."""
    before = common.written()
    assert kept(spark, crowd(random.Random(10), 30))
    assert [p.rpartition("/")[2].rpartition("-")[0] for p in common._written[before:]] == ["pipeline-rows", "pipeline-gone"]
