"""The quality and toxicity models against plain versions with dictionaries and loops."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lumenlake.llm import quality, toxicity

ORDER = 5


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney over bytes: a function from text to perplexity."""
    counts = [None] * (ORDER + 1)
    counts[ORDER] = Counter()
    for t in texts:
        data = b"\n" * (ORDER - 1) + t.encode()
        counts[ORDER].update(data[i - ORDER + 1 : i + 1] for i in range(ORDER - 1, len(data)))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])  # how many bytes stand to the left
    discounts, totals, left = {}, {}, {}
    for k in range(1, ORDER + 1):
        n = Counter(counts[k].values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            discounts[k] = [max(0.05, min(i - 0.05, x)) for i, x in zip((1, 2, 3), raw, strict=True)]
        else:
            discounts[k] = [0.6, 1.2, 1.8]
        totals[k], left[k] = Counter(), defaultdict(float)
        for g, c in counts[k].items():
            totals[k][g[:-1]] += c
            left[k][g[:-1]] += discounts[k][min(c, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / 256
        k, context = len(gram), gram[:-1]
        lower = p(gram[1:])
        if not totals[k][context]:
            return lower
        c = counts[k][gram]
        return ((c - discounts[k][min(c, 3) - 1] if c else 0) + left[k][context] * lower) / totals[k][context]

    def perplexity(t):
        data = b"\n" * (ORDER - 1) + t.encode()
        own = [math.log(p(data[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(data))]
        return math.exp(-sum(own) / len(own)) if own else None

    return perplexity


def test_kneser_ney_equals_dictionaries(spark):
    r = random.Random(12)
    words = {"en": ["the", "cat", "sat", "on", "mats", "again"], "de": ["über", "den", "Zaun", "läuft", "sie"]}
    docs, labels = [], []
    for i in range(60):
        lang = r.choice(["en", "de"])
        text = " ".join(r.choice(words[lang]) for _ in range(r.randrange(1, 30))) if i % 6 else "".join(r.choice("xqzjvk é") for _ in range(r.randrange(1, 60)))
        docs.append((i, text, lang))
        if i % 3:
            labels.append((i, int(i % 6 != 0), 0))
    docs += [(60, "", "en"), (61, None, None), (62, "the cat", None), (63, "the cat", "fr"), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {}
    for x in quality.judged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        got[x.doc_id] = x
    good = {i for i, q, _ in labels if q}
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    plain, want = {}, {}
    for lang in ("en", "de", "fr", ""):
        plain[lang] = kneser_ney([t for i, t, g in docs if i in good - held and (g or "") == lang])
    for i, t, g in docs:
        want[i] = plain[g or ""](t or "")
    for i, _, g in docs:
        assert got[i].lang == (g or "")
        assert got[i].perplexity == (None if want[i] is None else pytest.approx(want[i], rel=1e-4))
    bound = lambda ids: (s := sorted(want[i] for i in ids))[math.ceil(0.995 * len(s)) - 1]
    for i, _, g in docs:
        own = [j for j in held if docs[j][2] == g]
        most = bound(own or held)
        assert got[i].highest == pytest.approx(most, rel=1e-4)
        assert got[i].kept == (want[i] is not None and want[i] <= most * (1 + 1e-9))


def plain_features(text):
    words = (text or "").lower().split()
    out = defaultdict(float)
    for w, c in Counter(words).items():
        rate = 100 * min(c, max(1.0, 0.02 * len(words))) / len(words)
        data = b"\x02" + w.encode() + b"\x03"
        for n in (3, 4, 5, 6):
            for i in range(len(data) - n + 1):
                out[zlib.crc32(data[i : i + n]) % (1 << 20)] += rate
    return dict(out)


def plain_scores(texts, toxic, prior, asked, rounds=300):
    """Naive Bayes ratios, and Adam over all rows, feature by feature."""
    own = [plain_features(t) for t in texts]
    n, n1 = len(texts), sum(toxic)
    has = [Counter(), Counter()]
    for f, t in zip(own, toxic, strict=True):
        has[t].update(f.keys())
    p, q = (lambda b: 0.5 + has[1][b]), (lambda b: 0.5 + has[0][b])
    ratio = {b: math.log(p(b) / (n1 + 1)) - math.log(q(b) / (n - n1 + 1)) for b in set(has[0]) | set(has[1])}
    ratio = {b: x for b, x in ratio.items() if abs(x) >= 3 * math.sqrt(1 / p(b) + 1 / q(b))}
    rows = [{b: v * ratio[b] for b, v in f.items() if b in ratio} for f in own]
    cost = [(prior / (n1 / n) if t else (1 - prior) / (1 - n1 / n)) / n for t in toxic]
    w, m, v = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0)
    bias, mb, vb = math.log(prior / (1 - prior)), 0.0, 0.0
    for k in range(1, rounds + 1):
        error = [(1 / (1 + math.exp(-(bias + sum(w[b] * x for b, x in row.items())))) - t) * c for row, t, c in zip(rows, toxic, cost, strict=True)]
        step = lambda a, b: 0.02 * (a / (1 - 0.9**k)) / (math.sqrt(b / (1 - 0.999**k)) + 1e-9)  # noqa: B023, E731
        gradient = {b: 1e-3 * w[b] for b in w}
        for row, e in zip(rows, error, strict=True):
            for b, x in row.items():
                gradient[b] += x * e
        for b, g in gradient.items():
            m[b], v[b] = 0.9 * m[b] + 0.1 * g, 0.999 * v[b] + 0.001 * g * g
            w[b] -= step(m[b], v[b])
        g = sum(error)
        mb, vb = 0.9 * mb + 0.1 * g, 0.999 * vb + 0.001 * g * g
        bias -= 5 * step(mb, vb)
    return [1 / (1 + math.exp(-(bias + sum(w[b] * ratio[b] * x for b, x in plain_features(t).items() if b in w)))) for t in asked]


def test_toxicity_equals_loops(spark):
    r = random.Random(3)
    words = ["tavo", "remi", "solka", "nepu", "Über", "karo"]
    docs, labels = [], []
    for i in range(90):
        own = [r.choice(words) for _ in range(r.randrange(1, 25))]
        toxic = int(i % 3 == 0)
        if toxic:
            own.insert(r.randrange(len(own)), r.choice(["nitwit", "dimwit"]))
        docs.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    docs += [(90, None), (91, ""), (92, "nitwit " * 40), (93, "é" * 500)]
    docs += [(0, "another row with the key"), (0, "another row with the key")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x.doc_id, x.text): x.score for x in toxicity.scored(df, model, ["doc_id", "text"]).collect()}
    import xxhash

    known = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (1 << 64 if h >> 63 else 0)
    rows = []
    for i, _, toxic in known:
        rows.append((min((t for d, t in docs if d == i), key=lambda t: (signed(t), t)), toxic))
    asked = [t for _, t in docs]
    want = plain_scores([t for t, _ in rows], [t for _, t in rows], sum(t for _, _, t in known) / len(known), asked)
    for (d, t), s in zip(docs, want, strict=True):
        assert got[d, t] == pytest.approx(s, abs=1e-4)
    assert max(got[i, docs[i][1]] for i in range(90) if i % 3) < 0.7 < min(got[i, docs[i][1]] for i in range(0, 90, 3) if i)
