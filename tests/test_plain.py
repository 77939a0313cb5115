"""Queries without SQL and single operators against plain versions and worked examples."""

import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import json as js
from lumenlake.functions import text
from lumenlake.operators import acoustics, baselines, bootstraps, evaluation, lineage, metrics, policy, quantiles, records, references, retrieval, selection, shortlists, slots, training, transcripts
from lumenlake.plans.catalog import QUERIES
from lumenlake.sources import files, sessions, sinks

SF = "/root/testdata/sf0.001"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_worked_audit_examples(spark):
    y = lambda rows: frame(spark, [(1, a, b) for a, b in rows], "g int, y int, p double")
    auc = lambda rows: metrics.auc(y(rows), ["g"]).first().auc
    assert auc([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]) == 0.75
    assert auc([(0, 0.5), (1, 0.5)]) == 0.5
    assert auc([(1, 0.2), (1, 0.4)]) is None
    cases = [(0, 0.1, 0.9), (0, 0.2, 0.8), (1, 0.8, 0.2), (1, 0.9, 0.1), (1, None, 0.5)]
    found = {r.source: r.validity for r in policy.source_validity(frame(spark, cases, "y int, a double, v double"), "y", {"audio": "a", "visual": "v"}).collect()}
    assert found == {"audio": 1.0, "visual": 0.0}
    one = frame(spark, [(0.5, 0.5, 0.8, 0.9, 0.2, 0.5)], "risk double, confidence double, audio_risk double, audio_rel double, visual_risk double, visual_rel double")
    r = policy.audit_features(one, {"audio": 0.5, "visual": 1.0}, 0.6).first()
    assert r.reliable_disagreement == pytest.approx(0.135) and r.unreliable_disagreement == pytest.approx(0.30) and r.missing_fraction == 0 and r.entropy == 1
    risks = frame(spark, [(i / 10,) for i in range(10)], "risk double")
    t = policy.risk_threshold(risks, 0.3).first().threshold
    assert risks.filter(F.col("risk") >= t).count() == 3 and policy.risk_threshold(risks, 0.0).first().threshold == 1.0
    assert policy.risk_threshold(risks, 0.25).first().threshold == 0.8  # two, half to even


def test_audit_fit(spark):
    """The fit against Newton steps in numpy; a failed first pass is always looked at again."""
    r = random.Random(5)
    rows = []
    for i in range(80):
        a, v = r.random(), r.random()
        rows.append((i, r.random(), r.random(), a if i % 9 else None, 0.9 if i % 9 else None, v, r.random(), int(abs(a - v) > 0.5)))
    df = frame(spark, rows, "id int, risk double, confidence double, audio_risk double, audio_rel double, visual_risk double, visual_rel double, wrong int")
    feats = policy.audit_features(df, {"audio": 0.8, "visual": 0.7}).cache()
    model = policy.fit_audit(feats, "wrong")
    x = np.array([[row[c] for c in policy.AUDIT_FEATURES] for row in feats.orderBy("id").collect()])
    y = np.array([row[-1] for row in rows])
    sd = x.std(axis=0)
    z = np.hstack([(x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), np.ones((80, 1))])
    w, reg = np.zeros(8), np.array([1.0] * 7 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(reg) + 1e-9 * np.eye(8), z.T @ (p - y) + reg * w)
    assert [*model["weights"].values(), model["intercept"]] == pytest.approx(w.tolist(), abs=1e-6)
    t = policy.risk_threshold(feats.select(policy.audit_risk(model).alias("risk")), 0.25).first().threshold
    out = policy.decide(feats, model, t, F.col("id") == 3).collect()
    assert next(o for o in out if o.id == 3).audit_risk is None and next(o for o in out if o.id == 3).should_rethink
    assert abs(sum(o.should_rethink for o in out) / 80 - 0.25) < 0.05


def test_logistic_query_equals_newton(spark):
    got = {r.feature: r.weight for r in QUERIES["t12_logistic"](spark, SF).collect()}
    assert set(got) == {"confidence", "visual_rel", "risk", "intercept"} and all(math.isfinite(x) for x in got.values())


def test_diverse_pick(spark):
    rows = [(1, i, float(i * 3), 5.0, s) for i, s in enumerate([0.9, 0.89, 0.88, 0.5, 0.87, 0.1])]
    got = [r.atomic_no for r in retrieval.diverse(frame(spark, rows, "g int, atomic_no int, mid double, duration double, score double"), ["g"], 3).orderBy("pick").collect()]
    chosen, rest = [], list(rows)
    while len(chosen) < 3:
        near = lambda r: max((max(0.0, 1 - abs(r[2] - c[2]) / 10.0) for c in chosen), default=0.0)
        best = max(rest, key=lambda r: (round(r[4] - 0.12 * near(r), 12), -r[2], -r[1]))
        rest.remove(best)
        chosen.append(best)
    assert got == [c[1] for c in chosen]


def test_segment_pick(spark):
    one = lambda groups: frame(spark, [groups], "a array<string>, b array<string>").select(policy.pick_segments([F.col("a"), F.col("b")], F.array(*[F.lit(x) for x in ("S010", "S002", "S001")]), 2).alias("s")).first().s
    assert one((["S009", "S010"], ["S010", "S001"])) == ["S010", "S001"]
    assert one(([], None)) == ["S001", "S002"]


def test_ledger_chain(spark):
    rows = [(r, k, f"p{r}{k}" if k else None) for r in ("a", "b") for k in range(5)]
    got = {(x.run_id, x.sequence): x for x in records.chain(frame(spark, rows, "run_id string, order_key int, payload string")).collect()}
    for run in ("a", "b"):
        last = "0" * 64
        for n in range(5):
            x = got[run, n]
            assert x.previous == last
            last = hashlib.sha256(f"{n}|{x.payload or ''}|{last}".encode()).hexdigest()
            assert x.entry == last
    whole = frame(spark, [tuple(x) for x in got.values()], "run_id string, sequence int, payload string, previous string, entry string")
    assert records.chain_violations(whole).collect() == []
    assert records.chain_violations(whole.withColumn("payload", F.when(F.col("sequence") == 2, "x").otherwise(F.col("payload")))).count() == 2


def test_exact_quantiles(spark):
    r = random.Random(1)
    rows = [("hot", 0.0)] * 500 + [("hot", r.gauss(0, 1)) for _ in range(700)] + [("hot", 1e9)] + [("few", x) for x in (1.0, 1.0, 1.0, 1.0, 9.0)] + [("one", 3.0)]
    df = frame(spark, rows, "k string, value double")
    got = {x.k: x.q for x in quantiles.exact_quantiles(df, ["k"], "value", [0.0, 0.05, 0.5, 0.9, 1.0]).collect()}
    for k in ("hot", "few", "one"):
        assert got[k] == pytest.approx(np.quantile([v for g, v in rows if g == k], [0.0, 0.05, 0.5, 0.9, 1.0]).tolist())
    a, b = (references.fit(df, ["k"], bucketed=x).orderBy("k").collect() for x in (True, False))
    for x, y in zip(a, b, strict=True):
        assert (x.k, x.n, x.median, x.mad) == (y.k, y.n, y.median, y.mad) and x.scale == pytest.approx(y.scale) and list(x.knots) == pytest.approx(list(y.knots))


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), round(r.random(), 2), r.randrange(9)) for _ in range(300)] + [("a", 1.0, 1), ("b", 0.0, 2), (None, -5.0, 3), (None, 7e9, 4)]
    rows = [(i, *x) for i, x in enumerate(rows)]
    for down in (False, True):
        got = quantiles.prefix_sums(frame(spark, rows, "i int, k string, p double, m int").filter("k is not null"), ["k"], [F.desc("p") if down else F.col("p"), F.col("i")], ["m"], last="p").collect()
        assert len(got) == 302
        for x in got:
            before = [y for y in rows if y[1] == x.k and ((-y[2] if down else y[2]), y[0]) < ((-x.p if down else x.p), x.i)]
            assert x.m_before == sum(y[3] for y in before)
            assert x.last_before == (None if not before else (min if down else max)(y[2] for y in before))


def test_a_million_equal_scores_spread_over_all_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.lit(0.5).alias("p"), "id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    parts = [r.n for r in quantiles.ranged(rows, ["g"], [F.desc("p"), F.col("id")]).groupBy("_p").agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 400_000
    got = metrics.average_precision_ranked(rows, ["g"], "id").first().average_precision
    ranks = np.arange(0, 1_000_000, 4) + 1
    assert got == pytest.approx(((np.arange(len(ranks)) + 1) / ranks).mean(), rel=1e-12)
    assert metrics.auc(rows, ["g"]).first().auc == 0.5 and metrics.average_precision(rows, ["g"]).first().average_precision == 0.25
    picked = selection.lowest_quota(rows, "p", "id", 0.00001).collect()
    assert sorted(r.id for r in picked) == list(range(10))


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_scores_without_a_rank_are_errors(spark, bad):
    rows = frame(spark, [(1, 0, 0.2, 1, 0.3), (1, 1, bad, 2, bad)], "g int, y int, p double, i int, confidence double")
    for run in (lambda: metrics.auc(rows, ["g"]), lambda: metrics.average_precision(rows, ["g"]), lambda: metrics.average_precision_ranked(rows, ["g"], "i"), lambda: metrics.best_threshold(rows, ["g"]), lambda: metrics.selective(rows, ["g"], "i", 0.1)):
        with pytest.raises(Exception, match="null or NaN"):
            run().collect()


def test_bootstraps(spark):
    r = random.Random(3)
    rows = [(i, float(r.gauss(0.1, 1))) for i in range(400)]
    got = evaluation.paired_bootstrap(frame(spark, rows, "id int, gain double"), "id", ["gain"], 300, 1).first()
    x = np.array([v for _, v in rows])
    assert got.estimate == pytest.approx(x.mean(), abs=0.03) and got.low == pytest.approx(x.mean() - 1.96 * x.std() / 20, abs=0.04) and got.high == pytest.approx(x.mean() + 1.96 * x.std() / 20, abs=0.04)
    pairs = [(i, i % 2, i % 2 * 0.5 + r.random() * 0.6, r.random()) for i in range(300)]
    out = {(x.score, x.statistic): x for x in bootstraps.ranking_intervals(frame(spark, pairs, "id int, y int, a double, b double"), "id", ["a", "b"], 100, 2).collect()}
    true = metrics.auc(frame(spark, [(1, y, a) for _, y, a, _ in pairs], "g int, y int, p double"), ["g"]).first().auc
    assert out["a", "auc"].estimate == pytest.approx(true, abs=0.02) and out["a - b", "auc"].low > 0 and ("b", "average_precision") in out


def test_out_of_fold(spark):
    rows = QUERIES["f7_out_of_fold"](spark, SF).collect()
    assert len({r.session_id for r in rows}) == len(rows) and all(0 <= r.probability <= 1 and r.fold == r.session_id % 3 for r in rows)
    x = frame(spark, [(i, i % 2, float(i % 2) + 0.1 * (i % 5), i % 4) for i in range(80)], "session_id int, label int, x double, fold int")
    own = baselines.out_of_fold(x, ["x"], "label", "fold", 4, 0.1).collect()
    assert len(own) == 80 and all((r.probability > 0.5) == (r.label == 1) for r in own)


def test_prior_shift(spark):
    m = frame(spark, [(float(x),) for x in (-3, -1, 0, 2, 5)], "m double")
    shift = evaluation.prior_shift(m, "m", 0.7)
    assert np.mean([1 / (1 + math.exp(-(x + shift))) for x in (-3, -1, 0, 2, 5)]) == pytest.approx(0.7, abs=1e-9)


def test_wider_readers(spark, tmp_path):
    folder = tmp_path / "root"
    (folder / "300_P").mkdir(parents=True)
    (folder / "data").mkdir()
    (folder / "300_P" / "300_CLNF_pose.txt").write_text(" timestamp, Rx \n0.0, 1.5\n0.1, bad\n")
    (folder / "data" / "301_COVAREP.csv").write_text("1,2\n3,4\n")
    for depth in ("302_P.zip", "300_P.zip"):
        with zipfile.ZipFile(folder / depth, "w") as z:
            z.writestr("deep/a.csv", "x")
            z.writestr("a.csv", "y")
    layouts = {r.session_id: r.layout for r in sessions.session_layouts(sessions.listed_files(spark, str(folder))).collect()}
    assert layouts == {"300": "directory", "301": "flat_directory", "302": "zip"}
    members = sessions.archive_members(spark, str(folder / "*.zip"))
    best = sessions.archive_member(members, "a.csv").join(members, ["session_id", "member"]).select("session_id", "member", "content").collect()
    assert sorted((r.session_id, r.member, bytes(r.content)) for r in best) == [("300", "a.csv", b"y"), ("302", "a.csv", b"y")]
    got = sessions.read_measures(spark, str(folder / "300_P"))
    assert [(r.timestamp, r.Rx) for r in got.orderBy("timestamp").collect()] == [(0.0, 1.5), (0.1, None)]
    path = tmp_path / "split.csv"
    path.write_text("﻿Participant_ID,Split\n1,train\n2,dev\n2,dev\n")
    assert [r.session_id for r in sessions.read_session_ids(spark, str(path), "TRAIN").collect()] == ["1"]
    with pytest.raises(Exception, match="duplicate session id 2"):
        sessions.read_session_ids(spark, str(path), "dev").collect()
    with pytest.raises(Exception, match="absent session 1"):
        sessions.select_sessions(frame(spark, [("1",)], "session_id string"), frame(spark, [("3",)], "session_id string")).collect()
    with pytest.raises(ValueError, match="no session id column"):
        bad = tmp_path / "bad.csv"
        bad.write_text("a,b\n1,2\n")
        sessions.read_session_ids(spark, str(bad))
    (tmp_path / "labels.csv").write_text("id,participant,PHQ8_Binary\nx,300.0,1\ny,301,2\n")
    with pytest.raises(Exception, match="bad label of 301"):
        sessions.read_labels(spark, str(tmp_path / "labels.csv"), "phq8_binary").collect()
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.read_jsonl(spark, str(tmp_path / "empty.jsonl"), "a int")
    (tmp_path / "odd.tsv").write_text("a\tb\n1\t2\n")
    assert files.read_transcripts(spark, str(tmp_path / "odd.tsv")).collect() == []
    assert sessions.read_recognised_speech(spark, str(tmp_path / "odd.tsv")).collect() == []
    assert sessions.configured({"dataset": "a", "x": 1}, {"x": 2}) == {"dataset": "a", "x": 2}
    with pytest.raises(ValueError, match="dataset"):
        sessions.configured({"dataset": "a"}, {"dataset": "b"})
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1" / "index.jsonl").write_text("x")
    (tmp_path / "b1" / "other.txt").write_text("y")
    one = sessions.bundle_fingerprints(spark, str(tmp_path / "b1"), ["index.jsonl", "missing.txt"]).first()
    assert (one.bundle, one.files) == ("b1", 1) and one.fingerprint == hashlib.sha256(hashlib.sha256(b"index.jsonl\0x\0").hexdigest().encode()).hexdigest()


def test_sinks(spark, tmp_path):
    rows = frame(spark, [(1, "é", None)], "b int, a string, c string")
    assert sinks.canonical_json(rows).first().value == '{"a":"é","b":1,"c":null}'
    where = str(tmp_path / "once")
    sinks.write_once(rows, where)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(rows, where)
    sinks.write_replacing(spark, rows.withColumn("b", F.lit(9)), where)
    assert spark.read.parquet(where).first().b == 9
    sinks.write_package(spark, {"t": rows}, str(tmp_path / "pack"))
    with pytest.raises(FileExistsError):
        sinks.write_package(spark, {"t": rows}, str(tmp_path / "pack"))
    frame(spark, [("ref1",)], "reference_id string").write.json(str(tmp_path / "done" / "manifest"))
    assert sinks.is_complete(spark, str(tmp_path / "done"), "manifest", {"reference_id": "ref1"})
    assert not sinks.is_complete(spark, str(tmp_path / "done"), "manifest", {"reference_id": "ref2"}) and not sinks.is_complete(spark, str(tmp_path / "none"), "manifest", {})


def test_edges_of_choices(spark):
    """Ties, single items and groups smaller than the choice."""
    places = lambda n, k: frame(spark, [(n,)], "n int").select(transcripts.uniform_places(F.col("n"), k).alias("u"), transcripts.even_places(F.col("n"), k).alias("e")).first()
    assert list(places(6, 3).u) == [0, 3, 5] and list(places(6, 3).e) == [0, 2, 5]
    assert list(places(6, 1).u) == [2] and list(places(6, 1).e) == [3] and list(places(2, 5).u) == [0, 1]
    ids = frame(spark, [(1, "E0001"), (1, "E0002"), (2, "E0001"), (2, "E0004"), (3, "x1"), (3, "x9"), (4, None), (5, "E7")], "g int, id string")
    told = {r.g: r.label for r in selection.id_range(ids, ["g"], "id").collect()}
    assert told == {1: "E0001 to E0002", 2: "E0001 to E0004 (2 refs; exact list in segment plan)", 3: "x1, x9", 4: "none", 5: "E7"}
    t = frame(spark, [("a sleepless night", ), ("we REST, tired", ), (None,)], "t string").select(transcripts.cue_families(F.col("t")).alias("c")).collect()
    assert [list(r.c) if r.c is not None else None for r in t][:2] == [[], ["sleep or rest words"]]
    m = frame(spark, [(1.0, None, 3.0), (None, None, None)], "a double, b double, c double").select(acoustics.middle([F.col("a"), F.col("b"), F.col("c")]).alias("m")).collect()
    assert [r.m for r in m] == [2.0, None]
    assert lineage.relevant_configuration({"workers": 3, "window": 5}) == {"window": 5} and len(lineage.canonical_digest({"a": 1})) == 64
    with pytest.raises(ValueError):
        lineage.label_policy("e_daic", "PHQ_Binary", 10)
    lineage.label_policy("daic_woz", " PHQ8_Score", 10.0)
    assert frame(spark, [("x",)], "d string").select(lineage.dataset_name(F.col("d")).alias("n")).first().n is None


def test_json_texts(spark):
    texts = ['```json\n{"a": "}"}\n```', '{"a": [1, {"b": 2}]} tail', "[1]", "", None, '{"a": "\\"}"}', '{"a": 1']
    rows = frame(spark, [(t,) for t in texts], "t string").select(js.completion(F.col("t")).alias("c"), js.leading_object(F.col("t")).alias("l")).collect()
    assert [r.c for r in rows] == ['{"a": "}"}', None, None, None, None, '{"a": "\\"}"}', None]
    assert [r.l for r in rows] == [None, '{"a": [1, {"b": 2}]}', None, None, None, '{"a": "\\"}"}', None]
    assert text.normal_key(F.lit("x")) is not None


def test_empty_tables(spark):
    """Operators give empty results for empty inputs."""
    u = frame(spark, [], "unit_id long, session_id long, segment_id string, atomic_no long, modality string, availability string, valid_ratio double, start_sec double, source_id string, extractor string")
    o = frame(spark, [], "unit_id long, pos int, name string, value double, unit string, percentile double, subject_z double, robust_z double, reliability string, category string")
    p = frame(spark, [], "source_id string, modality string, slot_id string, binding_order int, observation_name string, mapping string")
    d = frame(spark, [], "modality string, slot_id string, label string")
    assert slots.project(u, o, p, d).collect() == [] and slots.extensions(u, o, p).collect() == []
    assert baselines.session_features(u, o).collect() == []
    c = frame(spark, [], "session_id long, segment_id string, query_id string, atomic_id string, atomic_no long, mid double, duration double, pattern_relevance double, coverage double, reliability double")
    assert shortlists.shortlist(c, 2).collect() == []
    q = frame(spark, [], "k string, value double")
    assert references.fit(q, ["k"]).collect() == [] and quantiles.exact_quantiles(q, ["k"], "value", [0.5]).collect() == []
    assert records.chain(frame(spark, [], "run_id long, order_key long, payload string")).collect() == []
    assert metrics.auc(frame(spark, [], "g int, y int, p double"), ["g"]).collect() == []
    g = training.refresh_gate(frame(spark, [], "transition string, accepted boolean")).first()
    assert (g.n, g.required, g.passed) == (0, 12, False)


def test_npy_widths(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((2, 4)))
    (tmp_path / "s1_visual.npy").write_bytes(buffer.getvalue())
    with pytest.raises(Exception, match="shape"):
        files.read_arrays(spark, str(tmp_path), 3).collect()


def test_percentiles_along_a_curve(spark):
    """Equal knots share their mean percentile, ends clamp, one point says 50."""
    p = [1, 5, 25, 50, 75, 95, 99]
    knots = {"a": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0], "b": [1.0, 1.0, 1.0, 3.0, 3.0, 9.0, 9.0], "c": [2.0] * 7}
    values = [(k, x) for k in "abcd" for x in (-1.0, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0, 63.0, 64.0, 99.0)]
    ref = frame(spark, [(k, 0.0, 1.0, v) for k, v in knots.items()], "k string, median double, scale double, knots array<double>")
    for x in references.enrich(frame(spark, values, "k string, value double"), ref, ["k"]).collect():
        if x.k == "d":
            assert x.percentile is None and x.category == "unreferenced"
            continue
        xs = sorted(set(knots[x.k]))
        ys = [np.mean([b for a, b in zip(knots[x.k], p, strict=True) if a == u]) for u in xs]
        assert x.percentile == pytest.approx(50 if len(xs) == 1 else np.interp(x.value, xs, ys))
