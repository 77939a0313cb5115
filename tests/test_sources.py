"""File readers and the streaming windows."""

import numpy as np
import pytest

from lumenlake.operators import intervals, metrics, references, windowing
from lumenlake.sources import files
from lumenlake.streaming.windows import window_stats


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n[2]\n')
    assert [r.a for r in files.read_jsonl(spark, str(good), "a int").collect()] == [1, 2]
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(bad), "a int").collect()


def test_arrays_and_manifest(spark, tmp_path):
    np.save(tmp_path / "s1_acoustic.npy", np.arange(6.0).reshape(2, 3))
    rows = sorted(tuple(r) for r in files.read_arrays(spark, str(tmp_path), 3).collect())
    assert rows == [("s1", 0, [0.0, 1.0, 2.0]), ("s1", 1, [3.0, 4.0, 5.0])]
    m = files.manifest(spark, str(tmp_path))
    assert [r.path for r in m.collect()] == ["s1_acoustic.npy"] and len(files.manifest_digest(m)) == 64


def test_transcripts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Start_Time\tstop_time\tspeaker\tvalue\n0\t1\tEllie\thi\n1\tx\tEllie\tbad\n2\t3\tParticipant\tscrubbed_entry\n")
    rows = [tuple(r) for r in files.read_transcripts(spark, str(path)).orderBy("start_sec").collect()]
    assert rows == [(0.0, 1.0, "hi", False, "interviewer"), (2.0, 3.0, None, True, "participant")]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type", "cast(ts as timestamp) ts", "value")
    source.write.parquet(str(tmp_path / "in"))
    args = ("ts", "value", ["event_type"], "5 days", "2 days", "100 days")
    q = window_stats(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), *args).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.event_type, r.start, r.n, round(r.mean, 9)) for r in df.collect())
    assert key(spark.table("w")) == key(window_stats(source, *args))


def test_fixtures(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    w = windowing.make_windows(one([("a", 12.0)], "session_id string, duration double"), 5, 2.5, 2.5).orderBy("start_sec").collect()
    assert [r.start_sec for r in w] == [0, 2.5, 5, 7.5] and w[-1].end_sec == 12
    m = intervals.merge_intervals(one([("s", 0.0, 2.0, "a"), ("s", 2.0, 3.0, "b"), ("s", 5.0, 6.0, "a")], "session_id string, start_sec double, end_sec double, reason string"))
    assert sorted(tuple(r)[1:] for r in m.collect()) == [(0.0, 3.0, "a+b"), (5.0, 6.0, "a")]
    r = references.fit(one([("x", float(v)) for v in (1, 1, 1, 1, 9)], "k string, value double"), ["k"]).first()
    assert r.mad == 0 and abs(r.scale - 3.2) < 1e-12
    p = one([(0, 1, 0.1), (0, 0, 0.1), (1, 0, 0.1), (1, 1, 0.35), (1, 0, 0.4), (1, 1, 0.8)], "g int, y int, p double")
    assert {x.g: x.auc for x in metrics.auc(p, ["g"]).collect()} == {0: 0.5, 1: 0.75}
    t = metrics.best_threshold(one([(1, 0, 0.2), (1, 1, 0.8)], "g int, y int, p double"), ["g"]).first()
    assert t.threshold == 0.5 and t.balanced_accuracy == 1
    assert [x.s for x in one([(3723.5,), (61.0005,)], "t double").select(windowing.format_time(windowing.F.col("t")).alias("s")).collect()] == ["01:02:03.500", "01:01.000"]


def test_archives(spark, tmp_path):
    import zipfile

    from lumenlake.sources import sessions

    for name, members in {"300_P.zip": {"a/x.csv": "deep", "x.csv": "own", "y.csv": "no"}, "301_P.zip": {"bb/x.csv": "long", "a/x.csv": "short"}, "302_P.zip": {"x.csv.bak": "no"}, "other.zip": {"x.csv": "no"}}.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / "sub" / name, "w") as archive:
            for member, content in members.items():
                archive.writestr(member, content)
    got = sessions.read_archives(spark, str(tmp_path), "x.csv").collect()
    assert sorted((r.session_id, r.member, bytes(r.content)) for r in got) == [("300", "x.csv", b"own"), ("301", "a/x.csv", b"short")]
