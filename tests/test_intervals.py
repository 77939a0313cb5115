"""Interval joins against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import intervals


def hard(r, n, top=1000.0):
    """Ranges from nothing to a billion seconds, on and off the borders of cells."""
    rows = []
    for i in range(n):
        start = r.choice([r.uniform(-top, top), float(r.randrange(-20, 20) * 60), 0.0])
        length = r.choice([0.0, 1e-9, 1.0, 60.0, 120.0, r.uniform(0, 500), r.uniform(0, 5000), 1e9])
        rows.append((r.randrange(3), i, start, start + length))
    return rows


def pairs_of(left, right):
    return sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])


@pytest.mark.parametrize("width", [60.0, 0.7, 1e6])
def test_overlap_join(spark, width):
    r = random.Random(int(width))
    left, right = hard(r, 120), hard(r, 150)
    a = spark.createDataFrame(left, "session_id int, i int, start_sec double, end_sec double")
    b = spark.createDataFrame(right, "session_id int, j int, r_start double, r_end double")
    got = intervals.overlap_join(a, b, width)
    assert got.columns == ["session_id", "i", "start_sec", "end_sec", "j", "r_start", "r_end"]
    assert sorted((x.i, x.j) for x in got.collect()) == pairs_of(left, right)


def test_an_interval_of_a_billion_seconds_is_three_rows(spark):
    long = spark.createDataFrame([(1, 0.0, 1e9), (1, 5.0, 5.0), (1, 7.0, 8.0)], "session_id int, r_start double, r_end double")
    assert intervals._cells(long, "r_start", "r_end", 60.0).count() <= 9
    points = spark.range(2000).select(F.lit(1).alias("session_id"), (F.col("id") * 1e6 - 1e6).alias("t_sec"))
    both = long.select("session_id", F.col("r_start").alias("start_sec"), F.col("r_end").alias("end_sec"), F.lit("x").alias("reason"))
    got = intervals.points_in_intervals(points, both, 60.0)
    assert got.filter("inside").count() == 1000 and got.count() == 2000


def test_points_in_intervals(spark):
    r = random.Random(7)
    ranges = [x for x in hard(r, 60, 5000.0) if x[3] - x[2] < 1e6]
    points = [(r.randrange(4), r.choice([r.uniform(-6000, 6000), float(r.randrange(-20, 20) * 60)])) for _ in range(400)] + [(0, 0.0)] * 3 + [(0, None), (None, 1.0)]
    df = spark.createDataFrame(ranges, "session_id int, i int, start_sec double, end_sec double").withColumn("reason", F.lit("x"))
    got = intervals.points_in_intervals(spark.createDataFrame(points, "session_id int, t_sec double"), df, 60.0)
    assert got.columns == ["session_id", "t_sec", "inside"]
    want = [(s, t, t is not None and any(s == x[0] and x[2] <= t < x[3] for x in ranges)) for s, t in points]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "session_id int, start_sec double, end_sec double, reason string")
    points = spark.createDataFrame([(1, 2.0)], "session_id int, t_sec double")
    assert [r.inside for r in intervals.points_in_intervals(points, none, 60.0).collect()] == [False]
    windows = spark.createDataFrame([(1, 0, 0.0, 9.0)], "session_id int, k int, start_sec double, end_sec double")
    assert [r.covered for r in intervals.overlap_duration(windows, ["session_id", "k"], none, 60.0).collect()] == [0.0]
