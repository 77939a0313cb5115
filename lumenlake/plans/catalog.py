"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlake.operators import features, intervals, metrics, policy, records, references, retrieval, windowing
from lumenlake.plans import views as v

QUERIES: dict = {}
ORACLE_SQL: dict = {}
WINDOW, STRIDE, TAIL = 5 * v.DAY, 2.5 * v.DAY, v.DAY


def query(name: str, sql: str | None = None, *names: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = v.with_views(sql, *names) if names else sql
        return f

    return add


def r6(*columns: str) -> dict:
    return {c: F.round(F.col(c).cast("double"), 6) for c in columns}


WINDOWS_SQL = f"""windows AS (SELECT session_id, i::BIGINT AS window_index, i * {STRIDE}::DOUBLE AS start_sec, least(i * {STRIDE}::DOUBLE + {WINDOW}, duration) AS end_sec
  FROM sessions, range(0, 200) r(i) WHERE i * {STRIDE}::DOUBLE < duration AND duration - i * {STRIDE}::DOUBLE >= {TAIL} - 1e-8)"""
ATOMIC_SQL = "atomic AS (SELECT *, printf('E%04d', dense_rank() OVER (PARTITION BY session_id ORDER BY round(start_sec, 6), round(end_sec, 6)) - 1) AS atomic_id FROM windows)"
WIDTH_SQL = f"greatest(ceil(ceil(max(end_sec) OVER (PARTITION BY session_id) / {v.DAY}) / 8), 1) * {v.DAY}"
SEGMENT_SQL = f"""bucketed AS (SELECT *, floor((start_sec + end_sec) / 2 / ({WIDTH_SQL})) AS bucket FROM atomic),
  segmented AS (SELECT *, printf('S%03d', dense_rank() OVER (PARTITION BY session_id ORDER BY bucket) - 1) AS segment_id FROM bucketed)"""


def windows(spark, d):
    return windowing.make_windows(v.sessions(spark, d), WINDOW, STRIDE, TAIL)


def segmented(spark, d):
    return windowing.segments(windowing.atomic_ids(windows(spark, d)), v.DAY, 8)


@query("w1_make_windows", f"WITH {WINDOWS_SQL} SELECT session_id, window_index, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM windows", "signals", "sessions")
def w1(spark, d):
    return windows(spark, d).withColumns(r6("start_sec", "end_sec"))


IN_WINDOW_SQL = "inside AS (SELECT s.*, w.window_index, w.start_sec, w.end_sec FROM signals s JOIN windows w ON s.session_id = w.session_id AND t_sec >= w.start_sec AND t_sec < w.end_sec)"


def in_window(spark, d):
    return windowing.assign_windows(v.signals(spark, d), windows(spark, d), WINDOW, STRIDE)


@query("w2_window_stats", f"""WITH {WINDOWS_SQL}, {IN_WINDOW_SQL} SELECT session_id, source_id, window_index, count(*) AS n, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM inside GROUP BY 1, 2, 3""", "signals", "sessions")
def w2(spark, d):
    """W2 with A1: samples to windows, then median and interquartile range."""
    return in_window(spark, d).groupBy("session_id", "source_id", "window_index").agg(
        F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    ).select("session_id", "source_id", "window_index", "n", F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"))


@query("w4_sampling_rate", """WITH s AS (SELECT session_id, source_id, t_sec, t_sec - lag(t_sec) OVER (PARTITION BY session_id, source_id ORDER BY t_sec) AS step FROM signals)
  SELECT session_id, source_id, round(CASE WHEN count(*) < 3 THEN 1 ELSE coalesce(1 / median(step) FILTER (WHERE step > 1e-6), 1) END, 12) AS rate FROM s GROUP BY 1, 2""", "signals")
def w4(spark, d):
    return windowing.sampling_rate(v.signals(spark, d), ["session_id", "source_id"], 1.0).withColumn("rate", F.round("rate", 12))


@query("w6_atomic_ids", f"WITH {WINDOWS_SQL}, {ATOMIC_SQL} SELECT session_id, atomic_id, window_index FROM atomic", "signals", "sessions")
def w6(spark, d):
    return windowing.atomic_ids(windows(spark, d)).select("session_id", "atomic_id", "window_index")


@query("w7_segments", f"WITH {WINDOWS_SQL}, {ATOMIC_SQL}, {SEGMENT_SQL} SELECT session_id, atomic_id, segment_id FROM segmented", "signals", "sessions")
def w7(spark, d):
    return segmented(spark, d).select("session_id", "atomic_id", "segment_id")


RANGES_SQL = """own AS (SELECT session_id, segment_id, min((start_sec + end_sec) / 2) AS lo, max((start_sec + end_sec) / 2) AS hi, min(start_sec) AS a, max(end_sec) AS b FROM segmented GROUP BY 1, 2),
  ranges AS (SELECT session_id, segment_id, coalesce((lag(hi) OVER w + lo) / 2, a) AS r_start, coalesce((lead(lo) OVER w + hi) / 2, b) AS r_end FROM own WINDOW w AS (PARTITION BY session_id ORDER BY lo, segment_id))"""


@query("w8_segment_ranges", f"WITH {WINDOWS_SQL}, {ATOMIC_SQL}, {SEGMENT_SQL}, {RANGES_SQL} SELECT session_id, segment_id, round(r_start, 6) AS start_sec, round(r_end, 6) AS end_sec FROM ranges", "signals", "sessions")
def w8(spark, d):
    return windowing.segment_ranges(segmented(spark, d)).withColumns(r6("start_sec", "end_sec"))


@query("w9_format_time", """WITH m AS (SELECT session_id, row_id, round_even(t_sec * 1000, 0)::BIGINT AS ms FROM signals)
  SELECT row_id, CASE WHEN ms // 3600000 > 0 THEN printf('%02d:', ms // 3600000) ELSE '' END || printf('%02d:%02d.%03d', (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS label FROM m""", "signals")
def w9(spark, d):
    return v.signals(spark, d).select("row_id", windowing.format_time(F.col("t_sec")).alias("label"))


MERGED_SQL = """steps AS (SELECT *, CASE WHEN start_sec <= max(end_sec) OVER (PARTITION BY session_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM intervals),
  islands AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM steps),
  merged AS (SELECT session_id, min(start_sec) AS m_start, max(end_sec) AS m_end, string_agg(DISTINCT reason, '+' ORDER BY reason) AS reason FROM islands GROUP BY session_id, island)"""


@query("j1_merge_intervals", f"WITH {MERGED_SQL} SELECT session_id, round(m_start, 6) AS start_sec, round(m_end, 6) AS end_sec, reason FROM merged", "signals", "intervals")
def j1(spark, d):
    return intervals.merge_intervals(v.intervals(spark, d)).withColumns(r6("start_sec", "end_sec"))


@query("j2_overlap_duration", f"""WITH {WINDOWS_SQL}, {MERGED_SQL} SELECT w.session_id, window_index, round(least(coalesce(sum(least(end_sec, m_end) - greatest(start_sec, m_start)) FILTER (WHERE m_end IS NOT NULL), 0), any_value(end_sec - start_sec)), 4) AS covered
  FROM windows w LEFT JOIN merged m ON w.session_id = m.session_id AND start_sec < m_end AND m_start < end_sec GROUP BY 1, 2""", "signals", "sessions", "intervals")
def j2(spark, d):
    w = windows(spark, d)
    out = intervals.overlap_duration(w, ["session_id", "window_index"], v.intervals(spark, d), WINDOW)
    return out.select("session_id", "window_index", F.round("covered", 4).alias("covered"))


@query("j3_points_in_intervals", """SELECT s.session_id, s.row_id, EXISTS (SELECT 1 FROM intervals i WHERE i.session_id = s.session_id AND s.t_sec >= i.start_sec AND s.t_sec < i.end_sec) AS inside FROM signals s""", "signals", "intervals")
def j3(spark, d):
    return intervals.points_in_intervals(v.signals(spark, d).select("session_id", "row_id", "t_sec"), v.intervals(spark, d), v.DAY).select("session_id", "row_id", "inside")


@query("j4_overlap_reasons", f"""WITH {WINDOWS_SQL} SELECT w.session_id, window_index, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons
  FROM windows w LEFT JOIN intervals i ON w.session_id = i.session_id AND w.start_sec < i.end_sec AND i.start_sec < w.end_sec GROUP BY 1, 2""", "signals", "sessions", "intervals")
def j4(spark, d):
    return intervals.overlap_reasons(windows(spark, d), ["session_id", "window_index"], v.intervals(spark, d), WINDOW).select("session_id", "window_index", "reasons")


SPANS_SQL = "spans AS (SELECT session_id, printf('S%03d', utterance_id // 2) AS segment_id, min(start_sec) + 3 AS r_start, max(end_sec) + 4 AS r_end FROM utterances GROUP BY session_id, utterance_id // 2)"


def spans(spark, d):
    u = v.utterances(spark, d).groupBy("session_id", F.expr("utterance_id div 2").alias("n"))
    return u.agg((F.min("start_sec") + 3).alias("r_start"), (F.max("end_sec") + 4).alias("r_end")).select("session_id", F.format_string("S%03d", "n").alias("segment_id"), "r_start", "r_end")


@query("j5_align_midpoint", f"""WITH {SPANS_SQL} SELECT u.session_id, utterance_id, min(segment_id) AS segment_id FROM utterances u JOIN spans s
  ON u.session_id = s.session_id AND (start_sec + end_sec) / 2 >= r_start AND (start_sec + end_sec) / 2 < r_end GROUP BY 1, 2""", "utterances")
def j5(spark, d):
    return intervals.align_by_midpoint(v.utterances(spark, d), spans(spark, d), 60.0)


@query("j6_align_overlap", f"""WITH {SPANS_SQL}, o AS (SELECT u.session_id, utterance_id, segment_id, least(end_sec, r_end) - greatest(start_sec, r_start) AS overlap FROM utterances u JOIN spans s
  ON u.session_id = s.session_id AND start_sec < r_end AND r_start < end_sec)
  SELECT session_id, utterance_id, segment_id, overlap FROM o QUALIFY row_number() OVER (PARTITION BY session_id, utterance_id ORDER BY overlap DESC, segment_id) = 1""", "utterances")
def j6(spark, d):
    return intervals.align_by_overlap(v.utterances(spark, d).drop("text"), spans(spark, d), 60.0)


@query("p8_availability", f"""WITH {WINDOWS_SQL}, {IN_WINDOW_SQL}, r AS (SELECT session_id, source_id, window_index, count(*) FILTER (WHERE k >= 20)::DOUBLE / count(*) AS ratio FROM inside GROUP BY 1, 2, 3)
  SELECT session_id, source_id, window_index, round(ratio, 6) AS ratio, CASE WHEN ratio <= 0 THEN 'unavailable' WHEN ratio < 0.3 THEN 'low_quality' WHEN ratio < 0.8 THEN 'partial' ELSE 'good' END AS level,
  CASE WHEN ratio <= 0 THEN 'unavailable' WHEN ratio < 0.8 THEN 'partial' ELSE 'present' END AS status, CASE WHEN ratio <= 0 THEN 'no_valid_measurements' ELSE '' END AS reasons FROM r""", "signals", "sessions")
def p8(spark, d):
    """Valid rows, the quality level and the availability of each window and source."""
    rows = in_window(spark, d).groupBy("session_id", "source_id", "window_index").agg((F.count_if(F.col("k") >= 20) / F.count("*")).alias("ratio"))
    a = features.availability(F.col("ratio"), F.array(F.lit(None).cast("string")))
    return rows.select("session_id", "source_id", "window_index", F.round("ratio", 6).alias("ratio"), features.quality_level(F.col("ratio"), F.col("ratio") <= 0).alias("level"), a["status"].alias("status"), F.array_join(a["reasons"], ",").alias("reasons"))


@query("a8_valid_speed", """WITH s AS (SELECT session_id, source_id, value - lag(value) OVER w AS dv, t_sec - lag(t_sec) OVER w AS dt FROM signals WHERE k >= 20 WINDOW w AS (PARTITION BY session_id, source_id ORDER BY t_sec, row_id))
  SELECT session_id, source_id, round(median(abs(dv) / dt), 9) AS speed FROM s WHERE dt > 1e-6 GROUP BY 1, 2""", "signals")
def a8(spark, d):
    return features.valid_speed(v.signals(spark, d).withColumn("valid", F.col("k") >= 20), ["session_id", "source_id"]).withColumn("speed", F.round("speed", 9))


def frames(spark, d):
    e = v.table(spark, d, "embeddings")
    return e.select(F.col("label").alias("session_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("row_idx"), F.col("embedding").alias("features"))


FRAMES_SQL = "frames AS (SELECT label AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_idx, embedding AS features FROM embeddings)"


@query("a2_consecutive_change", f"""WITH {FRAMES_SQL}, s AS (SELECT session_id, features, lag(features) OVER (PARTITION BY session_id ORDER BY row_idx) AS last FROM frames),
  t AS (SELECT session_id, sqrt(list_sum(list_transform(range(1, len(features) + 1), lambda i: pow(features[i]::DOUBLE - last[i]::DOUBLE, 2))) / len(features)) AS step FROM s WHERE last IS NOT NULL)
  SELECT session_id, round(median(step), 6) AS change, count(*) AS pairs FROM t GROUP BY 1""")
def a2(spark, d):
    return features.consecutive_change(frames(spark, d), ["session_id"]).withColumn("change", F.round("change", 6))


@query("a21_dispersion", f"""WITH {FRAMES_SQL}, p AS (SELECT session_id, i - 1 AS i, features[i]::DOUBLE AS x FROM frames, range(1, 65) r(i)), s AS (SELECT session_id, i // 2 AS point, i % 2 AS axis, var_pop(x) AS v FROM p GROUP BY 1, 2, 3),
  t AS (SELECT session_id, point, sqrt(sum(v)) AS d FROM s GROUP BY 1, 2) SELECT session_id, round(median(d), 6) AS dispersion FROM t GROUP BY 1""")
def a21(spark, d):
    return features.dispersion(frames(spark, d), ["session_id"]).withColumn("dispersion", F.round("dispersion", 6))


@query("f1_session_stats", """SELECT session_id, source_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS q10,
  round(quantile_cont(value, 0.9), 6) AS q90, min(value) AS lowest, max(value) AS highest, round(CASE WHEN count(*) >= 2 AND max(t_sec) > min(t_sec) THEN regr_slope(value, t_sec) ELSE 0 END, 9) AS slope FROM signals GROUP BY 1, 2""", "signals")
def f1(spark, d):
    return features.session_stats(v.signals(spark, d), ["session_id", "source_id"]).withColumns({**r6("mean", "std", "median", "q10", "q90"), "slope": F.round("slope", 9)})


FIT_SQL = """basic AS (SELECT source_id, count(*) AS n, median(value) AS med, stddev_pop(value) AS std, quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS knots FROM signals WHERE session_id % 2 = 0 GROUP BY 1),
  spread AS (SELECT source_id, median(abs(value - med)) AS mad FROM signals JOIN basic USING (source_id) WHERE session_id % 2 = 0 GROUP BY 1),
  ref AS (SELECT *, CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN (knots[5] - knots[3]) / 1.349 > 1e-12 THEN (knots[5] - knots[3]) / 1.349 WHEN std > 1e-12 THEN std ELSE 0 END AS scale FROM basic JOIN spread USING (source_id))"""


def reference(spark, d):
    return references.fit(v.signals(spark, d).filter("session_id % 2 = 0"), ["source_id"])


@query("r1_reference_fit", f"WITH {FIT_SQL} SELECT source_id, n, round(med, 6) AS median, round(mad, 6) AS mad, round(scale, 6) AS scale, round(knots[1], 6) AS p01, round(knots[7], 6) AS p99 FROM ref", "signals")
def r1(spark, d):
    """References of the training sessions."""
    return reference(spark, d).select("source_id", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "scale")], F.round(F.col("knots")[0], 6).alias("p01"), F.round(F.col("knots")[6], 6).alias("p99"))


_P = [1, 5, 25, 50, 75, 95, 99]
_PCT = "CASE WHEN value <= knots[1] THEN 1 WHEN value >= knots[7] THEN 99 " + " ".join(f"WHEN value < knots[{i + 2}] THEN {_P[i]} + {_P[i + 1] - _P[i]} * (value - knots[{i + 1}]) / (knots[{i + 2}] - knots[{i + 1}])" for i in range(6)) + " END"
JUDGED_SQL = f"{FIT_SQL}, judged AS (SELECT s.*, ({_PCT})::DOUBLE AS percentile, CASE WHEN scale > 0 THEN (value - med) / scale ELSE 0 END AS robust_z FROM signals s JOIN ref USING (source_id))"


@query("r4_enrich", f"""WITH {JUDGED_SQL} SELECT row_id, round(percentile, 6) AS percentile, round(robust_z, 6) AS robust_z,
  CASE WHEN percentile < 5 THEN 'very_low' WHEN percentile < 25 THEN 'low' WHEN percentile <= 75 THEN 'typical' WHEN percentile < 95 THEN 'high' ELSE 'very_high' END AS category FROM judged""", "signals")
def r4(spark, d):
    """Percentile, robust z and category of every value."""
    return references.enrich(v.signals(spark, d), reference(spark, d), ["source_id"]).select("row_id", F.round("percentile", 6).alias("percentile"), F.round("robust_z", 6).alias("robust_z"), "category")


@query("r6_subject_z", """WITH b AS (SELECT session_id, source_id, count(*) AS n, median(value) AS med, stddev_pop(value) AS std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM signals GROUP BY 1, 2),
  m AS (SELECT session_id, source_id, median(abs(value - med)) AS mad FROM signals JOIN b USING (session_id, source_id) GROUP BY 1, 2),
  s AS (SELECT *, CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN iqr / 1.349 > 1e-12 THEN iqr / 1.349 WHEN std > 1e-12 THEN std ELSE 0 END AS scale FROM b JOIN m USING (session_id, source_id))
  SELECT row_id, round(CASE WHEN n >= 3 AND scale > 0 THEN (value - med) / scale END, 6) AS subject_z FROM signals JOIN s USING (session_id, source_id)""", "signals")
def r6_subject(spark, d):
    return references.subject_z(v.signals(spark, d), ["session_id", "source_id"]).select("row_id", F.round("subject_z", 6).alias("subject_z"))


SLOTS_SQL = f"""{WINDOWS_SQL}, {ATOMIC_SQL}, {SEGMENT_SQL}, {JUDGED_SQL}, slots AS (SELECT g.session_id, g.segment_id, g.atomic_id, substr(g.atomic_id, 2)::INT AS atomic_no, g.start_sec, g.end_sec, j.source_id AS slot_id, any_value(j.modality) AS modality,
  median(j.percentile) AS percentile, avg(CASE WHEN j.k >= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS reliability FROM segmented g JOIN judged j ON g.session_id = j.session_id AND j.t_sec >= g.start_sec AND j.t_sec < g.end_sec GROUP BY ALL)"""


def slots(spark, d):
    """Q1: per atomic window and slot, the median percentile and the share of valid rows."""
    seg = segmented(spark, d)
    judged = references.enrich(v.signals(spark, d), reference(spark, d), ["source_id"])
    rows = windowing.assign_windows(judged, seg, WINDOW, STRIDE)
    return rows.groupBy("session_id", "segment_id", "atomic_id", F.substring("atomic_id", 2, 9).cast("int").alias("atomic_no"), "start_sec", "end_sec", F.col("source_id").alias("slot_id"), "modality").agg(
        F.median("percentile").alias("percentile"), F.avg(F.when(F.col("k") >= 20, 1.0).otherwise(0.0)).alias("reliability")
    )


@query("g4_slot_rollup", f"""WITH {SLOTS_SQL} SELECT session_id, segment_id, slot_id, count(*) AS measured, round(median(percentile), 6) AS median_percentile,
  round(abs(median(percentile) - 50) * avg(reliability), 6) AS salience FROM slots GROUP BY 1, 2, 3""", "signals", "sessions")
def g4(spark, d):
    """A segment's slots with their salience."""
    return slots(spark, d).groupBy("session_id", "segment_id", "slot_id").agg(
        F.count("*").alias("measured"), F.round(F.median("percentile"), 6).alias("median_percentile"), F.round(F.abs(F.median("percentile") - 50) * F.avg("reliability"), 6).alias("salience")
    )


@query("g6_slot_topk", f"""WITH {SLOTS_SQL}, g AS (SELECT session_id, segment_id, slot_id, count(*) AS measured, round(abs(median(percentile) - 50) * avg(reliability), 6) AS salience FROM slots GROUP BY 1, 2, 3)
  SELECT session_id, segment_id, slot_id, cast(row_number() OVER (PARTITION BY session_id, segment_id ORDER BY (slot_id = 'signup' AND salience >= 10) DESC, salience DESC, measured DESC, slot_id DESC) AS INTEGER) AS rank
  FROM g QUALIFY rank <= 2""", "signals", "sessions")
def g6(spark, d):
    w = Window.partitionBy("session_id", "segment_id").orderBy(F.desc(F.expr("slot_id = 'signup' and salience >= 10")), F.desc("salience"), F.desc("measured"), F.desc("slot_id"))
    return g4(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("session_id", "segment_id", "slot_id", "rank")


@query("g9_candidate_cues", f"""WITH {SLOTS_SQL} SELECT session_id, atomic_id, bool_or(abs(percentile - 50) >= 25) AS unusual, bool_or(reliability < 0.8) AS boundary, string_agg(DISTINCT slot_id, ',' ORDER BY slot_id) AS labels FROM slots GROUP BY 1, 2""", "signals", "sessions")
def g9(spark, d):
    return slots(spark, d).groupBy("session_id", "atomic_id").agg(
        F.bool_or(F.abs(F.col("percentile") - 50) >= 25).alias("unusual"), F.bool_or(F.col("reliability") < 0.8).alias("boundary"), F.array_join(F.array_sort(F.collect_set("slot_id")), ",").alias("labels")
    )


SCORED_SQL = f"""{SLOTS_SQL}, stepped AS (SELECT *, CASE WHEN atomic_no - lag(atomic_no) OVER w = 1 THEN (percentile - lag(percentile) OVER w) / 100 END AS delta, median(percentile) OVER (PARTITION BY session_id, segment_id, slot_id) AS seg
    FROM slots WINDOW w AS (PARTITION BY session_id, segment_id, slot_id ORDER BY start_sec, atomic_no)),
  scored AS (SELECT session_id, segment_id, atomic_id, any_value(atomic_no) AS atomic_no, any_value((start_sec + end_sec) / 2) AS mid, any_value(end_sec - start_sec) AS duration, max(abs(percentile - 50)) / 50 AS extreme, least(1, coalesce(max(abs(delta)), 0)) AS change,
    least(1, coalesce(max(abs(delta)) FILTER (WHERE modality = 'audio'), 0), coalesce(max(abs(delta)) FILTER (WHERE modality = 'visual'), 0)) AS cross_modal,
    greatest(0, 1 - avg(abs(percentile - seg) / 50)) AS representative, count(*)::DOUBLE / 5 AS coverage, avg(reliability) AS reliability FROM stepped GROUP BY 1, 2, 3)"""


def scored(spark, d):
    """Q2 to Q8: the pattern scores of every atomic window."""
    rows = retrieval.deltas(slots(spark, d)).withColumn("seg", F.median("percentile").over(Window.partitionBy("session_id", "segment_id", "slot_id")))
    p, dl = F.col("percentile"), F.col("delta")
    out = rows.groupBy("session_id", "segment_id", "atomic_id", "atomic_no").agg(
        F.first((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid"), F.first(F.col("end_sec") - F.col("start_sec")).alias("duration"), retrieval.extreme(p).alias("extreme"), retrieval.change(dl).alias("change"),
        retrieval.cross_modal(dl, F.col("modality")).alias("cross_modal"), retrieval.representative(p, F.col("seg")).alias("representative"), (F.count("*") / 5.0).alias("coverage"), F.avg("reliability").alias("reliability"),
    )
    return out.withColumn("score", retrieval.final_score(F.col("extreme"), F.col("coverage"), F.col("reliability")))


@query("q8_query_scores", f"""WITH {SCORED_SQL} SELECT session_id, atomic_id, round(extreme, 6) AS extreme, round(change, 6) AS change, round(cross_modal, 6) AS cross_modal, round(representative, 6) AS representative,
  round(0.70::DOUBLE * extreme + 0.20::DOUBLE * coverage + 0.10::DOUBLE * reliability, 6) AS score FROM scored""", "signals", "sessions")
def q8(spark, d):
    return scored(spark, d).select("session_id", "atomic_id", *[F.round(c, 6).alias(c) for c in ("extreme", "change", "cross_modal", "representative", "score")])


@query("q13_retrieval_map", f"""WITH {SCORED_SQL} SELECT session_id, segment_id, count(*) FILTER (WHERE extreme >= 0.5) AS n_extreme, count(*) FILTER (WHERE change >= 0.3) AS n_change, count(*) FILTER (WHERE cross_modal >= 0.3) AS n_cross, count(*) AS n FROM scored GROUP BY 1, 2""", "signals", "sessions")
def q13(spark, d):
    return scored(spark, d).groupBy("session_id", "segment_id").agg(F.count_if(F.col("extreme") >= 0.5).alias("n_extreme"), F.count_if(F.col("change") >= 0.3).alias("n_change"), F.count_if(F.col("cross_modal") >= 0.3).alias("n_cross"), F.count("*").alias("n"))


@query("q10_diverse_pick")
def q10(spark, d):
    """Q9 to Q11: a diverse choice of three atomic windows in each segment."""
    rows = scored(spark, d).select("session_id", "segment_id", "atomic_id", "atomic_no", "mid", "duration", F.round("score", 9).alias("score"))
    return retrieval.diverse(rows, ["session_id", "segment_id"], 3).select("session_id", "segment_id", "pick", "atomic_id")


@query("t5_trigger", """WITH a AS (SELECT *, CASE WHEN risk <= 0 OR risk >= 1 THEN 0 ELSE -(risk * log2(risk) + (1 - risk) * log2(1 - risk)) END AS entropy,
    CASE WHEN audio_rel >= 0.6 AND visual_rel >= 0.6 AND audio_risk IS NOT NULL THEN abs(audio_risk - visual_risk) ELSE 0 END AS disagreement, list_intersect(supporting, contradictory) AS shared FROM assessments)
  SELECT session_id, round(entropy, 6) AS entropy, round(disagreement, 6) AS disagreement, concat_ws(',', CASE WHEN entropy >= 0.85 THEN 'high_entropy' END, CASE WHEN confidence <= 0.6 THEN 'low_confidence' END, CASE WHEN disagreement >= 0.3 THEN 'disagreement' END,
    CASE WHEN (coalesce(audio_rel, visual_rel) + visual_rel) / 2 <= 0.6 THEN 'low_mean_reliability' END, CASE WHEN least(coalesce(audio_rel, visual_rel), visual_rel) <= 0.4 THEN 'low_reliability' END, CASE WHEN len(shared) > 0 THEN 'overlap' END) AS reasons FROM a""", "assessments")
def t5(spark, d):
    """Entropy, reliable disagreement, evidence overlap and the reasons."""
    a = v.assessments(spark, d)
    risk, rel = F.array("audio_risk", "visual_risk"), F.array("audio_rel", "visual_rel")
    a = a.withColumns({"entropy": policy.entropy(F.col("risk")), "disagreement": policy.reliable_disagreement(risk, rel)})
    low = F.coalesce("audio_rel", "visual_rel")
    signals = {
        "high_entropy": F.col("entropy") >= 0.85, "low_confidence": F.col("confidence") <= 0.6, "disagreement": F.col("disagreement") >= 0.3, "low_mean_reliability": (low + F.col("visual_rel")) / 2 <= 0.6,
        "low_reliability": F.least(low, F.col("visual_rel")) <= 0.4, "overlap": F.arrays_overlap("supporting", "contradictory"),
    }
    return a.select("session_id", F.round("entropy", 6).alias("entropy"), F.round("disagreement", 6).alias("disagreement"), F.array_join(policy.trigger_reasons(signals), ",").alias("reasons"))


@query("t3_disagreement", """SELECT session_id, round(coalesce(audio_rel * visual_rel * abs(audio_risk - visual_risk), 0), 6) AS reliable,
  round(coalesce(CASE WHEN audio_risk IS NULL THEN 0 WHEN greatest(audio_rel, visual_rel) > 0.6 THEN (1 - least(audio_rel, visual_rel)) * abs(audio_risk - visual_risk) ELSE 0 END, 0), 6) AS unreliable FROM assessments""", "assessments")
def t3(spark, d):
    one = F.lit(1.0)
    good, bad = policy.pair_disagreement(F.abs(F.col("audio_risk") - F.col("visual_risk")), F.col("audio_rel"), F.col("visual_rel"), one, one, 0.6)
    return v.assessments(spark, d).select("session_id", F.round(good, 6).alias("reliable"), F.round(bad, 6).alias("unreliable"))


@query("t7_segment_pick")
def t7(spark, d):
    available = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.format_string("S%03d", i))
    return v.assessments(spark, d).select("session_id", F.array_join(policy.pick_segments([F.col("contradictory"), F.col("supporting")], available), ",").alias("segments"))


@query("t14_risk_threshold", """SELECT risk AS threshold FROM assessments QUALIFY row_number() OVER (ORDER BY risk DESC) = round_even((SELECT count(*) FROM assessments) * 0.25, 0)""", "assessments")
def t14(spark, d):
    return policy.risk_threshold(v.assessments(spark, d).select("risk"), 0.25)


@query("t12_logistic")
def t12(spark, d):
    """An audit model on standardised features; one row for each weight."""
    a = v.assessments(spark, d).join(v.table(spark, d, "labels"), F.col("session_id") == F.col("doc_id")).filter("quality is not null")
    names = ["confidence", "visual_rel", "risk"]
    stats = a.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    x = a.select(*[((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] if (stats[f"s_{c}"] or 0) > 1e-12 else 1.0)).alias(c) for c in names], "quality")
    w, b = policy.fit_logistic(x, names, "quality", 1.0)
    return spark.createDataFrame([*[(n, float(c)) for n, c in zip(names, w, strict=True)], ("intercept", b)], "feature string, weight double")


@query("m1_confusion", """WITH c AS (SELECT seed, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM preds GROUP BY 1)
  SELECT seed, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM c""", "preds")
def m1(spark, d):
    return metrics.confusion(v.predictions(spark, d), ["seed"], 0.5).withColumns(r6("precision", "recall", "f1", "balanced_accuracy"))


@query("m2_brier_logloss", """SELECT seed, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(p, 1e-7), 1 - 1e-7) ELSE 1 - least(greatest(p, 1e-7), 1 - 1e-7) END)), 6) AS log_loss FROM preds GROUP BY 1""", "preds")
def m2(spark, d):
    p, y = F.col("p"), F.col("y")
    return v.predictions(spark, d).groupBy("seed").agg(F.round(metrics.brier(p, y), 6).alias("brier"), F.round(metrics.log_loss(p, y, 1e-7), 6).alias("log_loss"))


@query("m4_auc", """WITH r AS (SELECT seed, y, rank() OVER (PARTITION BY seed ORDER BY p) + (count(*) OVER (PARTITION BY seed, p) - 1) / 2 AS r FROM preds)
  SELECT seed, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1""", "preds")
def m4(spark, d):
    """The tie-aware area under the curve."""
    return metrics.auc(v.predictions(spark, d), ["seed"]).withColumn("auc", F.round("auc", 6))


@query("m6_average_precision", """WITH g AS (SELECT seed, p, sum(y) AS pos, count(*) AS n FROM preds GROUP BY 1, 2), c AS (SELECT seed, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY seed ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
  SELECT seed, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c GROUP BY 1""", "preds")
def m6(spark, d):
    return metrics.average_precision(v.predictions(spark, d), ["seed"]).withColumn("average_precision", F.round("average_precision", 6))


@query("m7_average_precision_ranked", """WITH c AS (SELECT seed, y, row_number() OVER w AS rank, sum(y) OVER w AS tp FROM preds WINDOW w AS (PARTITION BY seed ORDER BY p DESC, session_id ROWS UNBOUNDED PRECEDING))
  SELECT seed, round(sum(y * tp / rank) / sum(y), 6) AS average_precision FROM c GROUP BY 1""", "preds")
def m7(spark, d):
    return metrics.average_precision_ranked(v.predictions(spark, d), ["seed"], "session_id").withColumn("average_precision", F.round("average_precision", 6))


@query("m8_best_threshold", """WITH s AS (SELECT DISTINCT seed, p FROM preds), t AS (SELECT seed, p AS t FROM s UNION SELECT seed, (p + lag(p) OVER (PARTITION BY seed ORDER BY p)) / 2 FROM s UNION SELECT DISTINCT seed, 0.5::DOUBLE FROM s),
  b AS (SELECT t.seed, t.t, round((count(*) FILTER (WHERE y = 1 AND p >= t.t) / count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE y = 0 AND p < t.t) / count(*) FILTER (WHERE y = 0)) / 2, 12) AS ba FROM t JOIN preds x ON t.seed = x.seed WHERE t.t IS NOT NULL GROUP BY 1, 2)
  SELECT seed, round(t, 6) AS threshold, round(ba, 6) AS balanced_accuracy FROM b QUALIFY row_number() OVER (PARTITION BY seed ORDER BY ba DESC, round(abs(t - 0.5), 12), t DESC) = 1""", "preds")
def m8(spark, d):
    return metrics.best_threshold(v.predictions(spark, d), ["seed"]).withColumns(r6("threshold", "balanced_accuracy"))


@query("m9_ensemble", "SELECT session_id, round(avg(p), 6) AS p, round(coalesce(stddev_samp(p), 0), 6) AS std, any_value(y) AS y FROM preds GROUP BY 1", "preds")
def m9(spark, d):
    """The mean over seeds of sessions whose label all seeds agree on."""
    return v.predictions(spark, d).groupBy("session_id").agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.coalesce(F.stddev_samp("p"), F.lit(0.0)), 6).alias("std"), F.first("y").alias("y"), F.countDistinct("y").alias("n")).filter("n <= 1").drop("n")


@query("m11_transitions", """WITH x AS (SELECT a.session_id, a.y, (a.p >= 0.5)::INT AS b, (c.p >= 0.5)::INT AS e, abs(c.p - 0.5) < 0.1 AS r FROM preds a JOIN preds c ON a.session_id = c.session_id AND a.seed = 42 AND c.seed = 43)
  SELECT CASE WHEN b = y THEN 'correct' ELSE 'wrong' END || CASE WHEN r THEN '_referred' WHEN e = y THEN '_to_correct' ELSE '_to_wrong' END AS transition, count(*) AS n FROM x GROUP BY 1""", "preds")
def m11(spark, d):
    p = v.predictions(spark, d)
    a, c = p.filter("seed = 42").select("session_id", "y", (F.col("p") >= 0.5).cast("int").alias("b")), p.filter("seed = 43").select("session_id", F.col("p").alias("q"))
    t = metrics.transition(F.col("y"), F.col("b"), (F.col("q") >= 0.5).cast("int"), F.abs(F.col("q") - 0.5) < 0.1)
    return a.join(c, "session_id").groupBy(t.alias("transition")).agg(F.count("*").alias("n"))


@query("m16_best_arm", """WITH u AS (SELECT session_id, seed, round(CASE WHEN y = 1 THEN ln(greatest(p, 1e-7)) ELSE ln(greatest(1 - p, 1e-7)) END - (p - y) * (p - y), 9) AS utility FROM preds)
  SELECT session_id, seed AS arm, round(utility, 6) AS utility FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY utility DESC, seed) = 1""", "preds")
def m16(spark, d):
    """Each session's arm of largest utility."""
    p, y = F.col("p"), F.col("y")
    u = F.round(F.when(y == 1, F.ln(F.greatest(p, F.lit(1e-7)))).otherwise(F.ln(F.greatest(1 - p, F.lit(1e-7)))) - (p - y) * (p - y), 9)
    rows = v.predictions(spark, d).withColumn("utility", u)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("utility"), "seed"))
    return rows.withColumn("n", n).filter("n = 1").select("session_id", F.col("seed").alias("arm"), F.round("utility", 6).alias("utility"))


@query("m17_selective", """WITH x AS (SELECT seed, session_id, y, p, round(abs(p - 0.5), 6) AS confidence FROM preds), c AS (SELECT seed, row_number() OVER w AS n, sum((y = 1 AND p < 0.5)::INT) OVER w / nullif(sum((y = 1)::INT) OVER w, 0) AS fnr, count(*) OVER (PARTITION BY seed) AS total
  FROM x WINDOW w AS (PARTITION BY seed ORDER BY confidence DESC, session_id ROWS UNBOUNDED PRECEDING)) SELECT seed, round(coalesce(max(CASE WHEN fnr <= 0.45 + 1e-12 THEN n END) / max(total), 0), 6) AS coverage FROM c GROUP BY 1""", "preds")
def m17(spark, d):
    rows = v.predictions(spark, d).withColumn("confidence", F.round(F.abs(F.col("p") - 0.5), 6))
    return metrics.selective(rows, ["seed"], "session_id", 0.45).withColumn("coverage", F.round("coverage", 6))


@query("d9r_hash_sample", "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('42:' || doc_id), 9, 8))::BIGINT / 4294967295 < 0.10")
def d9r(spark, d):
    return v.table(spark, d, "documents").filter(records.hash_share(42, F.col("doc_id")) < 0.10).select("doc_id")


@query("d11r_weights", """WITH c AS (SELECT source, count(*) AS m FROM documents GROUP BY 1) SELECT doc_id, round(least(10, (SELECT sum(m) FROM c) / ((SELECT count(*) FROM c) * m)), 6) AS weight FROM documents JOIN c USING (source)""")
def d11r(spark, d):
    return records.inverse_frequency(v.table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", F.round("weight", 6).alias("weight"))


@query("d12r_round_robin", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, lang, turn FROM r ORDER BY turn, lang LIMIT 50""")
def d12r(spark, d):
    return records.round_robin(v.table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 50).withColumn("turn", F.col("turn").cast("long"))


@query("d13r_balanced_epoch", """WITH n AS (SELECT lang, count(*) AS m FROM documents GROUP BY 1), x AS (SELECT max(m) AS most FROM n)
  SELECT lang, most AS rows, m AS documents, (most // m)::BIGINT AS fewest, ((most + m - 1) // m)::BIGINT AS most_copies FROM n, x""")
def d13r(spark, d):
    """Every language gets as many rows as the largest, its documents as evenly as can be."""
    rows = records.balanced_epoch(v.table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"])
    each = rows.groupBy("lang", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"))
    return each.filter("last = n - 1").groupBy("lang").agg(F.sum("n").alias("rows"), F.count("*").alias("documents"), F.min("n").alias("fewest"), F.max("n").alias("most_copies"))


@query("j10_cohort_check", """WITH b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), a AS (SELECT doc_id, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1""")
def j10(spark, d):
    return records.cohort_differences(v.table(spark, d, "documents").filter("doc_id % 3 <> 0"), v.table(spark, d, "labels"), "doc_id")


@query("j15_overlapping_splits", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS splits FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def j15(spark, d):
    return records.overlapping_splits(v.table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("l1_chain")
def l1(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("order_key"), F.col("event_type").alias("payload"))
    return records.chain(e)


@query("l1_chain_violations", "SELECT user_id AS run_id, CASE WHEN user_id % 4 = 0 AND count(*) > 1 THEN 1 WHEN user_id % 4 = 1 AND count(*) > 2 THEN least(count(*) - 2, 2)::INTEGER ELSE 0 END AS violations FROM events GROUP BY 1")
def l1_violations(spark, d):
    """A ledger in which some payloads were changed, and some entries left out: what follows a gap has another sequence and predecessor."""
    ledger = l1(spark, d).filter("not (run_id % 4 = 1 and (sequence = 1 or sequence > 3))")
    ledger = ledger.withColumn("payload", F.expr("if(run_id % 4 = 0 and sequence = 1, 'changed', payload)"))
    bad = records.chain_violations(ledger).groupBy("run_id").agg(F.count("*").alias("n"))
    return ledger.select("run_id").distinct().join(bad, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).cast("int").alias("violations"))


@query("l4_budget", """WITH c AS (SELECT user_id AS run_id, event_id, floor(value)::BIGINT + 1 AS cost FROM events), u AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
  SELECT run_id, event_id, used::BIGINT AS used, greatest(0, 2400 - used)::BIGINT AS remaining, cost <= greatest(0, 2400 - used) AS fits FROM u""")
def l4(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", (F.floor("value") + 1).alias("cost"))
    return records.within_budget(e, "run_id", "event_id", "cost", 2400).select("run_id", "event_id", F.col("used").cast("long").alias("used"), F.col("remaining").cast("long").alias("remaining"), "fits")


from lumenlake.plans import composites, evidence, files, lineage, loops, models, more, signals  # noqa: E402, F401  (their queries use those above)
