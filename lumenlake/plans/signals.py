"""Queries over frames and assessments: acoustics, landmarks, validity, the learned audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlake.operators import acoustics, metrics, policy
from lumenlake.plans import views as v
from lumenlake.plans.catalog import query

FRAME_SQL = "f AS (SELECT vec_id % 20 AS session_id, vec_id // 20 AS row_idx, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def frames(spark, d):
    e = v.table(spark, d, "embeddings")
    return e.select(F.expr("vec_id % 20").alias("session_id"), F.expr("vec_id div 20").alias("row_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def rounded(columns: dict, n: int = 6) -> list:
    return [F.round(c, n).alias(name) for name, c in columns.items()]


_E = lambda i: F.col("e")[i]


@query("a3_action_units", f"""WITH {FRAME_SQL}, c AS (SELECT session_id, i, stddev_pop(e[i]) AS s, avg(e[i]) AS m FROM f, range(1, 18) r(i) GROUP BY 1, 2), p AS (SELECT session_id, avg((e[i] > 0)::INT) AS p FROM f, range(18, 21) r(i) GROUP BY 1)
  SELECT session_id, round(avg(m), 6) AS facial_action_activity, round(median(s), 6) AS facial_action_variability, round(any_value(p), 6) AS facial_action_presence_ratio, round(any_value(m) FILTER (WHERE i = 4), 6) AS au04_intensity FROM c JOIN p USING (session_id) GROUP BY 1""")
def a3(spark, d):
    """A3 and A4."""
    own = [_E(i) for i in range(17)]
    out = acoustics.action_units(own, [(_E(i) > 0).cast("double") for i in range(17, 20)])
    out["au04_intensity"] = acoustics.unit_intensity([f" AU{i + 1:02d}_R" for i in range(17)], own, "AU04_r")
    return frames(spark, d).groupBy("session_id").agg(*rounded(out))


_MED = lambda x, w="": f"median({x}) {w}"
_IQR = lambda x, w="": f"quantile_cont({x}, 0.75) {w} - quantile_cont({x}, 0.25) {w}"


def _levels(sql: dict) -> str:
    return ", ".join(f"round({x}, 6) AS {n}" for n, x in sql.items())


@query("a12_voice_descriptors", f"WITH {FRAME_SQL} SELECT session_id, " + _levels({
    "loudness_level": _MED("e[1]"), "loudness_variability": _IQR("e[1]"), "spectral_flux_level": _MED("e[2]"), "spectral_flux_variability": _IQR("e[2]"), "voiced_activity_ratio": "avg((e[3] > 0)::INT)",
    "pitch_level": _MED("e[3]", "FILTER (WHERE e[3] > 0)"), "pitch_variability": _IQR("e[3]", "FILTER (WHERE e[3] > 0)"), "jitter_level": _MED("e[4]", "FILTER (WHERE e[3] > 0)"), "shimmer_level": _MED("e[5]", "FILTER (WHERE e[3] > 0)"), "voice_harmonicity": _MED("e[6]", "FILTER (WHERE e[3] > 0)"),
}) + " FROM f GROUP BY 1")
def a12(spark, d):
    """A12, A13, A14, A16 and P4."""
    return frames(spark, d).groupBy("session_id").agg(*rounded(acoustics.voice_descriptors(_E(0), _E(1), _E(2), jitter_level=_E(3), shimmer_level=_E(4), voice_harmonicity=_E(5))))


_ON = "FILTER (WHERE e[8] >= 0.5 AND e[7] > 0)"
_GLOTTAL = ("naq_level", "qoq_level", "h1h2_level", "psp_level", "mdq_level", "peak_slope_level", "rd_level")


@query("a17_glottal_descriptors", f"WITH {FRAME_SQL} SELECT session_id, " + _levels({
    "voiced_activity_ratio": "avg((e[8] >= 0.5 AND e[7] > 0)::INT)", "pitch_level": _MED("12 * log2(e[7] / 27.5::DOUBLE)", _ON), "pitch_variability": _IQR("12 * log2(e[7] / 27.5::DOUBLE)", _ON),
    **{n: _MED(f"e[{i + 9}]", _ON) for i, n in enumerate(_GLOTTAL)}, "creak_activity": "avg(e[16])",
}).replace("12 * log2(e[7] / 27.5::DOUBLE)", "CASE WHEN e[7] > 0 THEN 12 * log2(e[7] / 27.5::DOUBLE) END") + " FROM f GROUP BY 1")
def a17(spark, d):
    """A17, A18 and P5."""
    return frames(spark, d).groupBy("session_id").agg(*rounded(acoustics.glottal_descriptors(_E(6), _E(7), _E(15), **{n: _E(i + 8) for i, n in enumerate(_GLOTTAL)})))


_CHANGE = lambda a, b: f"""WITH {FRAME_SQL}, s AS (SELECT session_id, e, row_idx, lag(e) OVER w AS last, lag(row_idx) OVER w AS li FROM f WINDOW w AS (PARTITION BY session_id ORDER BY row_idx)),
  t AS (SELECT session_id, sqrt(list_sum(list_transform(range({a}, {b}), lambda i: pow(e[i] - last[i], 2))) / {b - a}) AS step FROM s WHERE row_idx - li = 1) SELECT session_id, round(median(step), 6) AS change, count(*) AS pairs FROM t GROUP BY 1"""  # noqa: E731


@query("a19_cepstral_change", _CHANGE(20, 24))
def a19(spark, d):
    return acoustics.vector_change(frames(spark, d), ["session_id"], [_E(i) for i in range(19, 23)]).withColumn("change", F.round("change", 6))


@query("a20_landmark_change", _CHANGE(1, 65))
def a20(spark, d):
    return acoustics.vector_change(frames(spark, d), ["session_id"], [_E(i) for i in range(64)]).withColumn("change", F.round("change", 6))


@query("a21_landmarks", f"""WITH {FRAME_SQL}, p AS (SELECT session_id, i, sqrt(var_pop(e[i]) + var_pop(e[i + 32])) AS s FROM f, range(1, 33) r(i) GROUP BY 1, 2),
  o AS (SELECT session_id, median((sqrt((e[2] - e[8]) ** 2 + (e[34] - e[40]) ** 2) + sqrt((e[3] - e[7]) ** 2 + (e[35] - e[39]) ** 2) + sqrt((e[4] - e[6]) ** 2 + (e[36] - e[38]) ** 2)) / 3) AS o FROM f GROUP BY 1)
  SELECT session_id, round(median(s), 6) AS facial_shape_variability, round(median(s) FILTER (WHERE i BETWEEN 11 AND 20), 6) AS mouth_region_shape_variability, round(any_value(o), 6) AS mouth_opening FROM p JOIN o USING (session_id) GROUP BY 1""")
def a21(spark, d):
    """A21 and A22 on faces of 32 points: all, a region, and the gap of three pairs."""
    xs, ys = [_E(i) for i in range(32)], [_E(i + 32) for i in range(32)]
    return frames(spark, d).groupBy("session_id").agg(*rounded({
        "facial_shape_variability": acoustics.landmark_variability(xs, ys), "mouth_region_shape_variability": acoustics.landmark_variability(xs[10:20], ys[10:20]), "mouth_opening": acoustics.mouth_opening(xs, ys, ((1, 7), (2, 6), (3, 5))),
    }))


@query("a23_tracking_confidence", f"WITH {FRAME_SQL}, p AS (SELECT session_id, unnest([e[1], e[2], CASE WHEN e[3] > 0 THEN e[3] END]) AS c FROM f) SELECT session_id, round(median(c), 6) AS confidence FROM p GROUP BY 1")
def a23(spark, d):
    f = frames(spark, d).select("session_id", _E(0).alias("au"), _E(1).alias("gaze"), F.when(_E(2) > 0, _E(2)).otherwise(float("nan")).alias("pose"))
    return acoustics.tracking_confidence(f, ["session_id"], ["au", "gaze", "pose"]).withColumn("confidence", F.round("confidence", 6))


@query("a24_mean_ratio", f"WITH {FRAME_SQL} SELECT session_id, round((avg((e[1] > 0)::INT) + avg((e[2] > 0)::INT) + 0) / 3, 6) AS valid_ratio FROM f GROUP BY 1")
def a24(spark, d):
    share = lambda i: F.avg((_E(i) > 0).cast("double"))
    return frames(spark, d).groupBy("session_id").agg(F.round(acoustics.mean_ratio([share(0), share(1), F.lit(None).cast("double")]), 6).alias("valid_ratio"))


@query("p1_valid_frames", f"WITH {FRAME_SQL} SELECT session_id, row_idx, e[1] >= 0.8 AND e[2] >= 0.5 AND row_idx % 5 <> 0 AS valid FROM f")
def p1(spark, d):
    return frames(spark, d).select("session_id", "row_idx", acoustics.frame_is_valid(_E(0), _E(1), F.col("row_idx") % 5 == 0).alias("valid"))


@query("p3_zero_ratio", f"WITH {FRAME_SQL} SELECT session_id, round(avg((row_idx % 4 = 0)::INT), 6) AS zero_ratio FROM f GROUP BY 1")
def p3(spark, d):
    f = frames(spark, d).withColumn("e", F.when(F.col("row_idx") % 4 == 0, F.transform("e", lambda x: x * 0)).otherwise(F.col("e")))
    return f.groupBy("session_id").agg(F.round(F.avg(acoustics.face_missed(F.col("e")).cast("double")), 6).alias("zero_ratio"))


@query("t4_evidence_overlap", """WITH a AS (SELECT session_id, list_distinct(supporting) AS s, list_distinct(contradictory) AS c FROM assessments) SELECT session_id, len(list_intersect(s, c))::INTEGER AS overlap, round(len(list_intersect(s, c)) / len(list_distinct(s || c)), 6) AS ratio, len(s) > 0 AND len(c) > 0 AS coexists FROM a""", "assessments")
def t4(spark, d):
    o = policy.evidence_overlap(F.col("supporting"), F.col("contradictory"))
    return v.assessments(spark, d).select("session_id", F.size(o["overlap"]).alias("overlap"), F.round(o["overlap_ratio"], 6).alias("ratio"), o["coexists"].alias("coexists"))


ENTROPY_SQL = "CASE WHEN risk <= 0 OR risk >= 1 THEN 0 ELSE -(risk * log2(risk) + (1 - risk) * log2(1 - risk)) END"


@query("t6_trigger_score", f"""WITH a AS (SELECT *, {ENTROPY_SQL} AS entropy, CASE WHEN audio_rel >= 0.6 AND visual_rel >= 0.6 AND audio_risk IS NOT NULL THEN abs(audio_risk - visual_risk) ELSE 0 END AS dis FROM assessments)
  SELECT session_id, round(least(1, greatest(0, entropy, 1 - confidence, dis, 1 - (coalesce(audio_rel, visual_rel) + visual_rel) / 2, 1 - least(coalesce(audio_rel, visual_rel), visual_rel), CASE WHEN session_id % 2 = 0 THEN 1 ELSE 0 END)), 6) AS score FROM a""", "assessments")
def t6(spark, d):
    a, c = v.assessments(spark, d), F.col
    low = F.coalesce("audio_rel", "visual_rel")
    dis = policy.reliable_disagreement(F.array("audio_risk", "visual_risk"), F.array("audio_rel", "visual_rel"))
    coexists = policy.evidence_overlap(F.when(c("session_id") % 2 == 0, c("supporting")), c("contradictory"))["coexists"]
    return a.select("session_id", F.round(policy.trigger_score(policy.entropy(c("risk")), c("confidence"), dis, (low + c("visual_rel")) / 2, F.least(low, c("visual_rel")), coexists), 6).alias("score"))


@query("t5_all_reasons", f"""WITH a AS (SELECT *, {ENTROPY_SQL} AS entropy, list_intersect(supporting, contradictory) AS shared FROM assessments WHERE session_id % 2 = 0)
  SELECT session_id, concat_ws(',', CASE WHEN entropy >= 0.85 THEN 'high_entropy' END, CASE WHEN confidence <= 0.6 THEN 'low_confidence' END, CASE WHEN len(shared) > 0 THEN 'overlap' END, 'coexistence') AS reasons FROM a""", "assessments")
def t5(spark, d):
    """T5 with its seventh reason: evidence on both sides."""
    o = policy.evidence_overlap(F.col("supporting"), F.col("contradictory"))
    signals = {"high_entropy": policy.entropy(F.col("risk")) >= 0.85, "low_confidence": F.col("confidence") <= 0.6, "overlap": F.size(o["overlap"]) > 0, "coexistence": o["coexists"]}
    return v.assessments(spark, d).filter("session_id % 2 = 0").select("session_id", F.array_join(policy.trigger_reasons(signals), ",").alias("reasons"))


@query("t8_natural_order", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'S' || doc_id WHEN 1 THEN 'S0' || (doc_id // 2) || 'b' ELSE 'T' END || '-' || doc_id AS id FROM documents),
  k AS (SELECT doc_id, list_transform(regexp_extract_all(lower(id), '[0-9]+|[^0-9]+'), lambda p: {'k': (NOT regexp_matches(p, '^[0-9]'))::INT, 'n': TRY_CAST(p AS BIGINT), 't': CASE WHEN regexp_matches(p, '^[0-9]') THEN NULL ELSE p END}) AS k FROM x)
  SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id % 5 ORDER BY k) AS INTEGER) AS place FROM k""")
def t8(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", F.expr("concat(case doc_id % 3 when 0 then concat('S', doc_id) when 1 then concat('S0', doc_id div 2, 'b') else 'T' end, '-', doc_id)").alias("id"))
    order = Window.partitionBy(F.expr("doc_id % 5")).orderBy(policy.natural_key(F.col("id")))
    return rows.select("doc_id", F.row_number().over(order).alias("place"))


VALIDITY = {"audio": 0.8, "visual": 0.5}
FEATURES_SQL = f"""feat AS (SELECT session_id, confidence, coalesce(audio_rel, 0) AS reliability_audio, visual_rel AS reliability_visual, coalesce(audio_rel * visual_rel * 0.4::DOUBLE * abs(audio_risk - visual_risk), 0) AS reliable_disagreement,
  CASE WHEN audio_risk IS NOT NULL AND greatest(audio_rel, visual_rel) > 0.6 THEN (1 - least(audio_rel, visual_rel)) * abs(audio_risk - visual_risk) ELSE 0 END AS unreliable_disagreement, CASE WHEN audio_rel IS NULL THEN 0.5 ELSE 0 END::DOUBLE AS missing_fraction, {ENTROPY_SQL} AS entropy FROM assessments)"""


def audited(spark, d):
    return policy.audit_features(v.assessments(spark, d), VALIDITY)


@query("t9_audit_features", f"WITH {FEATURES_SQL} SELECT session_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in policy.AUDIT_FEATURES) + " FROM feat", "assessments")
def t9(spark, d):
    return audited(spark, d).select("session_id", *[F.round(c, 6).alias(c) for c in policy.AUDIT_FEATURES])


@query("t11_source_validity", """WITH c AS (SELECT quality AS y, unnest([{'source': 'audio', 'p': audio_risk}, {'source': 'visual', 'p': visual_risk}], recursive := true) FROM assessments JOIN labels ON session_id = doc_id WHERE quality IS NOT NULL),
  r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2 AS r FROM c WHERE p IS NOT NULL)
  SELECT source, round(least(1, greatest(0, 2 * (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) - 1)), 6) AS validity FROM r GROUP BY 1""", "assessments")
def t11(spark, d):
    a = v.assessments(spark, d).join(v.table(spark, d, "labels"), F.col("session_id") == F.col("doc_id"))
    return policy.source_validity(a, "quality", {"audio": "audio_risk", "visual": "visual_risk"}).withColumn("validity", F.round("validity", 6))


#: A fitted audit of fixed values, as a file of one holds it.
MODEL = {
    "mean": dict.fromkeys(policy.AUDIT_FEATURES, 0.5), "scale": dict.fromkeys(policy.AUDIT_FEATURES, 0.25), "intercept": -0.3,
    "weights": dict(zip(policy.AUDIT_FEATURES, (-0.5, -0.25, 0.125, 0.75, 0.5, 1.0, 0.25), strict=True)),
}
RISK_SQL = f"{FEATURES_SQL}, risks AS (SELECT session_id, round(1 / (1 + exp(-greatest(-30, least(30, -0.3::DOUBLE + " + " + ".join(f"({c} - 0.5::DOUBLE) / 0.25::DOUBLE * {w}::DOUBLE" for c, w in MODEL["weights"].items()) + ")))), 12) AS risk FROM feat)"


@query("t15_audit_risk", f"WITH {RISK_SQL} SELECT session_id, round(risk, 6) AS risk FROM risks", "assessments")
def t15(spark, d):
    return audited(spark, d).select("session_id", F.round(policy.audit_risk(MODEL), 6).alias("risk"))


@query("t16_decisions", f"""WITH {RISK_SQL}, k AS (SELECT round_even(count(*) * 0.25, 0)::BIGINT AS k FROM risks), t AS (SELECT r.risk AS t FROM (SELECT risk, row_number() OVER (ORDER BY risk DESC) AS n FROM risks) r, k WHERE n = k)
  SELECT session_id, CASE WHEN session_id % 13 <> 0 THEN round(risk, 6) END AS audit_risk, session_id % 13 = 0 OR risk >= (SELECT t FROM t) AS should_rethink FROM risks""", "assessments")
def t16(spark, d):
    """A threshold for a quarter of the cases, and what each case gets."""
    rows = audited(spark, d).select("*", F.round(policy.audit_risk(MODEL), 12).alias("own"))
    threshold = policy.risk_threshold(rows.select(F.col("own").alias("risk")), 0.25).first()["threshold"]
    out = policy.decide(rows, MODEL, float(threshold) - 5e-13, F.col("session_id") % 13 == 0)
    return out.select("session_id", F.round("audit_risk", 6).alias("audit_risk"), "should_rethink")


@query("t16_error_targets", "SELECT session_id, ((risk >= 0.5) <> (quality = 1))::INTEGER AS wrong FROM assessments JOIN labels ON session_id = doc_id WHERE quality IS NOT NULL", "assessments")
def t16_targets(spark, d):
    a = v.assessments(spark, d).join(v.table(spark, d, "labels"), F.col("session_id") == F.col("doc_id")).filter("quality is not null")
    return a.select("session_id", policy.error_target(F.col("risk"), F.lit(0.5), F.col("quality")).alias("wrong"))


@query("m3_log_loss", "SELECT seed, " + ", ".join(f"round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(p, {e}::DOUBLE), 1 - {e}::DOUBLE) ELSE 1 - least(greatest(p, {e}::DOUBLE), 1 - {e}::DOUBLE) END)), 6) AS loss_{n}" for n, e in {"loop": 1e-7, "matched": 1e-12, "video": 1e-15}.items()) + " FROM preds GROUP BY 1", "preds")
def m3(spark, d):
    p, y = F.col("p"), F.col("y")
    return v.predictions(spark, d).groupBy("seed").agg(*[F.round(metrics.log_loss(p, y, e), 6).alias(f"loss_{n}") for n, e in {"loop": 1e-7, "matched": 1e-12, "video": 1e-15}.items()])
