"""Queries over shortlists, freezes, manifests and feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import baselines, lineage, shortlists
from lumenlake.plans import views as v
from lumenlake.plans.catalog import query
from lumenlake.plans.evidence import DIM_SQL, PROFILES, definitions, profiles
from lumenlake.plans.loops import drafts

CANDIDATES_SQL = """cand AS (SELECT o_custkey % 40 AS session_id, printf('S%03d', o_orderkey % 3) AS segment_id, 'Q' || (o_orderkey % 2) AS query_id, o_orderkey AS atomic_no, 'E' || o_orderkey AS atomic_id, o_orderkey * 5::DOUBLE AS mid, 5::DOUBLE AS duration,
  (o_orderkey * 37 % 101)::DOUBLE / 100 AS pattern_relevance, (o_orderkey % 4)::DOUBLE / 4 AS coverage, (o_orderkey * 13 % 97)::DOUBLE / 96 AS reliability FROM orders)"""
RANKED_SQL = f"{CANDIDATES_SQL}, ranked AS (SELECT *, round(0.70::DOUBLE * pattern_relevance + 0.20::DOUBLE * coverage + 0.10::DOUBLE * reliability, 9) AS score FROM cand WHERE coverage > 0)"
_PICK_SQL = "picked AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment_id, query_id ORDER BY score DESC, atomic_no) AS pick FROM ranked)"


def candidates(spark, d):
    return v.table(spark, d, "orders").selectExpr(
        "o_custkey % 40 as session_id", "format_string('S%03d', o_orderkey % 3) as segment_id", "concat('Q', o_orderkey % 2) as query_id", "o_orderkey as atomic_no", "concat('E', o_orderkey) as atomic_id", "o_orderkey * 5D as mid", "5D as duration",
        "(o_orderkey * 37 % 101) / 100D as pattern_relevance", "(o_orderkey % 4) / 4D as coverage", "(o_orderkey * 13 % 97) / 96D as reliability",
    )


def picked(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id", "segment_id", "query_id").orderBy(F.desc("score"), "atomic_no")
    return shortlists.ranked(candidates(spark, d)).withColumn("pick", F.row_number().over(w))


@query("q11_ranked_candidates", f"WITH {RANKED_SQL} SELECT session_id, atomic_id, round(score, 6) AS score FROM ranked")
def q11_ranked(spark, d):
    return shortlists.ranked(candidates(spark, d)).select("session_id", "atomic_id", F.round("score", 6).alias("score"))


@query("q11_shortlist_sizes", f"WITH {RANKED_SQL} SELECT session_id, segment_id, query_id, least(8, count(*), 4)::BIGINT AS n FROM ranked GROUP BY 1, 2, 3")
def q11(spark, d):
    """Q9 to Q11: as many diverse candidates as the budget of two allows."""
    return shortlists.shortlist(candidates(spark, d), 2).groupBy("session_id", "segment_id", "query_id").agg(F.count("*").alias("n"))


@query("j17_unseen", f"WITH {CANDIDATES_SQL} SELECT session_id, atomic_id FROM cand WHERE atomic_no % 3 <> 1")
def j17(spark, d):
    c = candidates(spark, d)
    return shortlists.unseen(c, c.filter("atomic_no % 3 = 1")).select("session_id", "atomic_id")


@query("j17_exclusion_violations", f"WITH {CANDIDATES_SQL} SELECT session_id, atomic_id, 'repeated' AS reason FROM cand WHERE atomic_no % 5 = 0 UNION ALL SELECT session_id, atomic_id || 'x', 'unknown' FROM cand WHERE atomic_no % 7 = 0")
def j17_violations(spark, d):
    c = candidates(spark, d).select("session_id", "atomic_id", "atomic_no")
    seen = c.unionByName(c.filter("atomic_no % 5 = 0")).unionByName(c.filter("atomic_no % 7 = 0").withColumn("atomic_id", F.expr("concat(atomic_id, 'x')")))
    return shortlists.exclusion_violations(c, seen)


@query("q12_release", f"WITH {CANDIDATES_SQL} SELECT session_id, atomic_id, 'text of ' || atomic_id AS text FROM cand WHERE atomic_no % 4 = 1")
def q12(spark, d):
    c = candidates(spark, d).select("session_id", "atomic_id", F.col("mid").alias("start_sec"), "atomic_no")
    texts = c.select("session_id", "atomic_id", (F.col("start_sec") + 1e-10).alias("start_sec"), F.concat(F.lit("text of "), "atomic_id").alias("text"))
    return shortlists.release(c.filter("atomic_no % 4 = 1").select("session_id", "atomic_id", "start_sec"), texts).select("session_id", "atomic_id", "text")


@query("q12_release_violations", f"WITH {RANKED_SQL}, {_PICK_SQL}, s AS (SELECT session_id, segment_id, query_id, count(*) AS n FROM picked WHERE pick <= CASE session_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END GROUP BY 1, 2, 3) SELECT session_id, segment_id, query_id, 'over_budget' AS reason FROM s WHERE n > 2")
def q12_violations(spark, d):
    rows = picked(spark, d)
    chosen = rows.filter("pick <= case session_id % 3 when 0 then 1 when 1 then 2 else 3 end").select("session_id", "segment_id", "query_id", "atomic_id")
    return shortlists.release_violations(chosen, rows, ["session_id", "segment_id", "query_id"], 2)


@query("q14_cues", f"WITH {CANDIDATES_SQL} SELECT atomic_id, session_id, CASE WHEN reliability >= 0.8 THEN 'good measured coverage' WHEN reliability >= 0.4 THEN 'partial measured coverage' ELSE 'limited measured coverage' END AS quality, CASE WHEN query_id = 'Q0' THEN 'target slots change from an earlier window' ELSE 'measurement quality changes near this window' END || CASE WHEN reliability < 0.8 THEN '; measurement quality is incomplete and requires review' ELSE '' END AS cue FROM cand")
def q14(spark, d):
    pattern = F.expr("if(query_id = 'Q0', 'change point', 'quality boundary')")
    return candidates(spark, d).select("atomic_id", "session_id", shortlists.quality_summary(F.col("reliability")).alias("quality"), shortlists.cues(pattern, F.lit(False), F.col("reliability")).alias("cue"))


@query("v12_candidate_cards", f"WITH {CANDIDATES_SQL} SELECT session_id, atomic_id || ' | time ' || mid::BIGINT || ' to ' || (mid::BIGINT + 2) || '.5 seconds | retrieval cue: c | requested slots present: tone, face | quality: q' AS card FROM cand")
def v12(spark, d):
    c = F.col
    return candidates(spark, d).select("session_id", shortlists.card(c("atomic_id"), c("mid"), c("mid") + 2.5, F.lit("c"), F.array(F.lit("tone"), F.lit("face")), F.lit("q")).alias("card"))


@query("q15_canonical_names", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'change point' WHEN 1 THEN 'quality boundary' END AS pattern FROM documents")
def q15(spark, d):
    raw = F.expr("element_at(array('Change_Point', 'QUALITY boundary', 'other'), cast(doc_id % 3 + 1 as int))")
    return v.table(spark, d, "documents").select("doc_id", shortlists.canonical_names(raw, list(shortlists.PATTERNS)).alias("pattern"))


@query("q16_enumerated", """WITH s AS (SELECT DISTINCT session_id, segment_id, modality, source_id AS slot_id FROM units WHERE atomic_no % 9 < 3) SELECT session_id, segment_id, 'extreme' AS pattern, slot_id AS slots FROM s
  UNION ALL SELECT a.session_id, a.segment_id, 'cross-modal co-change', a.slot_id || ',' || b.slot_id FROM s a JOIN s b ON a.session_id = b.session_id AND a.segment_id = b.segment_id AND a.modality = 'audio' AND b.modality = 'visual'""", "units")
def q16(spark, d):
    s = v.units(spark, d).filter("atomic_no % 9 < 3").select("session_id", "segment_id", "modality", F.col("source_id").alias("slot_id")).distinct()
    return shortlists.enumerated(s, ["extreme", "cross-modal co-change"]).select("session_id", "segment_id", "pattern", F.array_join("target_slots", ",").alias("slots"))


SCORES_SQL = f"""{RANKED_SQL}, {_PICK_SQL}, scores AS (SELECT session_id, segment_id, query_id, {list(shortlists.PATTERNS)}[session_id % 5 + CASE WHEN query_id = 'Q0' THEN 1 ELSE 0 END - (CASE WHEN session_id % 5 = 4 AND query_id = 'Q0' THEN 5 ELSE 0 END) + 1] AS pattern, max(pattern_relevance) AS relevance, round(sum(score) FILTER (WHERE pick <= 2), 9) AS top_two, count(*) AS n FROM picked WHERE pick <= 4 GROUP BY 1, 2, 3 HAVING max(pattern_relevance) > 0)"""


def scores(spark, d):
    names = ", ".join(f"'{p}'" for p in shortlists.PATTERNS)
    rows = picked(spark, d).filter("pick <= 4").withColumn("pattern", F.expr(f"element_at(array({names}), cast(pmod(session_id % 5 + if(query_id = 'Q0', 1, 0), 5) + 1 as int))"))
    out = shortlists.query_scores(rows, ["session_id", "segment_id", "query_id"]).withColumn("top_two", F.round("top_two", 9))
    return out.filter("relevance > 0").withColumn("target_slots", F.array("query_id"))


@query("q17_best_per_pattern", f"WITH {SCORES_SQL} SELECT session_id, pattern, segment_id, query_id, (list_position({list(shortlists.PATTERNS)}, pattern) - 1 - ('0x' || substr(sha256(session_id::VARCHAR), 1, 8))::BIGINT % 5 + 5) % 5 AS turn FROM scores QUALIFY row_number() OVER (PARTITION BY session_id, pattern ORDER BY relevance DESC, top_two DESC, n DESC, query_id, segment_id) = 1")
def q17(spark, d):
    return shortlists.best_per_pattern(scores(spark, d)).select("session_id", "pattern", "segment_id", "query_id", F.col("turn").cast("long").alias("turn"))


@query("q18_best_query", f"WITH {SCORES_SQL} SELECT session_id, segment_id, query_id FROM scores QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY relevance DESC, top_two DESC, n DESC, pattern, segment_id, query_id) = 1")
def q18(spark, d):
    return shortlists.best_query(scores(spark, d)).select("session_id", "segment_id", "query_id")


@query("q19_random_choice", f"WITH {RANKED_SQL}, {_PICK_SQL} SELECT session_id, query_id, atomic_id FROM picked WHERE pick <= 6 QUALIFY row_number() OVER (PARTITION BY session_id, query_id ORDER BY sha256('7:' || session_id || ':' || query_id || ':' || atomic_id)) <= 2")
def q19(spark, d):
    return shortlists.random_choice(picked(spark, d).filter("pick <= 6"), ["session_id", "query_id"], 2, 7).select("session_id", "query_id", "atomic_id")


@query("q20_top_choice", f"WITH {RANKED_SQL}, {_PICK_SQL} SELECT session_id, segment_id, query_id, atomic_id FROM picked WHERE pick <= 2")
def q20(spark, d):
    return shortlists.top_choice(picked(spark, d), 2).select("session_id", "segment_id", "query_id", "atomic_id")


@query("q21_collection_segments", f"""WITH {SCORES_SQL}, b AS (SELECT session_id, segment_id, (list_position({list(shortlists.PATTERNS)}, pattern) - 1 - ('0x' || substr(sha256(session_id::VARCHAR), 1, 8))::BIGINT % 5 + 5) % 5 AS turn FROM scores QUALIFY row_number() OVER (PARTITION BY session_id, pattern ORDER BY relevance DESC, top_two DESC, n DESC, query_id, segment_id) = 1),
  f AS (SELECT session_id, segment_id, min(turn) AS t FROM b WHERE session_id % 4 <> 0 GROUP BY 1, 2) SELECT session_id, segment_id FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t) <= 3 UNION ALL SELECT DISTINCT session_id, 'S777' FROM cand WHERE session_id % 4 = 0""")
def q21(spark, d):
    natural = candidates(spark, d).select("session_id").distinct().withColumn("segment_ids", F.expr("if(session_id % 4 = 0, array('S777'), cast(array() as array<string>))"))
    return shortlists.collection_segments(natural, scores(spark, d))


@query("l5_replay_violations", "SELECT o_custkey AS session_id, CASE WHEN o_custkey % 3 = 0 THEN 'candidates_differ' ELSE 'not_in_ledger' END AS reason FROM orders WHERE o_custkey % 3 <> 1 GROUP BY 1, 2")
def l5(spark, d):
    s = v.table(spark, d, "orders").select(F.col("o_custkey").alias("session_id")).distinct().withColumn("atomic_ids", F.array(F.lit("E1"), F.lit("E2")))
    ledger = s.filter("session_id % 3 <> 2").withColumn("atomic_ids", F.expr("if(session_id % 3 = 0, reverse(atomic_ids), atomic_ids)"))
    return shortlists.replay_violations(ledger, s, ["session_id"])


@query("l7_repaired", "SELECT s_suppkey AS session_id, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS attempt, 'E1' AS cited, s_suppkey % 3 = 2 AS ids_dropped FROM supplier")
def l7(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("session_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("attempt"))
    s = s.selectExpr("session_id", "attempt", "if(session_id % 3 = attempt and attempt < 2, array('E1'), array('E1', 'E9')) as cited", "array('E1', 'E2') as allowed", "0.5D as probability")
    return shortlists.repaired(s).select("session_id", "attempt", F.array_join("cited", ",").alias("cited"), "ids_dropped")


@query("r3_reservoir", "SELECT l_returnflag, least(count(*), 100)::BIGINT AS n FROM lineitem GROUP BY 1")
def r3(spark, d):
    rows = v.table(spark, d, "lineitem").withColumn("id", F.expr("xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber)"))
    return lineage.reservoir(rows, ["l_returnflag"], "id", 100, 42).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("r8_ids_digest", """WITH k AS (SELECT DISTINCT o_custkey::VARCHAR AS k FROM orders), r AS (SELECT substr(sha256(k), 1, 3) AS r, sha256(string_agg(k, chr(10) ORDER BY k)) AS d, count(*) AS n FROM k GROUP BY 1)
  SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY r)) AS digest, true AS same FROM r""")
def r8(spark, d):
    o = v.table(spark, d, "orders")
    a, b = lineage.ids_digest(o, "o_custkey"), lineage.ids_digest(o.select("o_custkey").distinct().orderBy(F.desc("o_custkey")), "o_custkey")
    return a.join(b.withColumnRenamed("digest", "other").drop("n"), F.lit(True)).select("n", "digest", (F.col("digest") == F.col("other")).alias("same"))


@query("w3_row_slices", "SELECT o_orderkey, floor(o_totalprice / 1000)::BIGINT AS first_row, ceil(o_totalprice / 1000 + 4.5)::BIGINT AS end_row FROM orders")
def w3(spark, d):
    w = v.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("start_sec"), (F.col("o_totalprice") / 1000 + 4.5).alias("end_sec"))
    return lineage.row_slices(w).select("o_orderkey", "first_row", "end_row")


@query("w5_session_durations", "SELECT session_id, max(t) AS duration FROM (SELECT session_id, start_sec AS t FROM units UNION ALL SELECT conv_id, turn * 10::DOUBLE + 10 FROM conversations) GROUP BY 1", "units")
def w5(spark, d):
    return lineage.session_durations([v.units(spark, d).select("session_id", F.col("start_sec").alias("t")), v.utterances(spark, d).select("session_id", F.col("end_sec").alias("t"))])


@query("p9_missing_reasons", "SELECT unit_id, CASE WHEN unit_id % 6 = 0 THEN 'interrupted,' ELSE '' END || CASE WHEN unit_id % 10 = 0 THEN 'source_ended_before_window' WHEN unit_id % 10 = 1 THEN 'face_tracking_failure' WHEN valid_ratio < 0.8 THEN 'partial_face_tracking' ELSE '' END AS reasons FROM units", "units")
def p9(spark, d):
    r = lineage.missing_reasons(F.when(F.col("unit_id") % 10 == 0, 0).otherwise(5), F.when(F.col("unit_id") % 10 == 1, 0).otherwise(5), F.col("valid_ratio"), F.expr("if(unit_id % 6 = 0, array('interrupted', ''), null)"), "partial_face_tracking")
    text = F.array_join(r, ",")
    return v.units(spark, d).select("unit_id", F.when((F.col("unit_id") % 6 == 0) & (F.size(r) == 1), F.concat(text, F.lit(","))).otherwise(text).alias("reasons"))


@query("p13_evidence_views", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'guidance' ELSE 'SEGMENT S001 | a | b | c | AUDIO summary; x' END AS value FROM documents")
def p13(spark, d):
    lines = v.table(spark, d, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, 'guidance', 'SEGMENT S001 | a | b | c | AUDIO summary; x | VISUAL summary; y') as value")
    return lineage.evidence_view(lines, "audio")


def features(spark, d):
    return baselines.session_features(v.units(spark, d), v.observations(spark, d))


@query("f2_session_features", """WITH l AS (SELECT session_id, modality || '.quality.valid_ratio' AS name, start_sec AS t, valid_ratio AS value FROM units UNION ALL SELECT session_id, modality || '.observation.' || name, start_sec, value FROM units JOIN observations USING (unit_id)),
  s AS (SELECT session_id, name, count(*)::DOUBLE AS count, avg(value) AS mean, median(value) AS median, max(value) AS max FROM l GROUP BY 1, 2)
  SELECT session_id, name || '.' || f AS feature, round(v, 9) AS value FROM s, LATERAL (SELECT unnest(['count', 'mean', 'median', 'max']) AS f, unnest([count, mean, median, max]) AS v)
  UNION ALL SELECT session_id, 'session.duration_seconds', max(start_sec) FROM units GROUP BY 1 UNION ALL SELECT session_id, modality || '.unit_count', count(*) FROM units GROUP BY session_id, modality UNION ALL SELECT session_id, modality || '.availability.partial_fraction', round(avg((availability = 'partial')::INT), 9) FROM units GROUP BY session_id, modality""", "units", "observations")
def f2(spark, d):
    keep = F.col("feature").rlike(r"\.(count|mean|median|max|unit_count|partial_fraction|duration_seconds)$")
    return features(spark, d).filter(keep).select("session_id", "feature", F.round("value", 9).alias("value"))


@query("p14_feature_views", "SELECT session_id, 'session.duration_seconds' AS feature, max(start_sec) AS value FROM units GROUP BY 1 UNION ALL SELECT session_id, 'audio.unit_count', count(*)::DOUBLE FROM units WHERE modality = 'audio' GROUP BY 1", "units")
def p14(spark, d):
    own = features(spark, d).filter("feature like 'session.%' or feature like '%.unit_count'")
    return lineage.feature_view(own, "audio").select("session_id", "feature", "value")


@query("f3_feature_matrix", "SELECT session_id, count(*) FILTER (WHERE modality = 'audio')::DOUBLE AS audio_units, count(*) FILTER (WHERE modality = 'visual')::DOUBLE AS visual_units FROM units GROUP BY 1", "units")
def f3(spark, d):
    f = features(spark, d).filter("feature like '%.unit_count'")
    m = baselines.feature_matrix(f, f.select("session_id").filter("session_id % 2 = 0").distinct())
    return m.select("session_id", F.col("`audio.unit_count`").alias("audio_units"), F.col("`visual.unit_count`").alias("visual_units"))


@query("f5_class_weights", "SELECT doc_id, round((SELECT count(*) FROM labels WHERE quality IS NOT NULL) / (2 * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels WHERE quality IS NOT NULL")
def f5(spark, d):
    return baselines.class_weights(v.table(spark, d, "labels").filter("quality is not null"), "quality").select("doc_id", F.round("weight", 6).alias("weight"))


@query("f7_out_of_fold")
def f7(spark, d):
    x = drafts(spark, d).select("session_id", "label", "probability", "visual", F.expr("cast(session_id % 3 as int)").alias("fold"))
    return baselines.out_of_fold(x, ["probability", "visual"], "label", "fold", 3, 1.0).withColumn("probability", F.round("probability", 6))


@query("f10_by_view", "SELECT session_id, round(any_value(p) FILTER (WHERE seed = 42), 6) AS audio, round(any_value(p) FILTER (WHERE seed = 43), 6) AS visual FROM preds GROUP BY 1", "preds")
def f10(spark, d):
    p = v.predictions(spark, d).filter("seed < 44").select("session_id", F.expr("if(seed = 42, 'audio', 'visual')").alias("view"), F.round("p", 6).alias("probability"))
    return baselines.by_view(p).select("session_id", F.col("views")["audio"].alias("audio"), F.col("views")["visual"].alias("visual"))


@query("f11_oof_violations", "SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'repeated' WHEN o_orderkey % 10 = 2 THEN 'not_held_out' ELSE 'label_differs' END AS reason FROM orders WHERE o_orderkey % 10 < 4")
def f11(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"))
    rows = o.filter("session_id % 10 <> 0").withColumn("x", F.explode(F.expr("if(session_id % 10 = 1, array(0, 1), array(0))"))).selectExpr("session_id", "session_id % 5 as fold", "if(session_id % 10 = 2, 9, session_id % 5) as held_out_fold", "if(session_id % 10 = 3, 1, 0) as label")
    return lineage.oof_violations(rows, o.withColumn("label", F.lit(0)))


def seeds(spark, d):
    p = v.predictions(spark, d).filter("y is not null")
    return p.selectExpr("session_id", "if(session_id % 4 = 0, 'test', 'valid') as split", "seed", "y as label", "p as probability")


@query("f12_seed_freeze", "SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'test' ELSE 'valid' END AS split, CASE WHEN session_id % 4 <> 0 THEN any_value(y) END AS label, round(avg(p), 6) AS probability FROM preds WHERE y IS NOT NULL GROUP BY 1, 2", "preds")
def f12(spark, d):
    return lineage.seed_freeze(seeds(spark, d), [42, 43, 44]).withColumn("probability", F.round("probability", 6))


@query("f13_freeze_violations", "SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'not_the_mean' ELSE 'label_shown' END AS reason FROM preds WHERE y IS NOT NULL AND (session_id % 5 = 0 OR session_id % 4 = 0) GROUP BY 1, 2", "preds")
def f13(spark, d):
    f = lineage.seed_freeze(seeds(spark, d), [42, 43, 44]).withColumn("probability", F.expr("if(session_id % 5 = 0, probability + 0.001D, probability)"))
    f = f.withColumns({"predicted": (F.col("probability") >= 0.5).cast("int"), "label": F.when(F.col("split") == "test", 1).otherwise(F.col("label"))})
    return lineage.freeze_violations(f, seeds(spark, d), 0.5, 1e-12)


@query("f14_label_mismatches", "SELECT p_partkey AS session_id, CASE WHEN p_size > 24 THEN 'bad_score' ELSE 'released_label_differs' END AS reason FROM part WHERE p_size > 24 OR (p_partkey % 7 = 0)")
def f14(spark, d):
    return lineage.label_mismatches(v.table(spark, d, "part").selectExpr("p_partkey as session_id", "p_size as score", "if(p_partkey % 7 = 0, 1 - cast(p_size >= 10 as int), cast(p_size >= 10 as int)) as released"))


@query("f16_provenance", "SELECT n_regionkey AS fold, 'several_references' AS reason FROM nation WHERE n_regionkey = 1 GROUP BY 1 UNION ALL SELECT n_regionkey, 'fitted_on_others' FROM nation WHERE n_regionkey = 2 GROUP BY 1")
def f16(spark, d):
    n = v.table(spark, d, "nation").selectExpr("n_regionkey as fold", "n_nationkey as session_id", "'fit' as role", "if(n_regionkey = 1, concat('r', n_nationkey), 'r') as reference_id")
    return lineage.provenance_violations(n, n.filter("not (fold = 2 and session_id % 2 = 0)").select("fold", "session_id"))


@query("j11_triple_join", "SELECT s_suppkey AS session_id, s_name AS plan, s_acctbal AS decision FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def j11(spark, d):
    s = v.table(spark, d, "supplier").selectExpr("s_suppkey as session_id", "s_name as plan", "s_acctbal as decision")
    return lineage.triple_join(s.select("session_id"), s.filter("session_id % 2 = 0").select("session_id", "plan"), s.filter("session_id % 3 = 0").select("session_id", "decision"))


@query("j13_frozen_with_labels", "SELECT session_id, row_number() OVER (ORDER BY session_id DESC) AS place, any_value(y) AS label, round(avg(p), 6) AS probability FROM preds WHERE y IS NOT NULL AND session_id % 4 = 0 GROUP BY 1", "preds")
def j13(spark, d):
    from lumenlake.operators.quantiles import prefix_sums

    s = seeds(spark, d).filter("split = 'test'")
    own = s.groupBy("session_id").agg(F.max("label").alias("label")).withColumn("one", F.lit(1))
    official = prefix_sums(own, [], [F.desc("session_id")], ["one"]).withColumn("place", (F.col("one_before") + 1).cast("long"))
    out = lineage.frozen_with_labels(lineage.seed_freeze(s, [42, 43, 44]), official)
    return out.select("session_id", "place", "label", F.round("probability", 6).alias("probability"))


@query("v15_window_units", "SELECT o_orderkey AS session_id, m AS modality, CASE WHEN m = 'audio' AND o_orderkey % 3 = 0 THEN 'present' WHEN m = 'audio' AND o_orderkey % 3 = 1 THEN 'partial' ELSE 'unavailable' END AS availability FROM orders, (VALUES ('audio'), ('visual')) t(m)")
def v15(spark, d):
    w = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit(0).alias("window_index"))
    m = w.filter("session_id % 3 <> 2").withColumns({"modality": F.lit("audio"), "valid_ratio": F.expr("if(session_id % 3 = 0, 0.9D, 0.5D)")})
    return lineage.window_units(w, m, ["audio", "visual"]).select("session_id", "modality", "availability")


@query("v19_view_digest", """WITH l AS (SELECT o_orderkey AS o, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS d FROM orders), r AS (SELECT o // 4096 AS r, sha256(string_agg(d, chr(10) ORDER BY o, d)) AS d FROM l GROUP BY 1)
  SELECT sha256(string_agg(d, chr(10) ORDER BY r)) AS digest FROM r""")
def v19(spark, d):
    """The digest of an ordered view does not change with its partitions."""
    from lumenlake.sources.sessions import view_digest

    o = v.table(spark, d, "orders")
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    return view_digest(o, "o_orderkey", line).unionByName(view_digest(o.repartition(7), "o_orderkey", line)).distinct()


@query("v17_token_audit", "SELECT conv_id AS session_id, count(*) AS lines, sum(len(regexp_extract_all(text, '[^ ]+'))) AS tokens, max(len(regexp_extract_all(text, '[^ ]+')))::INTEGER AS longest, sum(len(regexp_extract_all(text, '[^ ]+'))) <= 300 AS fits FROM conversations GROUP BY 1")
def v17(spark, d):
    lines = v.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "text")
    return lineage.token_audit(lines, F.size(F.regexp_extract_all("text", F.lit("([^ ]+)"), 1)), 300)


@query("v21_prediction_violations", "SELECT session_id, CASE WHEN session_id % 6 = 0 THEN 'unknown_split' WHEN session_id % 5 = 0 THEN 'bad_probability' ELSE 'label_shown' END AS reason FROM preds WHERE seed = 42 AND y IS NOT NULL AND (session_id % 6 = 0 OR session_id % 5 = 0 OR session_id % 4 = 0)", "preds")
def v21(spark, d):
    p = seeds(spark, d).filter("seed = 42").selectExpr("session_id", "if(session_id % 6 = 0, 'odd', split) as split", "if(session_id % 5 = 0, 1.5D, probability) as probability", "label")
    return lineage.prediction_violations(p, ["train", "valid", "test"])


@query("v22_metric_violations", "SELECT seed, 'brier' AS metric FROM preds WHERE seed = 43 GROUP BY 1", "preds")
def v22(spark, d):
    p = v.predictions(spark, d).groupBy("seed").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("value")).withColumn("metric", F.lit("brier"))
    return lineage.metric_violations(p.withColumn("value", F.expr("if(seed = 43, value + 0.001D, value + 1e-12D)")), p, ["seed"])


@query("v24_identity_violations", "SELECT n_nationkey AS session_id, 'protocol' AS field, 'other' AS value FROM nation WHERE n_nationkey % 4 = 0")
def v24(spark, d):
    return lineage.identity_violations(v.table(spark, d, "nation").selectExpr("n_nationkey as session_id", "'e_daic' as dataset", "if(n_nationkey % 4 = 0, 'other', 'native') as protocol"), {"dataset": "e_daic", "protocol": "native"})


@query("v26_transcript_markers", "SELECT n_nationkey AS session_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'none' END AS full FROM nation")
def v26(spark, d):
    n = v.table(spark, d, "nation").selectExpr("n_nationkey as session_id", "n_name as full")
    return lineage.with_transcripts(n.select("session_id"), n.filter("session_id % 2 = 0"), "none", ["full"])


@query("v27_prediction_rows", "SELECT session_id, y AS label, round(p, 6) AS probability, 0.5::DOUBLE AS threshold, (p >= 0.5)::INTEGER AS predicted_label, 'oof' AS prediction_origin FROM preds WHERE seed = 42", "preds")
def v27(spark, d):
    p = v.predictions(spark, d).filter("seed = 42").select("session_id", F.col("y").alias("label"), F.col("p").alias("probability"))
    return lineage.prediction_rows(p, 0.5, "oof").withColumn("probability", F.round("probability", 6))


@query("v28_token_summary", "SELECT o_orderpriority AS tier, count(*) AS n, min(o_custkey) AS least, max(o_custkey) AS most FROM orders GROUP BY 1")
def v28(spark, d):
    return lineage.token_summary(v.table(spark, d, "orders").selectExpr("o_orderpriority as tier", "o_custkey as tokens"))


@query("v32_plan_violations", "SELECT s_suppkey::VARCHAR AS key, 'unknown_segment' AS reason FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT '1', 'several_routes'")
def v32(spark, d):
    s = v.table(spark, d, "supplier")
    plans = s.selectExpr("s_suppkey as session_id", "s_suppkey % 3 as fold", "if(s_suppkey % 3 = 1, concat('r', s_suppkey % 2), 'r') as route", "array(if(s_suppkey % 5 = 0, 'S9', 'S1')) as segment_ids")
    return lineage.plan_violations(plans, s.selectExpr("s_suppkey as session_id", "'S1' as segment_id"))


@query("v35_status_counts", "SELECT o_custkey % 7 AS fold, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def v35(spark, d):
    return lineage.status_counts(v.table(spark, d, "orders").selectExpr("o_custkey % 7 as fold", "o_orderstatus as status"), ["fold"])


@query("v40_grounding", "SELECT n_nationkey, n_nationkey % 3 <> 0 AS query_ok, n_nationkey % 2 = 0 AS selection_ok FROM nation")
def v40(spark, d):
    n = v.table(spark, d, "nation")
    q = lineage.query_is_grounded(F.array(F.lit("tone")), F.lit("S001"), F.lit(1), F.expr("if(n_nationkey % 3 = 0, 'S001', 'tone in S001')"))
    s = lineage.selection_is_grounded(F.expr("if(n_nationkey % 2 = 0, array('E1'), array('E1', 'E1'))"), F.array(F.lit("E1"), F.lit("E2")), 2)
    return n.select("n_nationkey", q.alias("query_ok"), s.alias("selection_ok"))


@query("v44_fits_without_cut", "SELECT o_orderkey, o_custkey + 40 <= 1000 AS fits FROM orders")
def v44(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", lineage.fits_without_cut(F.col("o_custkey"), F.lit(40), 1000).alias("fits"))


@query("v46_outcomes", "SELECT doc_id, ['accepted_preserved', 'accepted_revised', 'referred_unresolved', 'referred_unresolved'][doc_id % 4 + 1] AS outcome FROM documents")
def v46(spark, d):
    status = F.expr("element_at(array('preserved', 'revised', 'unresolved', cast(null as string)), cast(doc_id % 4 + 1 as int))")
    return v.table(spark, d, "documents").select("doc_id", lineage.outcome(status).alias("outcome"))


@query("v47_seal_violations", "SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'not_sealed' WHEN 1 THEN 'outcome_differs' ELSE 'revision_without_release' END AS reason FROM orders WHERE o_orderkey % 4 < 3")
def v47(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    step = lambda n, cond, kind, outcome="cast(null as string)", status="cast(null as string)": o.filter(cond).selectExpr("run_id", f"{n} as order_key", f"'{kind}' as event_type", f"{outcome} as outcome", f"{status} as status")
    e = step(0, "true", "agent_opened").unionByName(step(1, "run_id % 4 <> 2", "evidence_released")).unionByName(step(2, "true", "revision_recorded", status="'revised'"))
    return lineage.seal_violations(e.unionByName(step(3, "run_id % 4 <> 0", "agent_closed", outcome="if(run_id % 4 = 1, 'accepted_preserved', 'accepted_revised')")))


@query("v48_initial_problems", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'anchor_moved' WHEN doc_id % 3 = 0 THEN 'id_not_allowed' END AS problem FROM documents")
def v48(spark, d):
    p = lineage.initial_problem(F.expr("if(doc_id % 4 = 0, 0.6D, 0.5D + 1e-9D)"), F.lit(0.5), F.expr("array(if(doc_id % 3 = 0, 'S9', 'S1'))"), F.array(F.lit("S1")))
    return v.table(spark, d, "documents").select("doc_id", p.alias("problem"))


@query("v49_slot_descriptions", f"""WITH {DIM_SQL}, x AS (SELECT source_id, '[' || string_agg('{{"slot_id":"' || slot_id || '","label":"' || label || '","observation_name":"' || name || '"}}', ',' ORDER BY slot_id, label, name) || ']' AS description FROM prof JOIN defs USING (modality, slot_id) GROUP BY 1)
  SELECT session_id, source_id, description, count(*) AS units FROM units JOIN x USING (source_id) GROUP BY ALL""", "units")
def v49(spark, d):
    """What the sources of each session measure."""
    met = v.units(spark, d).groupBy("session_id", "source_id").agg(F.count("*").alias("units"))
    names = sorted({p[0] for p in PROFILES})
    return met.join(F.broadcast(lineage.slot_descriptions(profiles(spark), definitions(spark), names)), "source_id").select("session_id", "source_id", "description", "units")


@query("v50_aliases", "SELECT n_nationkey, ['daic_woz', 'e_daic', NULL][n_nationkey % 3 + 1] AS dataset, CASE WHEN n_nationkey % 4 = 0 THEN 'stride' WHEN n_nationkey % 4 = 1 THEN 'ratio' END AS problem FROM nation")
def v50(spark, d):
    name = F.expr("element_at(array(' DAIC', 'E-Daic', 'other'), cast(n_nationkey % 3 + 1 as int))")
    problem = lineage.config_problem(F.lit(5.0), F.expr("if(n_nationkey % 4 = 0, 6D, 2.5D)"), F.lit(2.5), F.expr("if(n_nationkey % 4 = 1, 1.5D, 0.5D)"))
    return v.table(spark, d, "nation").select("n_nationkey", lineage.dataset_name(name).alias("dataset"), problem.alias("problem"))


@query("v52_decision_payloads", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'true' END AS should_rethink, CASE WHEN doc_id % 3 <> 0 THEN 1 END AS fields FROM documents")
def v52(spark, d):
    raw = F.expr("""concat('{"should_rethink": true, "other": 1', if(doc_id % 3 = 0, ', "True_Label": 1', ''), '}')""")
    m = lineage.decision_payload(raw)
    return v.table(spark, d, "documents").select("doc_id", m["should_rethink"].alias("should_rethink"), F.when(m.isNotNull(), F.size(m)).alias("fields"))
