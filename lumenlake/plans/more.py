"""More queries by name: guards, frame measures, choices, folds, checks and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.functions import text
from lumenlake.operators import audit, baselines, geometry, selection
from lumenlake.plans import views as v
from lumenlake.plans.catalog import ATOMIC_SQL, SEGMENT_SQL, WINDOWS_SQL, frames, query, segmented

AFTER = "text || (CASE doc_id % 4 WHEN 0 THEN ' is sad. T12' WHEN 1 THEN ' saddle' WHEN 2 THEN ' Depression ^A' ELSE ' true label: 1' END)"


@query("p10_collection_condition", "SELECT doc_id, CASE WHEN doc_id + 250 BETWEEN 300 AND 492 THEN 'wizard_of_oz' WHEN doc_id + 250 BETWEEN 600 AND 718 THEN 'autonomous_ai' ELSE 'unknown' END AS condition FROM documents")
def p10(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.collection_condition((F.col("doc_id") + 250).cast("string")).alias("condition"))


@query("p12_facet", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'dispersion' WHEN 1 THEN 'iqr' WHEN 2 THEN 'slope_or_change' WHEN 3 THEN 'slope_or_change' WHEN 4 THEN 'dispersion' ELSE 'level' END AS facet FROM part""")
def p12(spark, d):
    ends = F.array(*[F.lit(x) for x in ("variability", "rotation_range", "rotation_speed", "slope", "iqr_std", "level")])
    return v.table(spark, d, "part").select("p_partkey", text.facet(F.concat(F.lit("a_"), F.element_at(ends, (F.col("p_partkey") % 6 + 1).cast("int")))).alias("facet"))


@query("p17_text_guards", f"""WITH t AS (SELECT doc_id, {AFTER} AS t FROM documents) SELECT doc_id, regexp_matches(t, '(?i)\\bdepress(ed|ion|ive)?\\b|\\banxi(ous|ety)\\b|\\bsad(ness)?\\b|\\bhopeless(ness)?\\b|\\bdull gaze\\b|\\bhelpless(ness)?\\b|\\bsuicid(e|al)\\b') AS interpretive,
  regexp_matches(t, '(?i)\\b(spk|au_var|head_var|gaze_var|pitch_var|loud_var)\\b') OR regexp_matches(t, '\\b(VL|VH|L|T)\\d+\\b|\\^[A-Za-z]|(^|\\|)(A|V)\\[') AS opaque,
  regexp_matches(t, '(?i)(ground[ _-]?truth|gold[ _-]?label|sample[ _-]?label|target[ _-]?label|true[ _-]?label|label)["'']?\\s*[:=]') AS truth FROM t""")
def p17(spark, d):
    """Texts with interpretive terms, opaque shorthand or a ground-truth mark."""
    t = v.table(spark, d, "documents").select("doc_id", F.expr(AFTER).alias("t"))
    return t.select("doc_id", text.interpretive(F.col("t")).alias("interpretive"), text.opaque(F.col("t")).alias("opaque"), text.marks_truth(F.col("t")).alias("truth"))


@query("x2_keys", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS key, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.:-]+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM pages")
def x2(spark, d):
    """X2 and X4."""
    return v.table(spark, d, "pages").select("page_id", text.normal_key(F.col("url")).alias("key"), text.safe_token(F.col("url")).alias("token"))


@query("x3_numbers", "WITH t AS (SELECT row_id, regexp_replace(regexp_replace(printf('%.3f', value / 7), '0+$', ''), '\\.$', '') AS t FROM signals) SELECT row_id, CASE WHEN t IN ('', '-0') THEN '0' ELSE t END AS label FROM t", "signals")
def x3(spark, d):
    return v.signals(spark, d).select("row_id", text.number(F.col("value") / 7).alias("label"))


@query("x13_ids", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || '.5' WHEN 2 THEN 'P' || doc_id ELSE doc_id || 'd' END AS id FROM documents")
def x13(spark, d):
    raw = F.expr("' ' || doc_id || ' '"), F.expr("doc_id || '.5'"), F.expr("if(doc_id % 4 = 2, 'P' || doc_id, doc_id || 'd')")
    whole = F.when(F.col("doc_id") % 8 == 0, F.expr("doc_id || '.0'")).otherwise(raw[0])
    return v.table(spark, d, "documents").select("doc_id", text.normal_id(F.when(F.expr("doc_id % 4 = 0"), whole).when(F.expr("doc_id % 4 = 1"), raw[1]).otherwise(raw[2])).alias("id"))


_DIM = lambda i: f"embedding[{i}]::DOUBLE"
POSE_SQL = f"p AS (SELECT label AS session_id, {', '.join(f'{_DIM(i + 1)} AS x{i}' for i in range(6))} FROM embeddings)"


def points(spark, d):
    return frames(spark, d).select("session_id", *[F.col("features")[i].cast("double").alias(f"x{i}") for i in range(6)])


@query("a6_head_gaze", f"""WITH {POSE_SQL} SELECT session_id, round(median(x0), 6) AS pitch, round(median(x1), 6) AS yaw, round(sqrt((var_pop(x0) + var_pop(x1) + var_pop(x2)) / 3), 6) AS motion,
  round(list_sort([max(x0) - min(x0), max(x1) - min(x1), max(x2) - min(x2)])[2], 6) AS rotation_range, round(sqrt(var_pop(x3) + var_pop(x4)), 6) AS gaze,
  round(median(acos(greatest(-1, least(1, (x0 * x3 + x1 * x4 + x2 * x5) / (sqrt(x0 * x0 + x1 * x1 + x2 * x2) * sqrt(x3 * x3 + x4 * x4 + x5 * x5)))))), 6) AS inconsistency,
  round(median((sqrt((x0 - x2) ** 2 + (x1 - x3) ** 2) + sqrt((x2 - x4) ** 2 + (x3 - x5) ** 2)) / 2), 6) AS opening FROM p GROUP BY 1""")
def a6(spark, d):
    """A5 to A7, A9 to A11 and A22."""
    x = [F.col(f"x{i}") for i in range(6)]
    opening = (geometry.distance(x[0], x[1], x[2], x[3]) + geometry.distance(x[2], x[3], x[4], x[5])) / 2
    out = {
        "pitch": F.median("x0"), "yaw": F.median("x1"), "motion": geometry.motion_variability(x[:3]), "rotation_range": geometry.rotation_range(*x[:3]), "gaze": geometry.direction_variability(x[3], x[4]),
        "inconsistency": F.median(geometry.angle_between(x[:3], x[3:])), "opening": F.median(opening),
    }
    return points(spark, d).groupBy("session_id").agg(*[F.round(c, 6).alias(n) for n, c in out.items()])


@query("a15_voiced", """SELECT session_id, round(avg(CASE WHEN k >= 50 AND value > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS voiced_ratio, round(median(12 * log2(value / 27.5::DOUBLE)) FILTER (WHERE k >= 50 AND value > 0), 6) AS pitch_level,
  round(quantile_cont(12 * log2(value / 27.5::DOUBLE), 0.75) FILTER (WHERE k >= 50 AND value > 0) - quantile_cont(12 * log2(value / 27.5::DOUBLE), 0.25) FILTER (WHERE k >= 50 AND value > 0), 6) AS pitch_spread FROM signals GROUP BY 1""", "signals")
def a15(spark, d):
    """Voiced share, and level and spread of the voiced pitch."""
    voiced = F.coalesce((F.col("k") >= 50) & (F.col("value") > 0), F.lit(False))
    s = v.signals(spark, d).withColumns({"voiced": voiced, "pitch": F.when(voiced, geometry.semitones(F.col("value")))})
    return s.groupBy("session_id").agg(
        F.round(F.avg(F.col("voiced").cast("double")), 6).alias("voiced_ratio"), F.round(F.median("pitch"), 6).alias("pitch_level"),
        F.round(F.percentile("pitch", F.lit(0.75)) - F.percentile("pitch", F.lit(0.25)), 6).alias("pitch_spread"),
    )


@query("p2_row_filters", """SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite, list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS nonzero FROM embeddings""")
def p2(spark, d):
    """P2 and P3."""
    return v.table(spark, d, "embeddings").select("vec_id", geometry.all_finite(F.col("embedding")).alias("finite"), F.exists("embedding", lambda x: x != 0).alias("nonzero"))


@query("p6_expected_count", "SELECT session_id, greatest(1, round_even(duration / 86400::DOUBLE * 0.37::DOUBLE, 0)::BIGINT)::BIGINT AS expected FROM sessions", "signals", "sessions")
def p6(spark, d):
    return v.sessions(spark, d).select("session_id", geometry.expected_count(F.col("duration") / 86400, F.lit(0.37)).alias("expected"))


@query("g13_short_ids", """WITH n AS (SELECT run_id, min(n) AS a, max(n) AS b, count(*) AS c, string_agg(id, ', ' ORDER BY id) AS l FROM (SELECT DISTINCT session_id AS run_id, utterance_id + (utterance_id > 3)::INT * (session_id % 2) AS n, printf('E%04d', utterance_id + (utterance_id > 3)::INT * (session_id % 2)) AS id FROM utterances) GROUP BY 1)
  SELECT run_id, CASE WHEN c = 1 THEN l WHEN b - a + 1 = c THEN printf('E%04d to E%04d', a, b) ELSE printf('E%04d to E%04d (%d refs; exact list in segment plan)', a, b, c) END AS label FROM n""", "utterances")
def g13(spark, d):
    u = v.utterances(spark, d)
    n = F.expr("cast(utterance_id + if(utterance_id > 3, session_id % 2, 0) as int)")
    return selection.id_range(u.select(F.col("session_id").alias("run_id"), F.format_string("E%04d", n).alias("id")), ["run_id"], "id")


_EVEN = "WITH n AS (SELECT session_id, utterance_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM utterances WINDOW w AS (PARTITION BY session_id ORDER BY utterance_id)) SELECT session_id, utterance_id FROM n WHERE n <= 3 OR i IN (0, {}, n - 1)"


@query("g16_even_choice", _EVEN.format("round_even((n - 1) / 2, 0)"), "utterances")
def g16(spark, d):
    return selection.spread(v.utterances(spark, d), "session_id", "utterance_id", lambda n: selection.even_places(n, 3)).select("session_id", "utterance_id")


@query("g25_uniform_choice", _EVEN.format("floor((n - 1) / 2 + 0.5)"), "utterances")
def g25(spark, d):
    return selection.spread(v.utterances(spark, d), "session_id", "utterance_id", lambda n: selection.uniform_places(n, 3)).select("session_id", "utterance_id")


@query("q17_pattern_rotation", "SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INTEGER AS pattern FROM documents")
def q17(spark, d):
    turn = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long") % 5
    return v.table(spark, d, "documents").select("doc_id", turn.cast("int").alias("pattern"))


@query("f8_folds", "SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM labels WHERE quality IS NOT NULL")
def f8(spark, d):
    rows = v.table(spark, d, "labels").filter("quality is not null").select("doc_id", "quality")
    return selection.stratified_folds(rows, "quality", "doc_id", 5, 42).select("doc_id", "quality", "fold")


@query("f9_balanced_subset", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || doc_id), doc_id) <= 20")
def f9(spark, d):
    rows = v.table(spark, d, "labels").filter("quality is not null").select("doc_id", "quality")
    return selection.balanced_subset(rows, "quality", "doc_id", 20, 7).select("doc_id", "quality")


@query("d4r_quota", "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY n_chars, doc_id) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.25, 0))")
def d4r(spark, d):
    return selection.lowest_quota(v.table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 0.25)


@query("f4_impute_scale", """WITH m AS (SELECT median(audio_risk) AS mr, median(audio_rel) AS ml FROM assessments WHERE session_id % 2 = 0), x AS (SELECT session_id, coalesce(audio_risk, mr) AS r, coalesce(audio_rel, ml) AS l, (audio_risk IS NULL)::INT AS miss FROM assessments, m),
  s AS (SELECT avg(r) AS ar, stddev_pop(r) AS sr, avg(l) AS al, stddev_pop(l) AS sl FROM x WHERE session_id % 2 = 0) SELECT session_id, round((r - ar) / sr, 6) AS audio_risk, round((l - al) / sl, 6) AS audio_rel, miss AS audio_risk_missing FROM x, s""", "assessments")
def f4(spark, d):
    """a training-only matrix, imputed and scaled."""
    x = baselines.impute_scale(v.assessments(spark, d).select("session_id", "audio_risk", "audio_rel"), ["audio_risk", "audio_rel"], "session_id % 2 = 0")
    return x.select("session_id", F.round("audio_risk", 6).alias("audio_risk"), F.round("audio_rel", 6).alias("audio_rel"), "audio_risk_missing")


@query("f6_tfidf", """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark), t AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 50000),
  r AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS x FROM c JOIN f USING (term)) SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight FROM r""")
def f6(spark, d):
    return baselines.tfidf(v.table(spark, d, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query("m12_matched_transitions", """WITH x AS (SELECT a.y, (a.p >= 0.5) = (a.y = 1) AS f, (c.p >= 0.4) = (a.y = 1) AS n FROM preds a JOIN preds c ON a.session_id = c.session_id AND a.seed = 42 AND c.seed = 43),
  c AS (SELECT count(*) FILTER (WHERE f AND n) AS preserved, count(*) FILTER (WHERE f AND NOT n) AS harmed, count(*) FILTER (WHERE NOT f AND n) AS recovered, count(*) FILTER (WHERE NOT f AND NOT n) AS remaining FROM x)
  SELECT *, recovered - harmed AS net_corrected, round(harmed / (preserved + harmed), 6) AS harm_rate, round(recovered / (recovered + remaining), 6) AS recovery_rate FROM c""", "preds")
def m12(spark, d):
    p = v.predictions(spark, d)
    a, c = p.filter("seed = 42").select("session_id", "y", "p"), p.filter("seed = 43").select("session_id", F.col("p").alias("q"))
    out = a.join(c, "session_id").filter("y is not null").agg(*audit.matched_transitions(F.col("y") == 1, F.col("p") >= 0.5, F.col("q") >= 0.4))
    return out.withColumns({x: F.round(x, 6) for x in ("harm_rate", "recovery_rate")})


@query("m10_seed_summary", "WITH s AS (SELECT seed, avg((p - y) * (p - y)) AS b FROM preds GROUP BY 1) SELECT round(avg(b), 6) AS mean, round(coalesce(stddev_samp(b), 0), 6) AS std, round(min(b), 6) AS lowest, round(max(b), 6) AS highest FROM s", "preds")
def m10(spark, d):
    s = v.predictions(spark, d).groupBy("seed").agg(F.avg(F.expr("(p - y) * (p - y)")).alias("b"))
    out = {"mean": F.avg("b"), "std": F.coalesce(F.stddev_samp("b"), F.lit(0.0)), "lowest": F.min("b"), "highest": F.max("b")}
    return s.agg(*[F.round(c, 6).alias(n) for n, c in out.items()])


@query("m25_score_diagnostics", "SELECT seed, count(DISTINCT p) AS scores, min(p) AS lowest, max(p) AS highest, round(avg(p) FILTER (WHERE y = 1), 6) AS mean_1, round(avg(p) FILTER (WHERE y = 0), 6) AS mean_0 FROM preds GROUP BY 1", "preds")
def m25(spark, d):
    of = lambda y: F.round(F.avg(F.when(F.col("y") == y, F.col("p"))), 6)
    return v.predictions(spark, d).groupBy("seed").agg(F.countDistinct("p").alias("scores"), F.min("p").alias("lowest"), F.max("p").alias("highest"), of(1).alias("mean_1"), of(0).alias("mean_0"))


@query("m26_longest_run", """WITH x AS (SELECT session_id, value > 100 AS ok, sum((value <= 100)::INT) OVER (PARTITION BY session_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS run FROM signals),
  r AS (SELECT session_id, run, count(*) FILTER (WHERE ok) AS n FROM x GROUP BY 1, 2) SELECT session_id, max(n) AS longest FROM r GROUP BY 1""", "signals")
def m26(spark, d):
    return audit.longest_run(v.signals(spark, d), "session_id", "row_id", F.col("value") > 100)


@query("m31_distribution", "SELECT lang, min(n_chars) AS lowest, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS highest, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def m31(spark, d):
    n = F.col("n_chars")
    return v.table(spark, d, "documents").groupBy("lang").agg(F.min(n).alias("lowest"), F.round(F.median(n), 6).alias("median"), F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95"), F.max(n).alias("highest"), F.round(F.avg(n), 6).alias("mean"))


@query("m19_bootstrap")
def m19(spark, d):
    """The squared error of a seed, with its interval over 400 replicates within labels."""
    p = v.predictions(spark, d).filter("seed = 42 and y is not null").select("session_id", "y", F.expr("(p - y) * (p - y)").alias("loss"))
    return baselines.bootstrap(p, "session_id", "loss", "y", 400, 42)


@query("j14_source_views", "SELECT session_id, round(avg(value) FILTER (WHERE modality = 'audio'), 6) AS audio, round(avg(value) FILTER (WHERE modality = 'visual'), 6) AS visual FROM signals GROUP BY 1 HAVING count(DISTINCT modality) = 2", "signals")
def j14(spark, d):
    s = v.signals(spark, d).groupBy("session_id").pivot("modality", ["audio", "visual"]).agg(F.round(F.avg("value"), 6))
    return s.filter("audio is not null and visual is not null")


@query("j16_fold_cover", """WITH f AS (SELECT doc_id, r.f FROM documents, range(0, 5) r(f) WHERE NOT (doc_id % 11 = 0 AND r.f = 3)) SELECT doc_id, count(DISTINCT f) AS folds, count(*) FILTER (WHERE f = doc_id % 6) AS holdouts FROM f GROUP BY 1
  HAVING count(DISTINCT f) <> 5 OR count(*) FILTER (WHERE f = doc_id % 6) <> 1""")
def j16(spark, d):
    a = v.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")).filter("not (doc_id % 11 = 0 and fold = 3)")
    return audit.fold_cover(a.withColumn("split", F.when(F.expr("fold = doc_id % 6"), "holdout").otherwise("fit")), "doc_id", 5)


@query("j19_grounding", """SELECT session_id, array_to_string(list_filter(list_distinct(supporting), lambda x: x > 'S008').list_sort(), ',') AS unknown, len(list_filter(contradictory, lambda x: NOT contains('S001 S004 S007 S010 S002', x))) = 0 AS named FROM assessments""", "assessments")
def j19(spark, d):
    """Citations outside the available set, and whether all occur in a prompt."""
    known = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.format_string("S%03d", i))
    a = v.assessments(spark, d)
    return a.select("session_id", F.array_join(F.array_sort(audit.unknown_citations(F.col("supporting"), known)), ",").alias("unknown"), audit.named_in(F.col("contradictory"), F.lit("S001 S004 S007 S010 S002")).alias("named"))


@query("d15r_revision_rules", """WITH x AS (SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'preserved' WHEN 1 THEN 'revised' ELSE 'unresolved' END AS s, CASE session_id % 4 WHEN 0 THEN 'risk_unchanged_after_review' WHEN 1 THEN 'risk_increased_after_review' WHEN 2 THEN 'risk_decreased_after_review' ELSE 'insufficient_reliable_detail' END AS m,
    visual_risk - risk AS d, len(list_intersect(supporting, contradictory)) AS n FROM assessments)
  SELECT session_id, CASE s WHEN 'preserved' THEN CASE WHEN abs(d) > 0.05 THEN 'preserved_probability_moved' WHEN m <> 'risk_unchanged_after_review' THEN 'preserved_summary_mismatch' END
    WHEN 'revised' THEN CASE WHEN abs(d) < 0.05 THEN 'revised_probability_unchanged' WHEN m <> CASE WHEN d > 0 THEN 'risk_increased_after_review' ELSE 'risk_decreased_after_review' END THEN 'revised_summary_direction_mismatch' END
    ELSE CASE WHEN m <> 'insufficient_reliable_detail' THEN 'unresolved_summary_mismatch' WHEN n = 0 THEN 'unresolved_without_residual_conflict' END END AS rule FROM x""", "assessments")
def d15r(spark, d):
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("session_id") % n + 1).cast("int"))
    status = pick(3, "preserved", "revised", "unresolved")
    summary = pick(4, "risk_unchanged_after_review", "risk_increased_after_review", "risk_decreased_after_review", "insufficient_reliable_detail")
    rule = audit.revision_inconsistency(status, summary, F.col("visual_risk") - F.col("risk"), F.array_intersect("supporting", "contradictory"))
    return v.assessments(spark, d).select("session_id", rule.alias("rule"))


_EVENTS = {"signup": "agent_opened", "click": "candidates_exposed", "view": "candidates_exposed", "purchase": "evidence_released", "error": "revision_recorded"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _EVENTS.items()) + " ELSE 'agent_closed' END"


@query("l2_ledger_grammar", f"""WITH e AS (SELECT user_id * 1000 + event_id // 100 AS run_id, event_id AS o, {_KIND} AS t FROM events), a AS (SELECT run_id, arg_min(t, o) AS f, max(o) AS e, count(*) FILTER (WHERE t = 'agent_opened') AS op, count(*) FILTER (WHERE t = 'agent_closed') AS cl,
    count(*) FILTER (WHERE t = 'revision_recorded') AS rv, min(o) FILTER (WHERE t = 'agent_closed') AS c, min(o) FILTER (WHERE t = 'revision_recorded') AS r, min(o) FILTER (WHERE t = 'evidence_released') AS rel, max(o) FILTER (WHERE t IN ('candidates_exposed', 'evidence_released')) AS acc FROM e GROUP BY 1)
  SELECT run_id, concat_ws(',', CASE WHEN f <> 'agent_opened' THEN 'not_opened_first' END, CASE WHEN op > 1 THEN 'multiple_opens' END, CASE WHEN cl > 1 THEN 'multiple_closes' END, CASE WHEN c < e THEN 'records_after_close' END, CASE WHEN rv > 1 THEN 'multiple_revisions' END,
    CASE WHEN r IS NOT NULL AND coalesce(rel >= r, true) THEN 'revision_before_release' END, CASE WHEN acc > r THEN 'access_after_revision' END) AS violations FROM a""")
def l2(spark, d):
    e = v.table(spark, d, "events").select(F.expr("user_id * 1000 + event_id div 100").alias("run_id"), F.col("event_id").alias("order_key"), F.expr(_KIND).alias("event_type"))
    return audit.ledger_grammar(e).withColumn("violations", F.array_join("violations", ","))


@query("l6_unlock_once", "SELECT min(event_id) AS event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 2")
def l6(spark, d):
    e = v.table(spark, d, "events")
    return audit.unlock_once(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), "user_id", "event_id").select("event_id", "user_id")


@query("w7_segment_labels", f"""WITH {WINDOWS_SQL}, {ATOMIC_SQL}, {SEGMENT_SQL}, c AS (SELECT session_id, segment_id, count(DISTINCT atomic_id) AS c, min_by(atomic_id, substr(atomic_id, 2)::BIGINT) AS a, max_by(atomic_id, substr(atomic_id, 2)::BIGINT) AS z, max(substr(atomic_id, 2)::BIGINT) - min(substr(atomic_id, 2)::BIGINT) + 1 AS w FROM segmented GROUP BY 1, 2)
  SELECT session_id, segment_id, CASE WHEN c = 1 THEN a WHEN c = w THEN a || ' to ' || z ELSE a || ' to ' || z || ' (' || c || ' refs; exact list in segment plan)' END AS label FROM c""", "signals", "sessions")
def w7_labels(spark, d):
    """G13 over W7: each segment's atomic windows as one label."""
    return selection.id_range(segmented(spark, d), ["session_id", "segment_id"], "atomic_id")
