"""Queries over scored arms, gates, training records and JSON completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.functions import json as js
from lumenlake.operators import bootstraps, metrics, retrieval, training
from lumenlake.operators import evaluation as ev
from lumenlake.plans import views as v
from lumenlake.plans.catalog import query
from lumenlake.sources.scratch import stored

ARMS = ["direct_refer", "two_pass", "query_guided", "agent"]
ARMS_SQL = f"""arms AS (SELECT d.doc_id AS session_id, a::INTEGER AS place, {ARMS}[a + 1] AS arm_id, quality AS label, (d.doc_id * 37 % 101)::DOUBLE / 100 AS initial_probability, (d.doc_id * 53 % 97)::DOUBLE / 96 AS initial_confidence, 0.5::DOUBLE AS threshold,
  ((d.doc_id * 41 + a * 29) % 101)::DOUBLE / 100 AS final_probability, ((d.doc_id * 43 + a * 31) % 97)::DOUBLE / 96 AS final_confidence, (d.doc_id + a) % 7 = 0 AS referred, d.doc_id % 3 <> 0 AS natural_triggered, ((d.doc_id + a) % 3)::BIGINT AS queries,
  ((d.doc_id * 2 + a) % 7)::BIGINT AS atomic_records, ((d.doc_id * 13 + a * 101) % 2400)::BIGINT AS released_tokens, CASE WHEN d.doc_id % 19 = 0 THEN NULL WHEN (d.doc_id + a) % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN d.doc_id % 2 = 0 THEN 'Timeout' END AS error_type, 'revised' AS revision_status
  FROM documents d JOIN labels USING (doc_id), range(0, 4) r(a) WHERE quality IS NOT NULL)"""


def arms(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").filter("quality is not null").withColumn("a", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    names = ", ".join(f"'{a}'" for a in ARMS)
    return rows.selectExpr(
        "doc_id as session_id", "a as place", f"element_at(array({names}), a + 1) as arm_id", "quality as label", "(doc_id * 37 % 101) / 100D as initial_probability", "(doc_id * 53 % 97) / 96D as initial_confidence", "0.5D as threshold",
        "((doc_id * 41 + a * 29) % 101) / 100D as final_probability", "((doc_id * 43 + a * 31) % 97) / 96D as final_confidence", "(doc_id + a) % 7 = 0 as referred", "doc_id % 3 <> 0 as natural_triggered", "(doc_id + a) % 3 as queries",
        "(doc_id * 2 + a) % 7 as atomic_records", "(doc_id * 13 + a * 101) % 2400 as released_tokens", "case when doc_id % 19 = 0 then null when (doc_id + a) % 11 = 0 then 'failed' else 'ok' end as status", "if(doc_id % 2 = 0, 'Timeout', null) as error_type", "'revised' as revision_status",
    )


CLOSED_SQL = f"""{ARMS_SQL}, closed AS (SELECT * EXCLUDE (status, error_type, c) REPLACE (CASE WHEN c THEN initial_probability ELSE final_probability END AS final_probability, CASE WHEN c THEN initial_confidence ELSE final_confidence END AS final_confidence, c OR referred AS referred,
  CASE WHEN c THEN 0 ELSE queries END AS queries, CASE WHEN c THEN 0 ELSE atomic_records END AS atomic_records, CASE WHEN c THEN 0 ELSE released_tokens END AS released_tokens, CASE WHEN arm_id = 'direct_refer' THEN 'direct_refer' WHEN c THEN 'fail_closed_refer' ELSE revision_status END AS revision_status),
  arm_id = 'direct_refer' OR NOT c AS arm_valid, CASE WHEN arm_id = 'direct_refer' THEN NULL WHEN status IS NULL THEN 'initial_assessment_failed' WHEN status <> 'ok' THEN coalesce(error_type, 'unknown_failure') END AS failure_reason FROM (SELECT *, arm_id = 'direct_refer' OR coalesce(status <> 'ok', true) AS c FROM arms))"""
WEIGHTS = {"brier": 0.5, "harm": 0.25, "query": 0.01, "atomic": 0.005, "token": 0.0001, "refer": 0.1}
_CUT = "least(greatest(final_probability, 1e-7), 1 - 1e-7::DOUBLE)"
SCORED_SQL = f"""{CLOSED_SQL}, scored AS (SELECT *, round(-loss - 0.5::DOUBLE * brier - 0.25::DOUBLE * harm::INT - 0.01::DOUBLE * queries - 0.005::DOUBLE * atomic_records - 0.0001::DOUBLE * released_tokens - 0.1::DOUBLE * referred::INT, 9) AS utility FROM (SELECT *, (final_probability - label) ** 2 AS brier, -ln(CASE WHEN label = 1 THEN {_CUT} ELSE 1 - {_CUT} END) AS loss,
  b = label AND NOT referred AND f <> label AS harm, CASE WHEN b = label THEN 'correct' ELSE 'wrong' END || CASE WHEN referred THEN '_referred' WHEN f = label THEN '_to_correct' ELSE '_to_wrong' END AS transition FROM (SELECT *, (initial_probability >= threshold)::INT AS b, (final_probability >= threshold)::INT AS f FROM closed)))"""


def scored(spark, d):
    return ev.scored(ev.fail_closed(arms(spark, d)), WEIGHTS).withColumn("utility", F.round("utility", 9))


@query("v30_fail_closed_arms", f"WITH {CLOSED_SQL} SELECT session_id, arm_id, round(final_probability, 6) AS final_probability, referred, queries, released_tokens, arm_valid, failure_reason, revision_status FROM closed")
def v30(spark, d):
    return ev.fail_closed(arms(spark, d)).select("session_id", "arm_id", F.round("final_probability", 6).alias("final_probability"), "referred", "queries", "released_tokens", "arm_valid", "failure_reason", "revision_status")


@query("v31_scored_view", f"WITH {SCORED_SQL} SELECT session_id, arm_id, transition, harm, round(brier, 6) AS brier, round(utility, 6) AS utility FROM scored")
def v31(spark, d):
    """M11, M14 and V31."""
    return scored(spark, d).select("session_id", "arm_id", "transition", "harm", F.round("brier", 6).alias("brier"), F.round("utility", 6).alias("utility"))


@query("m15_deployed_view", f"WITH {CLOSED_SQL} SELECT session_id, arm_id, round(CASE WHEN natural_triggered THEN final_probability ELSE initial_probability END, 6) AS final_probability, natural_triggered AND referred AS referred, CASE WHEN natural_triggered THEN queries ELSE 0 END AS queries, NOT natural_triggered OR arm_valid AS arm_valid FROM closed")
def m15(spark, d):
    return ev.deployed(ev.fail_closed(arms(spark, d))).select("session_id", "arm_id", F.round("final_probability", 6).alias("final_probability"), "referred", "queries", "arm_valid")


@query("m16_best_scored_arm", f"WITH {SCORED_SQL} SELECT session_id, arm_id, round(utility, 6) AS utility FROM scored QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY utility DESC, harm, referred, released_tokens, atomic_records, place) = 1")
def m16(spark, d):
    return ev.best_arm(scored(spark, d), ARMS).select("session_id", "arm_id", F.round("utility", 6).alias("utility"))


@query("m13_loop_metrics", f"""WITH {SCORED_SQL} SELECT arm_id, count(*) AS participants, round(avg(brier), 6) AS brier, round(avg((NOT referred)::INT), 6) AS coverage, round(count(*) FILTER (WHERE NOT referred AND label = 1 AND final_probability < threshold) / nullif(count(*) FILTER (WHERE NOT referred AND label = 1), 0), 6) AS accepted_fnr,
  count(*) FILTER (WHERE transition = 'wrong_to_correct') - count(*) FILTER (WHERE transition = 'correct_to_wrong') AS net_correction, round(avg(queries), 6) AS mean_queries, round(avg(released_tokens), 6) AS mean_tokens, count(*) FILTER (WHERE NOT arm_valid) AS failures FROM scored GROUP BY 1""")
def m13(spark, d):
    out = ev.loop_metrics(scored(spark, d), ["arm_id"])
    return out.select("arm_id", "participants", *[F.round(c, 6).alias(c) for c in ("brier", "coverage", "accepted_fnr")], "net_correction", F.round("mean_queries", 6).alias("mean_queries"), F.round("mean_tokens", 6).alias("mean_tokens"), "failures")


@query("m18_improvements", f"""WITH {CLOSED_SQL} SELECT session_id, round((initial_probability - label) ** 2 - (final_probability - label) ** 2, 6) AS brier_improvement, round(ln(CASE WHEN label = 1 THEN {_CUT} ELSE 1 - {_CUT} END) - ln(CASE WHEN label = 1 THEN {_CUT.replace('final', 'initial')} ELSE 1 - {_CUT.replace('final', 'initial')} END), 6) AS log_loss_improvement,
  CASE WHEN referred THEN 0 ELSE ((final_probability >= threshold)::INT = label)::INT - ((initial_probability >= threshold)::INT = label)::INT END::DOUBLE AS net_correction FROM closed WHERE arm_id = 'agent'""")
def m18(spark, d):
    out = ev.improvements(ev.fail_closed(arms(spark, d)).filter("arm_id = 'agent'"))
    return out.select("session_id", F.round("brier_improvement", 6).alias("brier_improvement"), F.round("log_loss_improvement", 6).alias("log_loss_improvement"), "net_correction")


@query("m18_paired_bootstrap")
def m18_bootstrap(spark, d):
    rows = ev.improvements(ev.fail_closed(arms(spark, d)).filter("arm_id = 'agent'"))
    return ev.paired_bootstrap(rows, "session_id", ["brier_improvement", "log_loss_improvement", "net_correction"], 5000, 42)


@query("m20_ranking_bootstrap")
def m20(spark, d):
    """The six paired statistics: both curves of two scores and the first's lead."""
    p = v.predictions(spark, d).groupBy("session_id").agg(F.first("y").alias("y"), *[F.max(F.when(F.col("seed") == s, F.col("p"))).alias(f"s{s}") for s in (42, 43)]).filter("y is not null")
    return bootstraps.ranking_intervals(p, "session_id", ["s42", "s43"], 5000, 7)


@query("m23_benefit_gate", f"""WITH {CLOSED_SQL}, i AS (SELECT session_id, arm_id, (initial_probability - label) ** 2 - (final_probability - label) ** 2 AS brier_improvement, ln(CASE WHEN label = 1 THEN {_CUT} ELSE 1 - {_CUT} END) - ln(CASE WHEN label = 1 THEN {_CUT.replace('final', 'initial')} ELSE 1 - {_CUT.replace('final', 'initial')} END) AS log_loss_improvement,
  CASE WHEN referred THEN 0 ELSE ((final_probability >= threshold)::INT = label)::INT - ((initial_probability >= threshold)::INT = label)::INT END::DOUBLE AS net_correction FROM closed),
  f AS (SELECT arm_id, session_id % 10 AS part, avg(brier_improvement) AS b, avg(log_loss_improvement) AS l, avg(net_correction) AS n FROM i GROUP BY 1, 2),
  e AS (SELECT arm_id, avg(b) AS b, avg(l) AS l, quantile_cont(b, 0.025) AS b_low, quantile_cont(l, 0.025) AS l_low, quantile_cont(n, 0.025) AS n_low FROM f GROUP BY 1), s AS (SELECT arm_id, sum(net_correction) AS net FROM i GROUP BY 1)
  SELECT arm_id, b > 0 AND l > 0 AND net > 0 AS point_pass, b_low > 0 AND l_low > 0 AND n_low >= 0 AS uncertainty_pass FROM e JOIN s USING (arm_id)""")
def m23(spark, d):
    """The gate of each arm, with the means of ten parts of the sessions as replicates."""
    names = ["brier_improvement", "log_loss_improvement", "net_correction"]
    closed, out = ev.fail_closed(arms(spark, d)), None
    for arm in ARMS:
        rows = ev.improvements(closed.filter(F.col("arm_id") == arm))
        means = rows.groupBy((F.col("session_id") % 10).alias("part")).agg(*[F.avg(n).alias(n) for n in names])
        q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
        summary = means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("m")) for n in names])).alias("x")).select("x.*").groupBy("statistic").agg(F.avg("m").alias("estimate"), q[0].alias("low"), q[1].alias("high"))
        net = int(rows.agg(F.sum("net_correction")).first()[0] or 0)
        gate = ev.benefit_gate(summary, net).select(F.lit(arm).alias("arm_id"), "point_pass", "uncertainty_pass")
        out = gate if out is None else out.unionByName(gate)
    return out


_AUC_SQL = """auc AS (SELECT seed, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM (SELECT seed, y, rank() OVER (PARTITION BY seed ORDER BY p) + (count(*) OVER (PARTITION BY seed, p) - 1) / 2 AS r FROM preds) GROUP BY 1),
  ap AS (SELECT seed, sum(pos * tp / seen) / sum(pos) AS ap FROM (SELECT seed, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT seed, p, sum(y) AS pos, count(*) AS n FROM preds GROUP BY 1, 2) WINDOW w AS (PARTITION BY seed ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
  base AS (SELECT seed, avg(y) AS prior, avg((p - y) ** 2) AS brier, avg(-ln(CASE WHEN y = 1 THEN greatest(p, 1e-15) ELSE greatest(1 - p, 1e-15) END)) AS loss, max(p) - min(p) AS spread, count(DISTINCT p) AS values FROM preds GROUP BY 1)"""


@query("m21_validity_gate", f"""WITH {_AUC_SQL} SELECT seed, concat_ws(',', CASE WHEN auc <= 0.5 THEN 'roc_auc_above_random' END, CASE WHEN ap <= prior + 0.03 THEN 'average_precision_above_prior' END, CASE WHEN brier >= prior * (1 - prior) THEN 'brier_better_than_prior' END,
  CASE WHEN loss >= -(prior * ln(prior) + (1 - prior) * ln(1 - prior)) THEN 'log_loss_better_than_prior' END, CASE WHEN values < 10 OR spread < 0.05 THEN 'probabilities_not_collapsed' END) AS failed FROM base JOIN auc USING (seed) JOIN ap USING (seed)""", "preds")
def m21(spark, d):
    return ev.validity_gate(v.predictions(spark, d), ["seed"]).select("seed", F.array_join("failed", ",").alias("failed"))


@query("m22_comparison_gate", "SELECT n_nationkey, concat_ws(',', CASE WHEN n_nationkey % 3 = 0 THEN 'brier_strictly_lower' END, CASE WHEN n_nationkey % 5 = 0 THEN 'net_corrected_nonnegative' END) AS failed, n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 AS developmental, n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 AND n_nationkey % 2 = 0 AS confirmatory FROM nation")
def m22(spark, d):
    s = v.table(spark, d, "nation").selectExpr("n_nationkey", "if(n_nationkey % 3 = 0, 0.2D, 0.1D) as new_brier", "0.2D as old_brier", "0.1D as new_log_loss", "0.3D as old_log_loss", "0.7D as new_auc", "0.7D as old_auc", "0.6D as new_ap", "0.5D as old_ap", "if(n_nationkey % 5 = 0, -1, 2) as net_corrected", "if(n_nationkey % 2 = 0, 0.01D, -0.01D) as brier_low")
    return ev.comparison_gate(s).select("n_nationkey", F.array_join("failed", ",").alias("failed"), "developmental", "confirmatory")


@query("m24_seed_spread", "WITH m AS (SELECT session_id % 4 AS fold, seed, avg(p) AS mean, avg((p - y) ** 2) AS brier FROM preds GROUP BY 1, 2) SELECT fold, 'brier' AS statistic, round(avg(brier), 6) AS mean, round(stddev_samp(brier), 6) AS sd FROM m GROUP BY 1 UNION ALL SELECT fold, 'mean', round(avg(mean), 6), round(stddev_samp(mean), 6) FROM m GROUP BY 1", "preds")
def m24(spark, d):
    m = v.predictions(spark, d).groupBy(F.expr("session_id % 4").alias("fold"), "seed").agg(F.avg("p").alias("mean"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    return ev.seed_spread(m, ["fold"], ["mean", "brier"]).select("fold", "statistic", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("m26_memorised", """WITH m AS (SELECT seed, session_id % 5 AS run, y, CASE WHEN session_id % 5 < 2 THEN (2 * y - 1) * 3.0 ELSE p - 0.5 END::DOUBLE AS margin FROM preds), s AS (SELECT seed, run, min(CASE WHEN y = 1 THEN margin ELSE -margin END) AS least, count(*) FILTER (WHERE (CASE WHEN y = 1 THEN margin ELSE -margin END) > 2) AS high, count(*) AS n FROM m GROUP BY 1, 2)
  SELECT seed, run, concat_ws(',', CASE WHEN run = 1 THEN 'roc_auc_is_one' END, CASE WHEN least <= 0 THEN 'margins_positive' END, CASE WHEN high < n - 1 THEN 'margins_above_2' END) AS failed FROM s""", "preds")
def m26(spark, d):
    p = v.predictions(spark, d).selectExpr("seed", "session_id % 5 as run", "y", "if(session_id % 5 < 2, (2 * y - 1) * 3D, p - 0.5D) as margin", "if(session_id % 5 = 1, 0.9D, 1D) as auc", "1D as ap", "1D as ba", "0.05D as loss")
    return ev.memorised(p, ["seed", "run"]).select("seed", "run", F.array_join("failed", ",").alias("failed"))


@query("m27_best_checkpoint", "SELECT l_suppkey AS run, l_orderkey AS step FROM (SELECT l_suppkey, l_orderkey, max(l_discount) AS auc, min(l_tax) AS log_loss FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY auc DESC, log_loss, l_orderkey) = 1")
def m27(spark, d):
    h = v.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("step")).agg(F.max("l_discount").alias("roc_auc"), F.min("l_tax").alias("log_loss"))
    return ev.best_checkpoint(h, ["run"], "step", "roc_auc").select("run", "step")


@query("m28_prior_shift", """WITH RECURSIVE m AS (SELECT (p - 0.4) * 6 AS margin FROM preds), b AS (SELECT 0 AS i, -80.0::DOUBLE AS lo, 80.0::DOUBLE AS hi
  UNION ALL SELECT i + 1, CASE WHEN a <= 0.3 THEN mid ELSE lo END, CASE WHEN a <= 0.3 THEN hi ELSE mid END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, avg(1 / (1 + exp(-(margin + (lo + hi) / 2)))) AS a FROM b, m WHERE i < 60 GROUP BY ALL))
  SELECT round(lo, 6) AS shift, round((SELECT avg(1 / (1 + exp(-(margin + lo)))) FROM m), 9) AS mean_after FROM b WHERE i = 60""", "preds")
def m28(spark, d):
    m = stored(v.predictions(spark, d).select(((F.col("p") - 0.4) * 6).alias("margin")), "margins")  # read in each round
    shift = ev.prior_shift(m, "margin", 0.3)
    return m.agg(F.round(F.lit(shift), 6).alias("shift"), F.round(F.avg(1 / (1 + F.exp(-(F.col("margin") + F.lit(shift))))), 9).alias("mean_after"))


@query("m29_preference_audit", "SELECT l_returnflag AS preference_kind, count(*) AS n, round(avg((l_discount - l_tax > 0)::INT), 6) AS accuracy, round(avg(l_discount - l_tax), 6) AS mean_margin FROM lineitem GROUP BY 1")
def m29(spark, d):
    pairs = v.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("preference_kind"), (F.col("l_discount") - F.col("l_tax")).alias("margin"))
    return ev.preference_audit(pairs, ["preference_kind"]).withColumns({"accuracy": F.round("accuracy", 6), "mean_margin": F.round("mean_margin", 6)})


@query("m30_literacy_gate", "SELECT count(*) AS n, round(avg((o_orderkey % 20 <> 0)::INT), 6) AS valid, round(avg((o_orderkey % 5 <> 0)::INT), 6) AS grounded, 'grounded_rate,exact_rate' AS failed FROM orders")
def m30(spark, d):
    o = v.table(spark, d, "orders")
    a = o.selectExpr("o_orderkey % 20 <> 0 as valid", "o_orderkey % 5 <> 0 as grounded", "o_orderkey % 4 <> 0 as exact")
    return ev.literacy_gate(a, o.count()).select("n", F.round("valid", 6).alias("valid"), F.round("grounded", 6).alias("grounded"), F.array_join("failed", ",").alias("failed"))


@query("v18_secondary_metrics", "SELECT seed, count(*) FILTER (WHERE p >= 0.4 AND y = 1) AS tp, count(*) FILTER (WHERE p < 0.4 AND y = 0) AS tn, round(count(*) FILTER (WHERE p >= 0.4 AND y = 1) / count(*) FILTER (WHERE y = 1), 6) AS sensitivity, round(count(*) FILTER (WHERE p < 0.4 AND y = 0) / count(*) FILTER (WHERE y = 0), 6) AS specificity FROM preds GROUP BY 1", "preds")
def v18(spark, d):
    return ev.sensitivity(v.predictions(spark, d), ["seed"], 0.4).select("seed", "tp", "tn", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query("d18r_preference_loss", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -(l_quantity + 1) / 20 AS c, -(l_discount + 0.02) * 10 AS r FROM lineitem), o AS (SELECT *, c - ln(1 - exp(c)) - (r - ln(1 - exp(r))) AS lead FROM x)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-c + 0.1 * (greatest(-lead, 0) + ln(1 + exp(-abs(lead)))), 6) AS loss FROM o""")
def d18r(spark, d):
    x = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (-(F.col("l_quantity") + 1) / 20).alias("c"), (-(F.col("l_discount") + 0.02) * 10).alias("r"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(ev.preference_loss(F.col("c"), F.col("r"), 0.1), 6).alias("loss"))


DRAFT_SQL = "SELECT session_id, quality AS label, risk AS probability, CASE WHEN session_id % 9 = 0 THEN 0.5 ELSE 0.4 END AS threshold FROM assessments JOIN labels ON session_id = doc_id WHERE quality IS NOT NULL"


def drafts(spark, d):
    a = v.assessments(spark, d).join(v.table(spark, d, "labels"), F.col("session_id") == F.col("doc_id")).filter("quality is not null")
    return a.selectExpr("session_id", "quality as label", "risk as probability", "if(session_id % 9 = 0, 0.5D, 0.4D) as threshold", "if(session_id % 4 = 0, 'test', 'train') as split", "'m' as model", "'full' as view", "'participant_oof' as prediction_origin", "visual_risk as visual", "coalesce(audio_risk, 0.5D) as audio")


@query("d1r_frozen_drafts", f"WITH d AS ({DRAFT_SQL}) SELECT session_id, label, round(probability, 6) AS probability FROM d WHERE session_id % 4 <> 0", "assessments")
def d1r(spark, d):
    return training.frozen_drafts(drafts(spark, d), "train", "m", "full").select("session_id", "label", F.round("probability", 6).alias("probability"))


@query("d1r_draft_violations", f"""WITH d AS ({DRAFT_SQL}), x AS (SELECT count(DISTINCT if(session_id % 9 = 0, 0.5, 0.4)) AS t, count(DISTINCT label) AS l, count(*) - count(DISTINCT session_id) AS r FROM d)
  SELECT 'repeated_session' AS reason FROM x WHERE r > 0 UNION ALL SELECT 'several_thresholds' FROM x WHERE t <> 1 UNION ALL SELECT 'one_class' FROM x WHERE l <> 2""", "assessments")
def d1r_violations(spark, d):
    return training.draft_violations(drafts(spark, d))


def segment_lines(spark, d):
    rows = v.assessments(spark, d).select("session_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    line = F.expr("""concat('SEGMENT ', format_string('S%03d', i), ' | time 0 to 1 seconds | audio: valid coverage ', (session_id * 7 + i * 13) % 101, ' percent; percentile ', (session_id * 5 + i * 11) % 100, '; percentile 50 | ',
        if((session_id + i) % 6 = 0, 'visual: unavailable', concat('VISUAL summary; coverage ', (session_id * 3 + i * 17) % 101, ' percent, percentile ', (session_id * 11 + i * 7) % 100)))""")
    return rows.select("session_id", line.alias("value")).unionByName(rows.filter("i = 0").select("session_id", F.lit("SESSION EVIDENCE").alias("value")))


SIGNAL_SQL = """sig AS (SELECT session_id, printf('S%03d', i) AS segment_id, ((session_id * 7 + i * 13) % 101)::DOUBLE / 100 AS audio_reliability, CASE WHEN (session_id + i) % 6 = 0 THEN 0 ELSE ((session_id * 3 + i * 17) % 101)::DOUBLE / 100 END AS visual_reliability,
  abs((session_id * 5 + i * 11) % 100 - 50)::DOUBLE / 50 AS audio_salience, CASE WHEN (session_id + i) % 6 = 0 THEN 0 ELSE abs((session_id * 11 + i * 7) % 100 - 50)::DOUBLE / 50 END AS visual_salience FROM assessments, range(0, 6) r(i))"""


@query("d2r_segment_signals", f"WITH {SIGNAL_SQL} SELECT session_id, segment_id, round(audio_reliability, 6) AS audio_reliability, round(visual_reliability, 6) AS visual_reliability, round(audio_salience, 6) AS audio_salience, round(visual_salience, 6) AS visual_salience FROM sig", "assessments")
def d2r(spark, d):
    s = training.segment_signals(segment_lines(spark, d))
    return s.select("session_id", "segment_id", *[F.round(c, 6).alias(c) for c in ("audio_reliability", "visual_reliability", "audio_salience", "visual_salience")])


@query("d3r_weak_targets", f"""WITH {SIGNAL_SQL}, d AS ({DRAFT_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY audio_salience DESC, segment_id DESC) AS a, row_number() OVER (PARTITION BY session_id ORDER BY visual_salience DESC, segment_id DESC) AS v FROM sig),
  g AS (SELECT session_id, list(segment_id ORDER BY a) FILTER (WHERE a <= 2) AS la, list(segment_id ORDER BY v) FILTER (WHERE v <= 2) AS lv, avg(audio_reliability) AS ra, avg(visual_reliability) AS rv FROM r GROUP BY 1),
  x AS (SELECT d.*, g.*, coalesce(audio_risk, 0.5) AS audio, visual_risk AS visual, CASE WHEN probability <= 0 OR probability >= 1 THEN 0 ELSE -(probability * log2(probability) + (1 - probability) * log2(1 - probability)) END AS h FROM d JOIN g USING (session_id) JOIN assessments USING (session_id))
  SELECT session_id, round(greatest(0.01, least(0.99, (1 - h) * (0.5 + 0.5 * (ra + rv) / 2))), 6) AS confidence, array_to_string(CASE WHEN (audio >= threshold) = (probability >= threshold) THEN la ELSE [] END || CASE WHEN (visual >= threshold) = (probability >= threshold) THEN list_filter(lv, lambda y: NOT ((audio >= threshold) = (probability >= threshold) AND list_contains(la, y))) ELSE [] END, ',') AS supporting FROM x""", "assessments")
def d3r(spark, d):
    t = training.weak_targets(drafts(spark, d), training.segment_signals(segment_lines(spark, d)))
    return t.select("session_id", F.round("confidence", 6).alias("confidence"), F.array_join("supporting", ",").alias("supporting"))


def sessions_of(spark, d):
    x = drafts(spark, d)
    target = training.transition_target(F.col("label"), F.col("probability"), F.col("threshold"), F.col("session_id") % 5 == 0)
    return x.select("session_id", target.alias("transition"), "label", F.col("probability").alias("initial"), "threshold", F.array(F.lit("E0001"), F.lit("E0002")).alias("cited"), F.array(F.lit("S001")).alias("segments"))


_TARGET_SQL = "CASE WHEN (probability >= threshold)::INT = label THEN 'CC_preserve' WHEN session_id % 5 = 0 THEN 'WW_refer' ELSE 'WC_revise' END"


@query("d5r_preferences", f"""WITH d AS ({DRAFT_SQL}), t AS (SELECT *, {_TARGET_SQL} AS transition FROM d), c AS (SELECT *, CASE transition WHEN 'CC_preserve' THEN 'preserved' WHEN 'WC_revise' THEN 'revised' ELSE 'unresolved' END AS status,
  CASE WHEN transition <> 'WC_revise' THEN probability WHEN label = 1 THEN least(0.95, greatest(threshold + 0.10, threshold + (1 - threshold) * 0.65)) ELSE greatest(0.05, least(threshold - 0.10, threshold * 0.35)) END AS p FROM t)
  SELECT session_id, preference_kind, transition, status AS chosen_status, round(p, 6) AS chosen_probability, CASE preference_kind WHEN 'hallucinated_evidence' THEN 'E999999,E0002' WHEN 'unsupported_change' THEN '' ELSE 'E0001,E0002' END AS rejected_cited,
  CASE preference_kind WHEN 'state_action' THEN CASE WHEN transition = 'WC_revise' THEN 'preserved' ELSE 'revised' END WHEN 'unsupported_change' THEN 'revised' ELSE status END AS rejected_status FROM c, (VALUES ('state_action'), ('hallucinated_evidence'), ('inconsistent_summary'), ('unsupported_change')) k(preference_kind)""", "assessments")
def d5r(spark, d):
    p = training.preferences(sessions_of(spark, d))
    return p.select("session_id", "preference_kind", "transition", F.col("chosen.revision_status").alias("chosen_status"), F.round("chosen.revised_risk_probability", 6).alias("chosen_probability"), F.array_join("rejected.cited_evidence_ids", ",").alias("rejected_cited"), F.col("rejected.revision_status").alias("rejected_status"))


@query("d6r_sample_weights", f"WITH d AS ({DRAFT_SQL}) SELECT session_id, CASE WHEN label = 1 AND probability < threshold THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM d", "assessments")
def d6r(spark, d):
    return drafts(spark, d).select("session_id", training.sample_weight(F.col("label"), F.col("probability"), F.col("threshold")).alias("weight"))


@query("d7r_without_holdout", "SELECT o_custkey AS session_id, 'kept' AS what, count(*) AS n FROM orders WHERE o_custkey % 4 <> 1 GROUP BY 1 UNION ALL SELECT o_custkey, 'excluded', count(*) FROM orders WHERE o_custkey % 4 = 1 GROUP BY 1")
def d7r(spark, d):
    r = v.table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"))
    kept, log = training.without_holdout(r, r.filter("session_id % 4 = 1"))
    return kept.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit("kept").alias("what"), "n").unionByName(log.select("session_id", F.lit("excluded").alias("what"), F.col("records").alias("n")))


@query("d8r_best_scores", f"WITH {SCORED_SQL} SELECT session_id, arm_id FROM scored WHERE arm_id <> 'direct_refer' AND arm_valid AND NOT referred QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY utility DESC, released_tokens, atomic_records, place) = 1")
def d8r(spark, d):
    return training.best_score(scored(spark, d), ARMS, ~F.col("referred")).select("session_id", "arm_id")


@query("d10r_session_budget", f"""WITH d AS ({DRAFT_SQL}), p AS (SELECT session_id, preference_kind, i FROM d, (VALUES ('state_action', -1), ('hallucinated_evidence', 0), ('inconsistent_summary', 1), ('unsupported_change', 2)) k(preference_kind, i)), h AS (SELECT *, sha256('42:' || session_id) AS s FROM p),
  m AS (SELECT *, i < 0 OR (('0x' || substr(s, 9, 8))::BIGINT / 4294967295 < 0.5 AND (i - ('0x' || substr(s, 1, 8))::BIGINT % 3 + 3) % 3 < 1) AS keep FROM h), b AS (SELECT preference_kind FROM m GROUP BY 1 HAVING NOT bool_or(keep))
  SELECT session_id, preference_kind FROM m WHERE keep UNION ALL SELECT min(session_id), preference_kind FROM m JOIN b USING (preference_kind) GROUP BY 2""", "assessments")
def d10r(spark, d):
    p = training.preferences(sessions_of(spark, d)).select("session_id", "preference_kind")
    return training.within_session_budget(p, 2, 0.5, 42)


@query("d14r_record_violations", """SELECT s_suppkey || ':a' AS key, 'ungrounded' AS reason FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey || ':a', 'equal_texts' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'WW_refer', 'missing_stratum'""")
def d14r(spark, d):
    r = v.table(spark, d, "supplier").selectExpr("s_suppkey as session_id", "'a' as preference_kind", "if(s_suppkey % 2 = 0, 'CC_preserve', 'WC_revise') as transition", "'see E0001' as prompt", "array(if(s_suppkey % 4 = 0, 'E0002', 'E0001')) as cited", "'x' as chosen", "if(s_suppkey % 3 = 0, 'x', 'y') as rejected")
    return training.record_violations(r, list(training.TRANSITIONS))


@query("d15r_outcomes", f"WITH d AS ({DRAFT_SQL}), t AS (SELECT *, {_TARGET_SQL} AS transition, ['preserved', 'revised', 'unresolved'][session_id % 3 + 1] AS status FROM d) SELECT session_id, CASE transition WHEN 'WW_refer' THEN status = 'unresolved' WHEN 'CC_preserve' THEN status = 'preserved' AND (probability >= threshold)::INT = label ELSE status = 'revised' AND (probability >= threshold)::INT = label END AS correct FROM t", "assessments")
def d15r(spark, d):
    s = sessions_of(spark, d).withColumn("status", F.expr("element_at(array('preserved', 'revised', 'unresolved'), cast(session_id % 3 + 1 as int))"))
    c = F.col
    return s.select("session_id", training.outcome_is_correct(c("status"), c("initial"), c("threshold"), c("label"), c("transition")).alias("correct"))


@query("d16r_refresh_gate", f"WITH d AS ({DRAFT_SQL}), t AS (SELECT *, {_TARGET_SQL} AS transition, session_id % 3 = 0 AS accepted FROM d WHERE session_id % 5 <> 0) SELECT count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted, greatest(12, ceil(count(*) * 0.15))::INTEGER AS required, 'WW_refer' AS missing, false AS passed FROM t", "assessments")
def d16r(spark, d):
    return training.refresh_gate(sessions_of(spark, d).filter("session_id % 5 <> 0").select("transition", F.expr("session_id % 3 = 0").alias("accepted")))


@query("d17r_refreshed", "SELECT s_suppkey AS session_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS chosen FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL (SELECT s_suppkey, 'old' FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_suppkey LIMIT greatest(0, 50 - (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0)))")
def d17r(spark, d):
    p = v.table(spark, d, "supplier").selectExpr("s_suppkey as session_id", "'a' as preference_kind", "'old' as chosen", "'r' as rejected")
    return training.refreshed(p, p.filter("session_id % 3 = 0").select("session_id", F.lit("new").alias("text")), 50).select("session_id", "chosen")


@query("d19r_tiers", "SELECT o_orderkey AS session_id, CASE WHEN o_totalprice <= 200000 THEN 'full' WHEN o_totalprice / 2 <= 200000 THEN 'standard' ELSE 'minimal' END AS tier FROM orders")
def d19r(spark, d):
    return training.first_tier_that_fits(v.table(spark, d, "orders").selectExpr("o_orderkey as session_id", "o_totalprice as full", "o_totalprice / 2 as standard", "0D as minimal"), ["full", "standard", "minimal"], 200000)


@query("d20r_entry_gate", "SELECT n_nationkey, concat_ws(',', CASE WHEN n_nationkey < 10 THEN 'trajectory_pool_at_least_5000' END, 'reward_variance_ratio_at_least_0_60', CASE WHEN n_nationkey % 2 = 0 THEN 'rule_reward_audit_passed' END) AS failed FROM nation")
def d20r(spark, d):
    return v.table(spark, d, "nation").select("n_nationkey", F.array_join(training.entry_gate(F.col("n_nationkey") * 500, F.lit(None).cast("double"), F.col("n_nationkey") % 2 == 1, F.lit(True)), ",").alias("failed"))


@query("d21r_literacy_rows", "SELECT s_suppkey AS session_id, 'query' AS kind, 'i' AS prompt, 'q' AS answer FROM supplier UNION ALL SELECT s_suppkey, 'selection', 'q' || chr(10) || 'c', '[\"E1\"]' FROM supplier")
def d21r(spark, d):
    c = v.table(spark, d, "supplier").selectExpr("s_suppkey as session_id", "'i' as item", "'q' as query", "array('c') as cards", "array('E1') as picked")
    return training.literacy_rows(c).select("session_id", "kind", "prompt", "answer")


@query("d22r_routes", "SELECT n_nationkey AS fold, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'adapter' || n_nationkey ELSE 'fallback' END AS route FROM nation")
def d22r(spark, d):
    n = v.table(spark, d, "nation")
    return training.reviewer_routes(n.selectExpr("n_nationkey as fold", "n_nationkey % 2 = 0 as passed"), n.filter("n_nationkey % 3 = 0").selectExpr("n_nationkey as fold", "concat('adapter', n_nationkey) as adapter"))


@query("d23r_capability_split", "SELECT doc_id AS session_id, quality AS label FROM labels WHERE doc_id IS NOT NULL")
def d23r(spark, d):
    rows = v.table(spark, d, "labels").filter("doc_id is not null").selectExpr("doc_id as session_id", "quality as label", "toxic as other")
    seen, outcome = training.capability_split(rows, ["label"])
    assert seen.columns == ["session_id", "other"]
    return outcome


@query("d24r_freeze_violations", f"WITH {ARMS_SQL} SELECT DISTINCT session_id, CASE WHEN session_id % 6 = 0 THEN 'arms_differ' ELSE 'anchors_differ' END AS reason FROM arms WHERE session_id % 6 = 0 OR session_id % 7 = 0")
def d24r(spark, d):
    a = arms(spark, d).filter("not (session_id % 6 = 0 and place = 2)").withColumn("initial_probability", F.expr("if(session_id % 7 = 0 and place = 1, 2D, initial_probability)"))
    return training.freeze_violations(a, ARMS)


@query("d25r_crossfit_rows", f"WITH d AS ({DRAFT_SQL}) SELECT session_id, round(CASE WHEN session_id % 3 = 0 THEN probability ELSE 0.9 END, 6) AS final_probability, session_id % 3 = 0 AS referred, session_id % 3 <> 0 AS arm_valid FROM d", "assessments")
def d25r(spark, d):
    e = drafts(spark, d).select("session_id", F.col("probability").alias("initial_probability"))
    got = e.filter("session_id % 3 <> 0").select("session_id", F.lit(0.9).alias("final_probability"), F.lit(False).alias("referred"))
    return training.crossfit_rows(e, got).withColumn("final_probability", F.round("final_probability", 6))


@query("d26r_prompts", "SELECT doc_id, 'TASK' || chr(10) || 'judge' || chr(10) || chr(10) || 'SOURCE' || chr(10) || source AS prompt FROM documents")
def d26r(spark, d):
    return v.table(spark, d, "documents").select("doc_id", training.prompt({"TASK": F.lit(" judge "), "EVIDENCE": F.lit(" "), "SOURCE": F.col("source")}).alias("prompt"))


@query("d27r_report_rows", "SELECT n_nationkey, r_name, count(c_custkey) AS customers FROM nation LEFT JOIN region ON r_regionkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def d27r(spark, d):
    n = v.table(spark, d, "nation").select("n_nationkey")
    region = v.table(spark, d, "region").selectExpr("r_regionkey as n_nationkey", "r_name")
    customers = v.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return training.report_rows(n, {"region": region, "own": customers}, "n_nationkey").select("n_nationkey", "region.r_name", F.coalesce("own.customers", F.lit(0)).alias("customers"))


@query("d28r_session_audit", "SELECT doc_id AS session_id, (doc_id % 4 <> 0)::BIGINT AS units, (doc_id % 6 <> 0)::BIGINT AS texts, CASE WHEN doc_id % 4 = 0 THEN 'no_units' WHEN doc_id % 6 = 0 THEN 'no_text' END AS error FROM documents")
def d28r(spark, d):
    s = v.table(spark, d, "documents").select(F.col("doc_id").alias("session_id"))
    return training.session_audit(s, s.filter("session_id % 4 <> 0"), s.filter("session_id % 6 <> 0"))


@query("d29r_header_audit", "SELECT n_nationkey AS session_id, CASE WHEN n_nationkey % 2 = 0 THEN 'success' ELSE '' END AS errors, 'au04_r' AS warnings FROM nation")
def d29r(spark, d):
    h = v.table(spark, d, "nation").selectExpr("n_nationkey as session_id", "if(n_nationkey % 2 = 0, array(' Timestamp'), array('timestamp', 'SUCCESS ')) as columns")
    return training.header_audit(h, ["timestamp", "success"], ["au04_r"])


@query("x7_completions", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a": ' || doc_id || '}' WHEN 1 THEN '{"a": {"b": "}"}}' END AS parsed FROM documents""")
def x7(spark, d):
    raw = F.expr("""case doc_id % 4 when 0 then concat('```json\n{"a": ', doc_id, '}\n```') when 1 then ' {"a": {"b": "}"}} ' when 2 then '{"a": 1} and more' else '[1]' end""")
    return v.table(spark, d, "documents").select("doc_id", js.completion(raw).alias("parsed"))


@query("x8_leading_objects", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a": {"b": "}{"}}' WHEN 1 THEN '{}' END AS parsed FROM documents""")
def x8(spark, d):
    raw = F.expr("""case doc_id % 4 when 0 then ' {"a": {"b": "}{"}} and {"c": 1}' when 1 then '{}' when 2 then 'well {"a": 1}' else '{"a": 1' end""")
    return v.table(spark, d, "documents").select("doc_id", js.leading_object(raw).alias("parsed"))


@query("p16_label_keys", "SELECT doc_id, doc_id % 5 < 3 AS names_label FROM documents")
def p16(spark, d):
    raw = F.expr("""concat('{"a": [{"', element_at(array('Ground-Truth', 'y_true', 'PHQ-9', 'text', 'labelled'), cast(doc_id % 5 + 1 as int)), '": "label"}]}')""")
    return v.table(spark, d, "documents").select("doc_id", js.names_label(raw).alias("names_label"))


@query("p20_strict_keys", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE '' END AS missing, CASE WHEN doc_id % 3 = 0 THEN 'z' ELSE '' END AS extra FROM documents")
def p20(spark, d):
    diff = js.key_differences(F.expr("""concat('{"a": 1', if(doc_id % 2 = 0, '', ', "b": 2'), if(doc_id % 3 = 0, ', "z": 2', ''), '}')"""), ["a", "b"])
    return v.table(spark, d, "documents").select("doc_id", F.array_join(diff["missing"], ",").alias("missing"), F.array_join(diff["extra"], ",").alias("extra"))


@query("p21_unit_numbers", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS value FROM documents")
def p21(spark, d):
    raw = F.expr("""concat('{"q": {"p": "x"}, "p": ', element_at(array('0.25', '1', 'true', '1.5', '"0.5"'), cast(doc_id % 5 + 1 as int)), '}')""")
    return v.table(spark, d, "documents").select("doc_id", js.unit_number(raw, "p").alias("value"))


@query("x12_source_problems", "SELECT session_id, CASE WHEN session_id % 11 = 0 THEN 'unknown_status' WHEN audio_risk IS NULL AND session_id % 2 = 0 THEN 'value_out_of_range' WHEN audio_risk IS NOT NULL AND session_id % 2 = 1 THEN 'value_of_unavailable_source' END AS problem FROM assessments", "assessments")
def x12(spark, d):
    status = F.expr("case when session_id % 11 = 0 then 'maybe' when session_id % 2 = 0 then 'available' else 'unavailable' end")
    return v.assessments(spark, d).select("session_id", js.source_problem(status, F.col("audio_risk"), F.col("audio_rel")).alias("problem"))


@query("x12_task_problems", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'bad_task_id' WHEN n_nationkey % 4 = 1 THEN 'equal_label_names' WHEN n_nationkey % 4 = 2 THEN 'bad_definition' END AS problem FROM nation")
def x12_tasks(spark, d):
    return v.table(spark, d, "nation").select("n_nationkey", js.task_problem(F.expr("if(n_nationkey % 4 = 0, '-x', 'task.1')"), F.expr("if(n_nationkey % 4 = 2, 'a\nb', 'what')"), F.lit("No"), F.expr("if(n_nationkey % 4 = 1, 'NO', 'yes')")).alias("problem"))


@query("x10_id_keys", "SELECT session_id, utterance_id, 'T' AS prefix, utterance_id AS number FROM utterances", "utterances")
def x10(spark, d):
    k = js.id_key(F.format_string("T%03d", "utterance_id"))
    return v.utterances(spark, d).select("session_id", "utterance_id", k["prefix"].alias("prefix"), k["number"].alias("number"))


@query("x9_ordered_ids", "SELECT session_id, array_to_string(list_distinct_ordered, ',') AS ids FROM (SELECT session_id, list_filter([supporting[1], contradictory[1], supporting[2]], lambda x, i: x IS NOT NULL AND list_position([supporting[1], contradictory[1], supporting[2]], x) = i) AS list_distinct_ordered FROM assessments)", "assessments")
def x9(spark, d):
    """X9 and V51."""
    one = lambda c, i: F.get(F.col(c), F.lit(i))
    ids = F.array(F.concat(F.lit(" "), one("supporting", 0)), one("contradictory", 0), one("supporting", 1), F.lit(" "))
    return v.assessments(spark, d).select("session_id", F.array_join(js.ordered_ids(ids), ",").alias("ids"))


@query("q9_candidate_limits", "SELECT o_orderkey, least(8, o_orderkey % 20, greatest(2 * (o_orderkey % 5), o_orderkey % 5 + 2)) AS candidates FROM orders")
def q9(spark, d):
    n, b = F.col("o_orderkey") % 20, F.col("o_orderkey") % 5
    return v.table(spark, d, "orders").select("o_orderkey", retrieval.candidate_limit(F.lit(8).cast("long"), n, b).alias("candidates"))


@query("m1_by_quality", "SELECT seed, round(avg((p >= 0.5)::INT), 6) AS share FROM preds GROUP BY 1", "preds")
def m1_share(spark, d):
    c = metrics.confusion(v.predictions(spark, d), ["seed"], 0.5)
    return c.select("seed", F.round((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("share"))
