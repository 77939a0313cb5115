"""Queries over composite session views and reuse decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import composites, evidence, records
from lumenlake.plans import views as v
from lumenlake.plans.catalog import query
from lumenlake.plans.evidence import AGGREGATED_SQL, CUED_SQL, PROJECTED_SQL, aggregated, projected
from lumenlake.plans.files import as_text, cells
from lumenlake.sources import files, sessions
from lumenlake.sources.scratch import scratch


def talk_segments(spark, d):
    return v.talk(spark, d).withColumn("segment_id", F.format_string("S%03d", F.expr("cast(utterance_id div 4 as int)")))


@query("v1_overview", f"""WITH {CUED_SQL}, s AS (SELECT DISTINCT session_id, utterance_id // 4 AS n FROM talk), c AS (SELECT session_id, n, string_agg(family || ': ' || k, '; ' ORDER BY family || ': ' || k) AS c FROM (SELECT session_id, utterance_id // 4 AS n, family, count(*) AS k FROM (SELECT session_id, utterance_id, unnest(cues) AS family FROM cued) GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT session_id, n AS segment_no, 'SEGMENT ' || printf('S%03d', n) || chr(10) || 'Audio: line' || chr(10) || coalesce('Cues: ' || c, 'Cues: none') AS text FROM s LEFT JOIN c USING (session_id, n)""", "utterances", "talk")
def v1(spark, d):
    t = talk_segments(spark, d)
    s = t.select("session_id", "segment_id", F.expr("utterance_id div 4").alias("segment_no")).distinct()
    return composites.overview(s, s.select("session_id", "segment_id", F.lit("Audio: line").alias("line")), t)


@query("v2_review", "SELECT session_id, count(*) FILTER (WHERE k = 'a' AND i % 3 <> 0) AS new_atoms, count(*) FILTER (WHERE k = 'u' AND i % 2 = 0) AS new_utterances, (count(*) FILTER (WHERE k = 'a' AND i % 3 <> 0) + count(*) FILTER (WHERE k = 'u' AND i % 2 = 0) > 0)::INT::DOUBLE AS novelty FROM (SELECT session_id, 'a' AS k, atomic_no AS i FROM units WHERE modality = 'audio' UNION ALL SELECT session_id, 'u', utterance_id FROM utterances WHERE session_id IN (SELECT session_id FROM units)) GROUP BY 1", "units", "utterances")
def v2(spark, d):
    a = v.units(spark, d).filter("modality = 'audio'").select("session_id", F.col("atomic_no").alias("atomic_id"))
    u = v.utterances(spark, d)
    return composites.review(a, a, u, a.filter("atomic_id % 3 = 0"), u.filter("utterance_id % 2 = 1"))


@query("v4_transcript_detail", "SELECT session_id, utterance_id, CASE speaker_role WHEN 'unassigned' THEN 'speaker' ELSE speaker_role END || ': ' || text AS line FROM (SELECT * REPLACE ('say ' || utterance_id AS text) FROM talk) WHERE utterance_id % 2 = 0", "utterances", "talk")
def v4(spark, d):
    t = v.talk(spark, d).withColumn("text", F.concat(F.lit("say "), F.col("utterance_id").cast("string")))
    t = t.withColumn("segment_no", F.col("utterance_id"))
    return composites.transcript_detail(t, t.filter("utterance_id % 2 = 1"), ["session_id", "segment_no"], 1, 80).select("session_id", "utterance_id", "line")


@query("v5_loaded_utterances", "SELECT session_id, utterance_id, row_number() OVER (PARTITION BY session_id ORDER BY start_sec, utterance_id)::INTEGER AS place FROM talk WHERE speaker_role = 'participant'", "utterances", "talk")
def v5(spark, d):
    t = v.talk(spark, d).withColumn("sha256", F.sha2("text", 256))
    return composites.loaded_utterances(t, "participant", F.col("sha256")).select("session_id", "utterance_id", "place")


@query("v6_targeted", "WITH c AS (SELECT session_id, segment_id, atomic_no FROM units WHERE modality = 'audio' QUALIFY row_number() OVER (PARTITION BY session_id, segment_id ORDER BY atomic_no) <= 2) SELECT session_id, segment_id, string_agg('line ' || unit_id, chr(10) ORDER BY atomic_no, unit_id) AS text FROM c JOIN units USING (session_id, segment_id, atomic_no) GROUP BY 1, 2", "units")
def v6(spark, d):
    u = v.units(spark, d)
    atoms = u.filter("modality = 'audio'").select("session_id", "segment_id", "atomic_no", "start_sec", F.col("start_sec").alias("mid"))
    chosen = composites.ordered_atoms(atoms).filter("place <= 2").select("session_id", "segment_id", "atomic_no")
    return composites.targeted(chosen, u.select("session_id", "atomic_no", "unit_id", F.concat(F.lit("line "), F.col("unit_id").cast("string")).alias("line")))


@query("v8_ordered_atoms", "SELECT session_id, atomic_no, row_number() OVER (PARTITION BY session_id, segment_id ORDER BY start_sec, atomic_no)::INTEGER AS place FROM units WHERE modality = 'audio'", "units")
def v8(spark, d):
    a = v.units(spark, d).filter("modality = 'audio'").select("session_id", "segment_id", "atomic_no", "start_sec", F.col("start_sec").alias("mid"))
    return composites.ordered_atoms(a).select("session_id", "atomic_no", "place")


@query("v9_atomic_records", f"WITH {PROJECTED_SQL} SELECT session_id, atomic_no, count(*) FILTER (WHERE status = 'measured') AS measured, count(DISTINCT u.source_id)::INTEGER AS sources FROM units u JOIN projected p USING (unit_id) GROUP BY 1, 2", "units", "observations")
def v9(spark, d):
    r = composites.atomic_records(projected(spark, d), v.units(spark, d))
    return r.select("session_id", "atomic_no", F.size(F.regexp_extract_all("record", F.lit('"status":"(measured)"'), 1)).cast("long").alias("measured"), F.size(F.from_json("record", "sources array<struct<source_id:string>>")["sources"]).alias("sources"))


@query("v10_segment_records", f"WITH {AGGREGATED_SQL} SELECT session_id, segment_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) FILTER (WHERE source_id LIKE '%audio') AS audio, count(*) AS slots FROM slotted GROUP BY 1, 2", "units", "observations")
def v10(spark, d):
    r = composites.segment_records(aggregated(spark, d), F.when(F.col("source_id").endswith("audio"), "audio").otherwise("visual"))
    s = F.from_json("record", "sources array<struct<source_id:string,slots:array<struct<slot_id:string>>>>")["sources"]
    rows = r.select("session_id", "segment_id", s.alias("s"))
    audio = F.filter("s.source_id", lambda x: x.endswith("audio"))
    return rows.select("session_id", "segment_id", F.when(F.size(audio) > 0, F.array_join(audio, ",")).alias("audio"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.size(x["slots"])).alias("slots"))


@query("v13_transcript_summary", "SELECT count(DISTINCT session_id) AS sessions, count(*) AS utterances, count(*) FILTER (WHERE privacy_scrubbed) AS scrubbed, sum(length(text))::BIGINT AS characters, sum(end_sec - start_sec) AS seconds FROM talk", "utterances", "talk")
def v13(spark, d):
    return composites.transcript_summary(v.talk(spark, d))[1]


@query("v16_listed_sessions", "SELECT DISTINCT o_custkey::VARCHAR AS session_id FROM orders")
def v16(spark, d):
    return composites.listed_sessions(v.table(spark, d, "orders").select(F.explode(F.expr("array(concat('/d/', o_custkey, '_acoustic.npy'), concat('/d/', o_custkey, '_visual.npy'), '/d/readme')")).alias("path")), r"/([^/]+)_acoustic\.npy$")


@query("v23_prepared_files", "SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'rows_differ' ELSE 'digest_differs' END AS reason FROM nation WHERE n_nationkey % 3 <> 1 UNION ALL SELECT 'test' || n_nationkey, 'label_shown' FROM nation")
def v23(spark, d):
    n = v.table(spark, d, "nation")
    rows = n.selectExpr("n_name as name", "array('session_id', 'Target') as columns", "1 as rows", "if(n_nationkey % 3 = 0, 2, 1) as expected_rows", "'a' as sha256", "if(n_nationkey % 3 = 2, 'b', 'a') as expected_sha256")
    return composites.prepared_violations(rows.unionByName(n.selectExpr("concat('test', n_nationkey) as name", "array(' Target') as columns", "1 as rows", "1 as expected_rows", "'a' as sha256", "'a' as expected_sha256")), ["target", "label"])


@query("v25_metadata", "SELECT n_nationkey AS run_id, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown_reference' ELSE 'protocol_differs' END AS reason FROM nation WHERE n_nationkey % 4 < 2")
def v25(spark, d):
    runs = v.table(spark, d, "nation").selectExpr("n_nationkey as run_id", "if(n_nationkey % 4 = 0, 'x', 'r') as reference_id", "if(n_nationkey % 4 = 1, 'old', 'native') as protocol")
    return composites.metadata_violations(runs, spark.createDataFrame([("r", "native")], "reference_id string, protocol string"))


@query("v29_fold_assignment", "SELECT CASE WHEN doc_id % 5 = 2 THEN 'holdout' ELSE 'fit' END AS role, quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1, 2")
def v29(spark, d):
    folds = v.table(spark, d, "labels").filter("quality is not null").selectExpr("doc_id as session_id", "doc_id % 5 as fold", "quality as label")
    roles, counts = composites.fold_assignment(folds, 2)
    assert roles.columns == ["session_id", "role"]
    return counts


@query("v34_arms_to_run", "SELECT o_orderkey AS session_id, o_orderkey % 3 <> 0 AS reused FROM orders")
def v34(spark, d):
    p = v.table(spark, d, "orders").selectExpr("o_orderkey as session_id", "'agent' as arm_id", "'new' as plan_sha256")
    stored = p.withColumn("plan_sha256", F.expr("if(session_id % 3 = 0, 'old', 'new')"))
    run, reused = composites.to_run(p, stored, ["plan_sha256"])
    return run.select("session_id", F.lit(False).alias("reused")).unionByName(reused.select("session_id", F.lit(True).alias("reused")))


@query("v36_evidence_identity", "SELECT n_nationkey AS session_id, 's' || n_regionkey AS summary_sha256, n_name AS transcript_sha256 FROM nation")
def v36(spark, d):
    n = v.table(spark, d, "nation")
    m = n.selectExpr("n_nationkey as session_id", "n_regionkey as fold", "'e' as evidence_sha256")
    s = n.selectExpr("n_regionkey as fold", "concat('s', n_regionkey) as summary_sha256").distinct()
    return composites.evidence_identity(m, s, n.selectExpr("n_nationkey as session_id", "n_name as transcript_sha256")).select("session_id", "summary_sha256", "transcript_sha256")


@query("v37_comparisons", "SELECT n_name AS dataset, CASE WHEN n_nationkey % 2 = 0 THEN 'threshold_differs' ELSE 'too_few' END AS reason FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey < 10")
def v37(spark, d):
    s = v.table(spark, d, "nation").selectExpr("n_name as dataset", "if(n_nationkey % 2 = 0, 0.4D, 0.5D) as threshold", "n_nationkey as participants", "'out_of_fold' as boundary")
    return composites.comparison_violations(s, 0.5, 10)


@query("v41_source_assessments", "SELECT session_id, CASE WHEN audio_rel > 0 THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN audio_rel > 0 THEN round(audio_risk, 6) END AS risk FROM assessments", "assessments")
def v41(spark, d):
    s = composites.source_assessment(F.col("audio_risk"), F.col("audio_rel"))
    return v.assessments(spark, d).select("session_id", s["status"].alias("status"), F.round(s["risk_probability"], 6).alias("risk"))


@query("v41_filled_segments", "SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'S002,S000,S001' ELSE 'S000,S001,S002' END AS segments FROM assessments", "assessments")
def v41_filled(spark, d):
    first = F.expr("if(session_id % 2 = 0, array('S002', 'S099'), cast(array() as array<string>))")
    return v.assessments(spark, d).select("session_id", F.array_join(composites.filled_segments([first, F.array(F.lit("S000"))], F.array(*[F.lit(f"S00{i}") for i in range(4)]), 3), ",").alias("segments"))


@query("v43_session_texts", "SELECT n_nationkey AS session_id, n_name || chr(10) || chr(10) || 'TRANSCRIPT' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'said' ELSE 'none' END || chr(10) AS text FROM nation")
def v43(spark, d):
    n = v.table(spark, d, "nation").selectExpr("n_nationkey as session_id", "n_name as text")
    return composites.session_texts(n, n.filter("session_id % 2 = 0").select("session_id", F.lit("said").alias("full")), "full", "none")


@query("v45_resolved_files", "SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 1 THEN 'derived' ELSE 'source' END AS path FROM nation")
def v45(spark, d):
    n = v.table(spark, d, "nation")
    return composites.resolved_files(n.selectExpr("n_name as name", "'source' as path", "'h' as sha256"), n.filter("n_nationkey % 3 <> 0").selectExpr("n_name as name", "'derived' as path", "if(n_nationkey % 3 = 1, 'h', 'old') as source_sha256"))


@query("l3_appended", "SELECT user_id AS run_id, count(*) AS entries, 0::BIGINT AS violations FROM events GROUP BY 1")
def l3(spark, d):
    """Entries that are appended to a part of each run's ledger verify together with it."""
    e = v.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("order_key"), F.col("event_type").alias("payload"))
    old = records.chain(e.filter("order_key % 2 = 0"))
    both = old.unionByName(composites.appended(old, e.filter("order_key % 2 = 1")))
    bad = records.chain_violations(both).groupBy("run_id").agg(F.count("*").alias("n"))
    return both.groupBy("run_id").agg(F.count("*").alias("entries")).join(bad, "run_id", "left").select("run_id", "entries", F.coalesce("n", F.lit(0)).alias("violations"))


@query("s6_arrays", """SELECT label::VARCHAR || '-' || vec_id // 500 AS session_id, count(*)::INTEGER AS rows, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 6) AS total, round(max(embedding[1])::DOUBLE, 6) AS first FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 GROUP BY 1""")
def s6(spark, d):
    """The vectors of each label as array files of 500 ids each, which are parsed again."""
    import io

    import numpy as np
    import pyarrow as pa

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        buffer = io.BytesIO()
        np.save(buffer, table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, 64))
        return pa.table({"path": [f"/arrays/{key[0].as_py()}-{key[1].as_py()}_visual.npy"], "content": pa.array([buffer.getvalue()], pa.binary())})

    own = v.table(spark, d, "embeddings").filter("label is not null and size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    made = own.select("label", F.expr("vec_id div 500").alias("part"), "embedding").groupBy("label", "part").applyInArrow(packed, "path string, content binary")
    rows = files.parsed_arrays(made, 64)
    total = F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x))
    return rows.groupBy("session_id").agg(F.count("*").cast("int").alias("rows"), F.round(total, 6).alias("total"), F.round(F.max(F.col("features")[0]), 6).alias("first"))


@query("s7_transcripts", "SELECT conv_id::DOUBLE * 100 + turn AS start_sec, CASE WHEN turn % 4 <> 1 THEN 'said' END AS text, turn % 4 = 1 AS privacy_scrubbed, CASE role WHEN 'user' THEN 'participant' WHEN 'assistant' THEN 'interviewer' ELSE 'unassigned' END AS speaker_role FROM conversations WHERE turn % 5 <> 4")
def s7(spark, d):
    c = v.table(spark, d, "conversations")
    rows = c.select(cells(F.expr("case when turn % 5 = 4 then concat(conv_id * 100 + turn, 'd') else cast(conv_id * 100 + turn as string) end"), F.expr("conv_id * 100 + turn + 1"), F.expr("case role when 'user' then 'Participant' when 'assistant' then 'Ellie' else '?' end"), F.expr("if(turn % 4 = 1, 'scrubbed_entry', 'said')")))
    return files.read_transcripts(spark, as_text(rows, "transcripts", ["Start_Time", "stop_time", "speaker", "value"], "\t")).select("start_sec", "text", "privacy_scrubbed", "speaker_role")


@query("s15_json_lines", "SELECT o_orderkey AS a FROM orders")
def s15(spark, d):
    folder = scratch(spark, "lines")
    v.table(spark, d, "orders").selectExpr("concat('{\"a\": ', o_orderkey, '}') as value").write.text(folder)
    return files.read_jsonl(spark, folder, "a long")


@query("s22_bundles", r"""WITH f AS (SELECT o_custkey AS k, name, string_agg(CASE name WHEN 'index.jsonl' THEN '{"id":' || o_orderkey || '}' ELSE 'EVIDENCE E' || o_orderkey END, chr(10) ORDER BY o_orderkey) AS content FROM orders, (VALUES ('index.jsonl'), ('atomic.txt')) t(name) WHERE name = 'index.jsonl' OR o_custkey % 3 > 0 GROUP BY 1, 2)
  SELECT k::VARCHAR AS bundle, count(*) AS files, sha256(string_agg(sha256(encode(name) || '\x00'::BLOB || encode(content) || '\x00'::BLOB), '' ORDER BY name)) AS fingerprint FROM f GROUP BY 1""")
def s22(spark, d):
    """The files of each customer's bundle; a third of the bundles lack one, and one that is not named does not count."""
    o = v.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.explode(F.array(F.lit("index.jsonl"), F.lit("atomic.txt"), F.lit("notes.txt"))).alias("name")).filter("name <> 'atomic.txt' or o_custkey % 3 > 0")
    line = F.when(F.col("name") == "index.jsonl", F.concat(F.lit('{"id":'), "o_orderkey", F.lit("}"))).otherwise(F.concat(F.lit("EVIDENCE E"), "o_orderkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    made = o.groupBy("o_custkey", "name").agg(F.array_join(lines, "\n").cast("binary").alias("content"))
    return sessions.fingerprints(made.select(F.concat_ws("/", F.lit("/bundles"), "o_custkey", "name").alias("path"), "content"), ["index.jsonl", "atomic.txt"])


@query("g12_session_lines", "SELECT count(*) AS units, count(DISTINCT unit_id) AS lines FROM units", "units")
def g12(spark, d):
    lines = evidence.unit_line(v.units(spark, d), v.observations(spark, d)).filter("line like '[%' and line like '%.'")
    return lines.agg(F.count("*").alias("units"), F.countDistinct("unit_id").alias("lines"))
