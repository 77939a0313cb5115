"""The driver tables seen as sessions, signals, intervals, utterances, predictions and assessments.

Each view has the same definition in SQL (``VIEWS``), so that queries can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400.0
EPOCH_US = 1704067200000000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("source_id"),
        F.when(F.col("event_type").isin("purchase", "signup", "error"), "audio").otherwise("visual").alias("modality"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1e6).alias("t_sec"), "value", F.col("event_id").alias("row_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def sessions(spark, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).groupBy("session_id").agg(F.max("t_sec").alias("duration"))


def intervals(spark, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).filter("source_id in ('signup', 'purchase')")
    return s.select("session_id", F.col("t_sec").alias("start_sec"), (F.col("t_sec") + 600 * F.col("value")).alias("end_sec"), F.substring("source_id", 1, 1).alias("reason")).filter("end_sec > start_sec")


def utterances(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("utterance_id"), (F.col("turn") * 10.0).alias("start_sec"), (F.col("turn") * 10.0 + 10).alias("end_sec"), "text",
        F.when(F.col("role") == "user", "participant").when(F.col("role") == "assistant", "interviewer").otherwise("unassigned").alias("speaker_role"),
    )


def predictions(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("seed", F.explode(F.array(F.lit(42), F.lit(43), F.lit(44))))
    return d.select(F.col("doc_id").alias("session_id"), "seed", F.col("quality").alias("y"), (F.expr("(doc_id * 37 + seed * 11 + n_chars) % 101") / 100).alias("p"))


def assessments(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = lambda a, n, b=0: F.expr(f"((doc_id * {a} + {b}) % {n}) / {n - 1}D")
    ids = lambda a, n: F.expr(f"transform(sequence(0, cast((doc_id * {a}) % {n} as int)), i -> format_string('S%03d', cast((doc_id * {a} + i * 7) % 12 as int)))")
    return d.select(
        F.col("doc_id").alias("session_id"), m(37, 101).alias("risk"), m(53, 97).alias("confidence"), F.when(F.expr("doc_id % 7 <> 0"), m(29, 89)).alias("audio_risk"),
        F.when(F.expr("doc_id % 7 <> 0"), m(31, 83, 5)).alias("audio_rel"), m(41, 79).alias("visual_risk"), m(43, 73, 3).alias("visual_rel"), ids(3, 4).alias("supporting"), ids(5, 3).alias("contradictory"),
    )


NAMES = {"audio": ["loudness_level", "pitch_level", "jitter_level", "voiced_activity_ratio"], "visual": ["head_pitch_angle", "gaze_horizontal_angle", "mouth_opening", "facial_action_activity"]}
SAYS = ["", " I was tired and could not focus.", " Fun, but no energy or appetite!", " Restless nights: a nightmare.", " We rest."]


def units(spark, sf_dir: str) -> DataFrame:
    """Two units, audio and visual, for each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
    modality = F.expr("if(m = 0, 'audio', 'visual')")
    return o.select(
        F.expr("o_orderkey * 2 + m").alias("unit_id"), F.expr("o_custkey % 40").alias("session_id"), F.expr("format_string('S%03d', o_orderkey % 4)").alias("segment_id"), F.col("o_orderkey").alias("atomic_no"), modality.alias("modality"),
        F.expr("case when (o_orderkey + m) % 11 = 0 then 'unavailable' when (o_orderkey + m) % 5 = 0 then 'partial' else 'present' end").alias("availability"), F.expr("((o_orderkey * 7 + m * 3) % 101) / 100D").alias("valid_ratio"),
        F.expr("o_orderkey * 5D").alias("start_sec"), F.concat(F.expr("element_at(array('alpha_', 'beta_', 'gamma_'), cast(o_orderkey % 3 + 1 as int))"), modality).alias("source_id"), F.expr("concat('tool', o_orderkey % 7 % 2)").alias("extractor"),
    )


def observations(spark, sf_dir: str) -> DataFrame:
    """Up to four measurements of each unit."""
    names = "if(modality = 'audio', array({}), array({}))".format(*[", ".join(f"'{n}'" for n in NAMES[m]) for m in ("audio", "visual")])
    rows = units(spark, sf_dir).select("unit_id", F.posexplode(F.expr(names)).alias("pos", "name")).filter("(unit_id + pos) % 4 <> 0")
    percentile = F.expr("if((unit_id + pos) % 9 = 0, null, cast((unit_id * 37 + pos * 17) % 101 as double))")
    category = "case when percentile is null then 'unreferenced' when percentile < 5 then 'very_low' when percentile < 25 then 'low' when percentile <= 75 then 'typical' when percentile < 95 then 'high' else 'very_high' end"
    return rows.select(
        "unit_id", "pos", "name", F.expr("((unit_id * 13 + pos * 29) % 997) / 10D").alias("value"), F.expr("if(pos = 3, 'ratio', 'raw_unit')").alias("unit"), percentile.alias("percentile"), F.expr("((unit_id * 31 + pos * 19) % 81 - 40) / 10D").alias("subject_z"),
        F.expr("((unit_id * 17 + pos * 23) % 61 - 30) / 10D").alias("robust_z"), F.expr("element_at(array('direct', 'derived', 'weak', 'latent'), cast((unit_id + 2 * pos) % 4 + 1 as int))").alias("reliability"),
    ).withColumn("category", F.expr(category))


def talk(spark, sf_dir: str) -> DataFrame:
    """Utterances with cue words, scrubbed ones among them."""
    said = "element_at(array({}), cast(utterance_id * 3 % 5 + 1 as int))".format(", ".join(f"'{x}'" for x in SAYS))
    return utterances(spark, sf_dir).withColumns({"text": F.expr(f"concat(text, {said})"), "privacy_scrubbed": F.expr("utterance_id % 7 = 3")})


VIEWS = {
    "signals": f"""SELECT user_id AS session_id, event_type AS source_id, CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'audio' ELSE 'visual' END AS modality,
        (epoch_us(ts) - {EPOCH_US})::DOUBLE / 1e6::DOUBLE AS t_sec, value, event_id AS row_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "sessions": "SELECT session_id, max(t_sec) AS duration FROM signals GROUP BY 1",
    "intervals": """SELECT session_id, t_sec AS start_sec, t_sec + 600::DOUBLE * value AS end_sec, source_id[1] AS reason FROM signals
        WHERE source_id IN ('signup', 'purchase') AND t_sec + 600::DOUBLE * value > t_sec""",
    "utterances": """SELECT conv_id AS session_id, turn AS utterance_id, turn * 10::DOUBLE AS start_sec, turn * 10::DOUBLE + 10 AS end_sec, text,
        CASE role WHEN 'user' THEN 'participant' WHEN 'assistant' THEN 'interviewer' ELSE 'unassigned' END AS speaker_role FROM conversations""",
    "preds": """SELECT d.doc_id AS session_id, s.seed, l.quality AS y, ((d.doc_id * 37 + s.seed * 11 + d.n_chars) % 101)::DOUBLE / 100::DOUBLE AS p
        FROM documents d JOIN labels l USING (doc_id), (VALUES (42), (43), (44)) s(seed)""",
    "assessments": """SELECT doc_id AS session_id, ((doc_id * 37) % 101)::DOUBLE / 100 AS risk, ((doc_id * 53) % 97)::DOUBLE / 96 AS confidence,
        CASE WHEN doc_id % 7 <> 0 THEN ((doc_id * 29) % 89)::DOUBLE / 88 END AS audio_risk, CASE WHEN doc_id % 7 <> 0 THEN ((doc_id * 31 + 5) % 83)::DOUBLE / 82 END AS audio_rel,
        ((doc_id * 41) % 79)::DOUBLE / 78 AS visual_risk, ((doc_id * 43 + 3) % 73)::DOUBLE / 72 AS visual_rel,
        list_transform(range(0, (doc_id * 3) % 4 + 1), lambda i: printf('S%03d', (doc_id * 3 + i * 7) % 12)) AS supporting,
        list_transform(range(0, (doc_id * 5) % 3 + 1), lambda i: printf('S%03d', (doc_id * 5 + i * 7) % 12)) AS contradictory FROM documents""",
    "units": """SELECT o_orderkey * 2 + m AS unit_id, o_custkey % 40 AS session_id, printf('S%03d', o_orderkey % 4) AS segment_id, o_orderkey AS atomic_no, CASE m WHEN 0 THEN 'audio' ELSE 'visual' END AS modality,
        CASE WHEN (o_orderkey + m) % 11 = 0 THEN 'unavailable' WHEN (o_orderkey + m) % 5 = 0 THEN 'partial' ELSE 'present' END AS availability, ((o_orderkey * 7 + m * 3) % 101)::DOUBLE / 100 AS valid_ratio, o_orderkey * 5::DOUBLE AS start_sec,
        ['alpha_', 'beta_', 'gamma_'][o_orderkey % 3 + 1] || CASE m WHEN 0 THEN 'audio' ELSE 'visual' END AS source_id, 'tool' || (o_orderkey % 7 % 2) AS extractor FROM orders, range(0, 2) r(m)""",
    "observations": f"""SELECT *, CASE WHEN percentile IS NULL THEN 'unreferenced' WHEN percentile < 5 THEN 'very_low' WHEN percentile < 25 THEN 'low' WHEN percentile <= 75 THEN 'typical' WHEN percentile < 95 THEN 'high' ELSE 'very_high' END AS category FROM (
        SELECT unit_id, pos::INTEGER AS pos, CASE modality WHEN 'audio' THEN {NAMES["audio"]} ELSE {NAMES["visual"]} END[pos + 1] AS name, ((unit_id * 13 + pos * 29) % 997)::DOUBLE / 10 AS value, CASE pos WHEN 3 THEN 'ratio' ELSE 'raw_unit' END AS unit,
        CASE WHEN (unit_id + pos) % 9 <> 0 THEN ((unit_id * 37 + pos * 17) % 101)::DOUBLE END AS percentile, ((unit_id * 31 + pos * 19) % 81 - 40)::DOUBLE / 10 AS subject_z, ((unit_id * 17 + pos * 23) % 61 - 30)::DOUBLE / 10 AS robust_z,
        ['direct', 'derived', 'weak', 'latent'][(unit_id + 2 * pos) % 4 + 1] AS reliability FROM units, range(0, 4) r(pos) WHERE (unit_id + pos) % 4 <> 0)""",
    "talk": f"""SELECT session_id, utterance_id, start_sec, end_sec, text || {SAYS}[utterance_id * 3 % 5 + 1] AS text, speaker_role, utterance_id % 7 = 3 AS privacy_scrubbed FROM utterances""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the definitions of the views it uses."""
    views, own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names), sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.startswith(start):
            return f"{start}{views}, {own[len(start):]}"
    return f"WITH {views} {own}"
