"""Queries over units, observations and utterances: slots, salience, choices and wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import evidence, slots, transcripts
from lumenlake.plans import views as v
from lumenlake.plans.catalog import query

#: (modality, slot, label) and (source, modality, slot, order, measurement, mapping) of the examples.
SLOTS = [("audio", "energy", "Vocal energy"), ("audio", "tone", "Vocal tone"), ("audio", "voice", "Voicing"), ("visual", "face", "Facial activity"), ("visual", "head", "Head pose")]
PROFILES = [
    (f"{s}_{m}", m, slot, i, name, quality)
    for s in ("alpha", "beta")
    for m, slot, i, name, quality in [
        ("audio", "energy", 0, "loudness_level", "direct"), ("audio", "tone", 0, "pitch_level", "direct"), ("audio", "tone", 1, "jitter_level", "derived"),
        ("visual", "face", 0, "facial_action_activity", "direct"), ("visual", "head", 0, "head_pitch_angle", "derived"), ("visual", "head", 1, "gaze_horizontal_angle", "approximate"),
    ]
] + [("gamma_audio", "audio", "voice", 0, "voiced_activity_ratio", "direct"), ("gamma_visual", "visual", "face", 0, "mouth_opening", "approximate")]
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
DIM_SQL = f"defs AS (SELECT * FROM (VALUES {_values(SLOTS)}) t(modality, slot_id, label)), prof AS (SELECT * FROM (VALUES {_values(PROFILES)}) t(source_id, modality, slot_id, o, name, mapping))"
PROJECTED_SQL = f"""{DIM_SQL}, hit AS (SELECT u.unit_id, p.slot_id, min_by({{'name': b.name, 'value': b.value, 'percentile': b.percentile, 'mapping': p.mapping}}, p.o) AS h FROM units u JOIN observations b USING (unit_id) JOIN prof p ON p.source_id = u.source_id AND p.name = b.name GROUP BY 1, 2),
  projected AS (SELECT u.unit_id, u.source_id, u.modality, d.slot_id, CASE WHEN h IS NOT NULL THEN 'measured' WHEN EXISTS (SELECT 1 FROM prof p WHERE p.source_id = u.source_id AND p.slot_id = d.slot_id) THEN 'unavailable' ELSE 'not_measured' END AS status,
  h.name AS name, h.value AS value, h.percentile AS percentile, h.mapping AS mapping FROM units u JOIN defs d USING (modality) LEFT JOIN hit ON hit.unit_id = u.unit_id AND hit.slot_id = d.slot_id)"""


def definitions(spark):
    return spark.createDataFrame(SLOTS, "modality string, slot_id string, label string")


def profiles(spark):
    return spark.createDataFrame(PROFILES, "source_id string, modality string, slot_id string, binding_order int, observation_name string, mapping string")


def projected(spark, d):
    return slots.project(v.units(spark, d), v.observations(spark, d), profiles(spark), definitions(spark))


@query("j8_slot_projection", f"WITH {PROJECTED_SQL} SELECT unit_id, slot_id, status, name, value, percentile, mapping FROM projected", "units", "observations")
def j8(spark, d):
    """The first binding that a unit measures, for each fixed slot."""
    return projected(spark, d).select("unit_id", "slot_id", "status", "name", "value", "percentile", "mapping")


@query("j9_profile_mismatches", f"WITH {DIM_SQL}, p AS (SELECT source_id, any_value(modality) AS m FROM prof WHERE source_id <> 'gamma_visual' GROUP BY 1), x AS (SELECT unit_id, source_id, CASE WHEN unit_id % 50 = 1 THEN 'audio' ELSE modality END AS modality FROM units) SELECT unit_id, x.source_id, CASE WHEN m IS NULL THEN 'unknown_source' ELSE 'modality_mismatch' END AS reason FROM x LEFT JOIN p USING (source_id) WHERE m IS NULL OR m <> modality", "units")
def j9(spark, d):
    odd = v.units(spark, d).withColumn("modality", F.expr("if(unit_id % 50 = 1, 'audio', modality)"))
    return slots.profile_mismatches(odd, profiles(spark).filter("source_id <> 'gamma_visual'"))


@query("g2_extensions", f"""WITH {DIM_SQL}, r AS (SELECT b.unit_id, b.name, row_number() OVER (PARTITION BY b.unit_id ORDER BY CASE reliability WHEN 'direct' THEN 2 ELSE 1 END DESC, coalesce(abs(percentile - 50), -1) DESC, b.name) AS rank FROM observations b JOIN units u USING (unit_id)
  WHERE reliability IN ('direct', 'derived') AND NOT EXISTS (SELECT 1 FROM prof p WHERE p.source_id = u.source_id AND p.name = b.name)) SELECT unit_id, name, rank::INTEGER AS rank FROM r WHERE rank <= 2""", "units", "observations")
def g2(spark, d):
    return slots.extensions(v.units(spark, d), v.observations(spark, d), profiles(spark))


@query("g3_merged_profiles", f"""WITH {DIM_SQL}, seen AS (SELECT u.source_id, u.modality, b.name, count(*) AS n FROM units u JOIN observations b USING (unit_id) WHERE u.source_id LIKE 'beta%' GROUP BY ALL), own AS (SELECT source_id, CASE modality WHEN 'audio' THEN 'voice' ELSE 'face' END AS slot_id, name FROM seen QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, name) = 1)
  SELECT source_id, slot_id, name AS observation_name FROM prof WHERE source_id NOT IN (SELECT source_id FROM own) UNION ALL SELECT source_id, slot_id, name FROM own""", "units", "observations")
def g3(spark, d):
    """The profiles of two sources give way to their commonest measurement."""
    own_units = v.units(spark, d).filter("source_id like 'beta%'").select("unit_id", "source_id", "modality").hint("merge")  # made of orders, many times what Spark expects of them
    seen = own_units.join(v.observations(spark, d).select("unit_id", "name"), "unit_id").groupBy("source_id", "modality", "name").agg(F.count("*").alias("n"))
    first = seen.groupBy("source_id", "modality").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("x"))
    own = first.select("source_id", "modality", F.expr("if(modality = 'audio', 'voice', 'face')").alias("slot_id"), F.lit(0).alias("binding_order"), F.col("x.name").alias("observation_name"), F.lit("derived").alias("mapping"))
    return slots.merged_profiles(profiles(spark), own).select("source_id", "slot_id", "observation_name")


AGGREGATED_SQL = f"""{PROJECTED_SQL}, rows_ AS (SELECT p.*, u.session_id, u.segment_id FROM projected p JOIN units u USING (unit_id)),
  names AS (SELECT session_id, segment_id, source_id, slot_id, name FROM rows_ WHERE status = 'measured' GROUP BY 1, 2, 3, 4, 5 QUALIFY row_number() OVER (PARTITION BY session_id, segment_id, source_id, slot_id ORDER BY count(*) DESC, name DESC) = 1),
  agg AS (SELECT session_id, segment_id, source_id, slot_id, count(*) FILTER (WHERE status = 'measured') AS measured, count(*) AS units, median(value) AS value, median(percentile) AS percentile, max(CASE mapping WHEN 'direct' THEN 1.0 WHEN 'derived' THEN 0.8 WHEN 'approximate' THEN 0.5 END)::DOUBLE AS weight FROM rows_ GROUP BY 1, 2, 3, 4),
  slotted AS (SELECT a.*, n.name AS dominant, round(CASE WHEN measured > 0 AND percentile IS NOT NULL THEN abs(percentile - 50) * weight * measured / units ELSE -1 END, 9) AS salience FROM agg a LEFT JOIN names n USING (session_id, segment_id, source_id, slot_id))"""


def aggregated(spark, d):
    own = slots.aggregate_slots(projected(spark, d).select("unit_id", "source_id", "slot_id", "status", "name", "value", "percentile", "mapping"), v.units(spark, d).select("unit_id", "session_id", "segment_id"))
    return own.withColumn("salience", F.round("salience", 9))


@query("g4_slot_aggregate", f"WITH {AGGREGATED_SQL} SELECT session_id, segment_id, source_id, slot_id, measured, units, round(value, 6) AS value, percentile, dominant, round(salience, 6) AS salience FROM slotted", "units", "observations")
def g4(spark, d):
    """G4 and G5 over the projected slots."""
    return aggregated(spark, d).select("session_id", "segment_id", "source_id", "slot_id", "measured", "units", F.round("value", 6).alias("value"), "percentile", "dominant", F.round("salience", 6).alias("salience"))


@query("g6_selected_slots", f"""WITH {AGGREGATED_SQL} SELECT session_id, segment_id, source_id, slot_id, cast(row_number() OVER (PARTITION BY session_id, segment_id, source_id ORDER BY (slot_id = 'tone' AND salience >= 10) DESC, salience DESC, measured DESC, slot_id DESC) AS INTEGER) AS rank
  FROM slotted WHERE measured > 0 QUALIFY rank <= 1""", "units", "observations")
def g6(spark, d):
    return slots.selected_slots(aggregated(spark, d), ["session_id", "segment_id", "source_id"], ["tone"], 1).select("session_id", "segment_id", "source_id", "slot_id", "rank")


@query("g7_source_payload", """WITH x AS (SELECT session_id, segment_id, source_id, extractor FROM units GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY session_id, segment_id, source_id ORDER BY count(*) DESC, extractor DESC) = 1)
  SELECT session_id, segment_id, source_id, count(*) FILTER (WHERE availability = 'present') AS present, count(*) FILTER (WHERE availability = 'partial') AS partial, count(*) FILTER (WHERE availability = 'unavailable') AS unavailable, round(median(valid_ratio), 6) AS median_valid_ratio, any_value(x.extractor) AS extractor
  FROM units JOIN x USING (session_id, segment_id, source_id) GROUP BY 1, 2, 3""", "units")
def g7(spark, d):
    return slots.source_payload(v.units(spark, d), ["session_id", "segment_id", "source_id"]).withColumn("median_valid_ratio", F.round("median_valid_ratio", 6))


@query("g8_coverage_lines", f"""WITH {PROJECTED_SQL}, c AS (SELECT session_id, p.modality, p.source_id, p.slot_id, label, count(*) FILTER (WHERE status = 'measured') AS m, count(*) FILTER (WHERE status <> 'not_measured') AS s, count(*) AS n FROM projected p JOIN units u USING (unit_id) JOIN defs d ON d.modality = p.modality AND d.slot_id = p.slot_id GROUP BY ALL)
  SELECT session_id, source_id, '- ' || upper(modality) || ' ' || source_id || ' | ' || string_agg(label || '=' || CASE WHEN m > 0 THEN 'M ' || m || '/' || n WHEN s > 0 THEN 'U ' || n || '/' || n ELSE 'NM' END, '; ' ORDER BY slot_id) AS line FROM c GROUP BY session_id, source_id, modality""", "units", "observations")
def g8(spark, d):
    own = projected(spark, d).join(v.units(spark, d).select("unit_id", "session_id"), "unit_id")
    return slots.coverage_lines(own, definitions(spark), ["session_id"])


ATOM_SQL = """seg AS (SELECT session_id, segment_id, list(DISTINCT atomic_no) AS ids FROM units GROUP BY 1, 2)"""


def listed_segments(spark, d):
    return v.units(spark, d).groupBy("session_id", "segment_id").agg(F.collect_set(F.col("atomic_no")).alias("atomic_ids"))


@query("g10_atom_index", "SELECT DISTINCT session_id, atomic_no AS atomic_id, segment_id FROM units", "units")
def g10(spark, d):
    atoms = v.units(spark, d).select("session_id", F.col("atomic_no").alias("atomic_id")).distinct()
    return evidence.atom_index(atoms, listed_segments(spark, d)).select("session_id", "atomic_id", "segment_id")


@query("g11_index_violations", """WITH a AS (SELECT session_id, atomic_no AS atomic_id, count(*) / 2 AS n FROM units WHERE atomic_no % 10 <> 1 GROUP BY 1, 2), l AS (SELECT session_id, atomic_no AS atomic_id, CASE WHEN atomic_no % 10 = 2 THEN 2 ELSE 1 END AS n FROM units WHERE atomic_no % 10 <> 3 GROUP BY 1, 2)
  SELECT session_id, atomic_id, CASE WHEN a.n IS NULL THEN 'unknown_atom' WHEN l.n IS NULL THEN 'without_segment' ELSE 'in_several_segments' END AS reason FROM a FULL JOIN l USING (session_id, atomic_id) WHERE a.n IS NULL OR l.n IS NULL OR l.n > 1""", "units")
def g11(spark, d):
    u = v.units(spark, d).filter("modality = 'audio'").select("session_id", "segment_id", F.col("atomic_no").alias("atomic_id"))
    lists = u.filter("atomic_id % 10 <> 3").unionByName(u.filter("atomic_id % 10 = 2").withColumn("segment_id", F.lit("S999")))
    return evidence.index_violations(u.filter("atomic_id % 10 <> 1"), lists.groupBy("session_id", "segment_id").agg(F.collect_list("atomic_id").alias("atomic_ids")))


PRIORITIES = {"loudness_level": 12, "head_pitch_angle": 10, "mouth_opening": 4}
_PRIORITY_SQL = "CASE name " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in PRIORITIES.items()) + " ELSE 0 END"
_WEIGHT_SQL = "CASE reliability WHEN 'direct' THEN 1.0 WHEN 'derived' THEN 0.9 WHEN 'weak' THEN 0.35 ELSE 0.2 END::DOUBLE"


@query("g14_rendered_observations", f"""SELECT unit_id, name FROM observations QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY {_PRIORITY_SQL} DESC, coalesce(abs(percentile - 50), -1) DESC, CASE reliability WHEN 'direct' THEN 3 WHEN 'derived' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END DESC, pos) <= 2""", "units", "observations")
def g14(spark, d):
    return evidence.rendered_observations(v.observations(spark, d), PRIORITIES, 2).select("unit_id", "name")


_NUMBER_SQL = lambda x, n: f"(CASE regexp_replace(regexp_replace(printf('%.{n}f', {x}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') WHEN '-0' THEN '0' ELSE regexp_replace(regexp_replace(printf('%.{n}f', {x}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END)"


@query("g15_unit_lines", f"""WITH o AS (SELECT unit_id, string_agg(name || '=' || {_NUMBER_SQL('value', 4)} || ':' || unit || '[category=' || category || CASE WHEN percentile IS NULL THEN '' ELSE ',p=' || round_even(percentile, 0)::INT END || ',z=' || {_NUMBER_SQL('robust_z', 2)} || ',reliability=' || reliability || ']', '; ' ORDER BY pos) AS t FROM observations GROUP BY 1)
  SELECT unit_id, '[' || upper(modality) || '|id=' || unit_id || '] availability=' || availability || '; valid_ratio=' || {_NUMBER_SQL('valid_ratio', 4)} || coalesce('; ' || t, '') || '.' AS line FROM units LEFT JOIN o USING (unit_id)""", "units", "observations")
def g15(spark, d):
    """Units as lines of text."""
    return evidence.unit_line(v.units(spark, d), v.observations(spark, d))


@query("g17_aggregate_observation", f"""WITH t AS (SELECT session_id, segment_id, modality, count(*) AS units FROM units GROUP BY 1, 2, 3), e AS (SELECT session_id, segment_id, modality, name, median(percentile) AS percentile, count(*) AS n, max({_WEIGHT_SQL}) AS w FROM units JOIN observations USING (unit_id) WHERE percentile IS NOT NULL GROUP BY 1, 2, 3, 4),
  s AS (SELECT *, w * (0.55::DOUBLE * {_PRIORITY_SQL} / 20 + 0.35::DOUBLE * abs(percentile - 50) / 50 + 0.10::DOUBLE * n / units) AS score FROM e JOIN t USING (session_id, segment_id, modality))
  SELECT session_id, segment_id, modality, name, percentile, n, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY session_id, segment_id, modality ORDER BY score DESC, name DESC) = 1""", "units", "observations")
def g17(spark, d):
    return evidence.aggregate_observation(v.units(spark, d), v.observations(spark, d), ["session_id", "segment_id", "modality"], PRIORITIES).withColumn("score", F.round("score", 6))


ATOMS_SQL = f"""os AS (SELECT unit_id, {_WEIGHT_SQL} * (0.7::DOUBLE * coalesce(abs(percentile - 50) / 50, 0) + 0.3::DOUBLE * coalesce(least(abs(subject_z), 4) / 4, 0)) AS s FROM observations), st AS (SELECT unit_id, avg(s) AS s FROM (SELECT * FROM os QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY s DESC) <= 2) GROUP BY 1),
  us AS (SELECT u.*, 0.8::DOUBLE * coalesce(s, 0) + 0.2::DOUBLE * valid_ratio AS u FROM units u LEFT JOIN st USING (unit_id)),
  atoms AS (SELECT session_id, segment_id, atomic_no, round(avg(u) + CASE WHEN count(*) FILTER (WHERE availability <> 'unavailable') >= 2 THEN 0.1 ELSE 0 END, 9) AS salience, any_value(start_sec) AS mid FROM us GROUP BY 1, 2, 3)"""


def atoms(spark, d):
    u = v.units(spark, d)
    own = evidence.atom_salience(u, v.observations(spark, d), ["session_id", "segment_id", "atomic_no"])
    return own.withColumns({"salience": F.round("salience", 9), "mid": F.col("atomic_no") * 5.0})


@query("g18_atom_salience", f"WITH {ATOMS_SQL} SELECT session_id, segment_id, atomic_no, round(salience, 6) AS salience FROM atoms", "units", "observations")
def g18(spark, d):
    return atoms(spark, d).select("session_id", "segment_id", "atomic_no", F.round("salience", 6).alias("salience"))


@query("g19_segment_salience", f"""WITH {ATOMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment_id ORDER BY salience DESC) AS r FROM atoms) SELECT session_id, segment_id, round(0.7::DOUBLE * avg(salience) FILTER (WHERE r <= 4) + 0.3::DOUBLE * avg(salience), 6) AS salience FROM r GROUP BY 1, 2""", "units", "observations")
def g19(spark, d):
    return evidence.segment_salience(atoms(spark, d), ["session_id", "segment_id"]).withColumn("salience", F.round("salience", 6))


_UNIFORM = lambda n, k: f"(SELECT list(floor(i * ({n} - 1)::DOUBLE / {k - 1} + 0.5)::INT) FROM range(0, {k}) q(i))" if k > 1 else f"[(({n} - 1) // 2)::INT]"


@query("g26_chosen_atoms", f"""WITH {ATOMS_SQL}, r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY session_id, segment_id ORDER BY salience DESC, mid, atomic_no) AS r FROM atoms WINDOW w AS (PARTITION BY session_id, segment_id)),
  i AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment_id, r <= 3 ORDER BY mid, atomic_no) - 1 AS i FROM r) SELECT session_id, segment_id, atomic_no FROM i WHERE n <= 6 OR r <= 3 OR i IN (floor(0.5), floor((n - 4)::DOUBLE / 2 + 0.5), floor((n - 4) + 0.5))""", "units", "observations")
def g26(spark, d):
    return evidence.chosen_atoms(atoms(spark, d), ["session_id", "segment_id"], 6).select("session_id", "segment_id", "atomic_no")


@query("g27_shown_observations", """WITH a AS (SELECT *, CASE name WHEN 'pitch_level' THEN 0 WHEN 'loudness_level' THEN 1 WHEN 'mouth_opening' THEN 2 END AS p FROM observations), b AS (SELECT *, coalesce(p = min(p) OVER (PARTITION BY unit_id), false) AS anchor FROM a)
  SELECT unit_id, name, cast(row_number() OVER (PARTITION BY unit_id ORDER BY anchor DESC, CASE WHEN reliability IN ('direct', 'derived') THEN 2 WHEN reliability = 'weak' THEN 1 ELSE 0 END DESC, coalesce(abs(percentile - 50), -1) DESC, name DESC) AS INTEGER) AS rank FROM b QUALIFY rank <= 2""", "units", "observations")
def g27(spark, d):
    return evidence.shown_observations(v.observations(spark, d), ["pitch_level", "loudness_level", "mouth_opening"], 2).select("unit_id", "name", "rank")


@query("g28_cross_modal_context", """WITH n AS (SELECT unit_id, count(*) AS n FROM observations WHERE abs(subject_z) >= 2 GROUP BY 1), c AS (SELECT session_id, atomic_no, bool_or(modality = 'audio' AND availability <> 'unavailable') AS a, bool_or(modality = 'visual' AND availability <> 'unavailable') AS v,
    coalesce(sum(n) FILTER (WHERE modality = 'audio'), 0)::BIGINT AS audio_odd, coalesce(sum(n) FILTER (WHERE modality = 'visual'), 0)::BIGINT AS visual_odd FROM units LEFT JOIN n USING (unit_id) GROUP BY 1, 2)
  SELECT session_id, atomic_no, CASE WHEN a AND v THEN 'audio and visual measurements were both available' WHEN a THEN 'only audio measurements were available' WHEN v THEN 'only visual measurements were available' ELSE 'audio and visual measurements were unavailable' END AS availability, audio_odd, visual_odd FROM c""", "units", "observations")
def g28(spark, d):
    return evidence.cross_modal_context(v.units(spark, d), v.observations(spark, d), ["session_id", "atomic_no"])


@query("g28_segment_contrast", """WITH e AS (SELECT session_id, segment_id, name, arg_min(percentile, unit_id) AS first, arg_max(percentile, unit_id) AS last, count(*) AS n FROM units JOIN observations USING (unit_id) WHERE percentile IS NOT NULL GROUP BY 1, 2, 3)
  SELECT session_id, segment_id, name, first, last, CASE WHEN last - first >= 10 THEN 'higher' WHEN last - first <= -10 THEN 'lower' ELSE 'similar' END AS relation FROM e WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY session_id, segment_id ORDER BY (name IN ('pitch_level', 'mouth_opening')) DESC, abs(last - first) DESC, name DESC) = 1""", "units", "observations")
def g28_contrast(spark, d):
    return evidence.segment_contrast(v.units(spark, d), v.observations(spark, d), ["session_id", "segment_id"], ["pitch_level", "mouth_opening"])


_CUE_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z])({'|'.join(t)})([^a-z]|$)') THEN '{n}' END" for n, t in transcripts.CUE_FAMILIES.items()) + "]"
CUED_SQL = f"cued AS (SELECT *, list_filter({_CUE_SQL}, lambda x: x IS NOT NULL) AS cues FROM talk)"


@query("g20_cue_counts", f"WITH {CUED_SQL} SELECT session_id, family, count(*) AS n FROM (SELECT session_id, unnest(cues) AS family FROM cued) GROUP BY 1, 2", "utterances", "talk")
def g20(spark, d):
    return transcripts.cue_counts(v.talk(spark, d), ["session_id"])


@query("g21_segment_scores", f"WITH {CUED_SQL} SELECT session_id, utterance_id // 4 AS segment_no, round(10.0::DOUBLE * sum(len(cues)) + 0.001::DOUBLE * least(sum(length(text)), 1000), 6) AS score FROM cued GROUP BY 1, 2", "utterances", "talk")
def g21(spark, d):
    t = v.talk(spark, d).withColumn("segment_no", F.expr("utterance_id div 4"))
    return t.groupBy("session_id", "segment_no").agg(F.round(transcripts.segment_score(F.col("text")), 6).alias("score"))


def ranked_segments(spark, d):
    u = v.units(spark, d)
    return u.groupBy("session_id", F.expr("atomic_no % 12").alias("segment_no")).agg(F.expr("sum(atomic_no * 7) % 101").alias("salience"), F.expr("sum(atomic_no * 5) % 97").alias("cue_score"), F.expr("sum(atomic_no) % 3 = 0").alias("has_text"))


RANKED_SQL = "s AS (SELECT session_id, atomic_no % 12 AS segment_no, sum(atomic_no * 7) % 101 AS salience, sum(atomic_no * 5) % 97 AS cue_score, sum(atomic_no) % 3 = 0 AS has_text FROM units GROUP BY 1, 2)"


@query("g22_initial_segments", f"""WITH {RANKED_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY segment_no) - 1 AS i FROM s), e AS (SELECT *, n <= 2 OR i IN (0, n - 1) AS even FROM n),
  a AS (SELECT *, even OR row_number() OVER (PARTITION BY session_id, even ORDER BY salience DESC, segment_no) <= 2 AS a FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY session_id, a ORDER BY cue_score DESC, segment_no) AS c FROM a)
  SELECT session_id, segment_no FROM c WHERE n <= 6 OR a OR c <= 2""", "units")
def g22(spark, d):
    return evidence.initial_segments(ranked_segments(spark, d), 6).select("session_id", "segment_no")


@query("g23_review_segments", f"""WITH {RANKED_SQL}, w AS (SELECT *, bool_or(has_text) OVER (PARTITION BY session_id) AS words FROM s) SELECT session_id, segment_no, cast(row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN words THEN cue_score ELSE salience END DESC, segment_no) AS INTEGER) AS rank FROM w QUALIFY rank <= 4""", "units")
def g23(spark, d):
    return evidence.review_segments(ranked_segments(spark, d)).select("session_id", "segment_no", "rank")


@query("g24_chosen_utterances", f"""WITH {CUED_SQL}, n AS (SELECT *, len(cues) AS c, count(*) OVER p AS n, count(*) FILTER (WHERE len(cues) > 0) OVER p AS has, row_number() OVER (PARTITION BY session_id ORDER BY len(cues) DESC, length(text) DESC, start_sec, utterance_id) AS r FROM cued WINDOW p AS (PARTITION BY session_id)),
  f AS (SELECT *, r <= 2 AND (has = 0 OR c > 0) AS first, least(2, CASE WHEN has > 0 THEN has ELSE n END) AS taken FROM n), i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first, start_sec, utterance_id) - 1 AS i, n - taken AS rest, 3 - taken AS k FROM f)
  SELECT session_id, utterance_id FROM i WHERE n <= 3 OR first OR (k = 1 AND i = (rest - 1) // 2) OR (k = 2 AND i IN (0, rest - 1)) OR (k = 3 AND i IN (0, floor((rest - 1)::DOUBLE / 2 + 0.5), rest - 1))""", "utterances", "talk")
def g24(spark, d):
    return transcripts.chosen_utterances(v.talk(spark, d), ["session_id"], 3).select("session_id", "utterance_id")


@query("g16_transcript_tier", """WITH n AS (SELECT session_id, utterance_id // 6 AS segment_no, utterance_id, count(*) OVER w AS n, row_number() OVER (PARTITION BY session_id, utterance_id // 6 ORDER BY start_sec, utterance_id) - 1 AS i FROM talk WINDOW w AS (PARTITION BY session_id, utterance_id // 6))
  SELECT session_id, segment_no, utterance_id FROM n WHERE n <= 2 OR i IN (0, n - 1)""", "utterances", "talk")
def g16(spark, d):
    t = v.talk(spark, d).withColumn("segment_no", F.expr("utterance_id div 6"))
    return transcripts.tier(t, ["session_id", "segment_no"], "compact").select("session_id", "segment_no", "utterance_id")


@query("g29_shortened", "SELECT session_id, utterance_id, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(CASE WHEN rtrim(regexp_extract(substr(text, 1, 39), '(?s)^(.*) [^ ]*$', 1)) <> '' THEN rtrim(regexp_extract(substr(text, 1, 39), '(?s)^(.*) [^ ]*$', 1)) ELSE substr(text, 1, 39) END) || '…' END AS short FROM talk", "utterances", "talk")
def g29(spark, d):
    return v.talk(spark, d).select("session_id", "utterance_id", transcripts.shortened(F.col("text"), 40).alias("short"))


@query("p15_visible_utterances", """WITH s AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN 'unassigned' ELSE speaker_role END AS speaker_role) FROM talk) WHERE NOT privacy_scrubbed AND trim(text) <> '')
  SELECT session_id, utterance_id FROM s QUALIFY speaker_role = 'participant' OR max((speaker_role <> 'unassigned')::INT) OVER (PARTITION BY session_id) = 0""", "utterances", "talk")
def p15(spark, d):
    t = v.talk(spark, d).withColumn("speaker_role", F.expr("if(session_id % 3 = 0, 'unassigned', speaker_role)"))
    return transcripts.visible(t).select("session_id", "utterance_id")


@query("x1_normalised_text", r"""SELECT session_id, utterance_id, trim(regexp_replace(replace(replace(text || ' ｆｉｎｅ！　ﬁn' || '… a|b', '|', ' '), '…', '...'), '\s+', ' ', 'g'))
  .replace('ｆｉｎｅ！　ﬁn', 'fine! fin') AS clean FROM talk""", "utterances", "talk")
def x1(spark, d):
    return v.talk(spark, d).select("session_id", "utterance_id", transcripts.normalised(F.concat("text", F.lit(" ｆｉｎｅ！　ﬁn… a|b"))).alias("clean"))


@query("v14_session_intervals", """SELECT session_id, kind, start_sec, end_sec, reason FROM (SELECT *, unnest(list_filter([CASE WHEN speaker_role = 'participant' THEN {'kind': 'participant', 'reason': 'participant_speaking'} END, CASE WHEN privacy_scrubbed THEN {'kind': 'privacy', 'reason': 'privacy_scrubbed'} END,
  {'kind': 'speech', 'reason': 'any_speech'}], lambda x: x IS NOT NULL), recursive := true) FROM talk)""", "utterances", "talk")
def v14(spark, d):
    return transcripts.session_intervals(v.talk(spark, d))


@query("w10_window_ratios", """WITH w AS (SELECT session_id, i AS window_index, i * 15::DOUBLE AS start_sec, i * 15::DOUBLE + 25 AS end_sec FROM (SELECT session_id, max(end_sec) AS e FROM talk GROUP BY 1), range(0, 200) r(i) WHERE i * 15 < e)
  SELECT w.session_id, window_index, round(coalesce(sum(least(w.end_sec, t.end_sec) - greatest(w.start_sec, t.start_sec)) FILTER (WHERE speaker_role = 'participant'), 0) / 25, 6) AS participant_ratio, round(coalesce(sum(least(w.end_sec, t.end_sec) - greatest(w.start_sec, t.start_sec)) FILTER (WHERE privacy_scrubbed), 0) / 25, 6) AS privacy_ratio
  FROM w LEFT JOIN talk t ON t.session_id = w.session_id AND t.start_sec < w.end_sec AND w.start_sec < t.end_sec GROUP BY 1, 2""", "utterances", "talk")
def w10(spark, d):
    t = v.talk(spark, d)
    w = t.groupBy("session_id").agg(F.max("end_sec").alias("e")).select("session_id", F.explode(F.expr("filter(sequence(0, 199), i -> i * 15 < e)")).alias("window_index"))
    w = w.withColumns({"start_sec": F.col("window_index") * 15.0, "end_sec": F.col("window_index") * 15.0 + 25}).withColumn("window_index", F.col("window_index").cast("long"))
    out = transcripts.window_ratios(w, ["session_id", "window_index"], transcripts.session_intervals(t), ["participant", "privacy"], 60.0)
    return out.select("session_id", "window_index", F.round("participant_ratio", 6).alias("participant_ratio"), F.round("privacy_ratio", 6).alias("privacy_ratio"))


@query("v3_modality_lines", f"""WITH t AS (SELECT session_id, segment_id, count(*) AS units, count(*) FILTER (WHERE availability <> 'unavailable') AS available, median(valid_ratio) AS ratio FROM units WHERE modality = 'audio' GROUP BY 1, 2),
  e AS (SELECT session_id, segment_id, name, median(percentile) AS percentile, count(*) AS n, max({_WEIGHT_SQL}) AS w FROM units JOIN observations USING (unit_id) WHERE percentile IS NOT NULL AND modality = 'audio' GROUP BY 1, 2, 3),
  b AS (SELECT * FROM e JOIN t USING (session_id, segment_id) QUALIFY row_number() OVER (PARTITION BY session_id, segment_id ORDER BY w * (0.55::DOUBLE * {_PRIORITY_SQL} / 20 + 0.35::DOUBLE * abs(percentile - 50) / 50 + 0.10::DOUBLE * n / units) DESC, name DESC) = 1)
  SELECT session_id, segment_id, 'Audio: ' || available || ' of ' || units || ' windows available; median valid coverage ' || round_even(100 * ratio, 0)::INT || ' percent; most salient aggregate was ' || replace(name, '_', ' ') || ', ' || CASE WHEN percentile < 5 THEN 'far below the training reference'
  WHEN percentile < 25 THEN 'below the training reference' WHEN percentile <= 75 THEN 'within the central training-reference range' WHEN percentile < 95 THEN 'above the training reference' ELSE 'far above the training reference' END || ' at median percentile ' || round_even(percentile, 0)::INT || ' across ' || n || ' windows.' AS line FROM b""", "units", "observations")
def v3(spark, d):
    u = v.units(spark, d).filter("modality = 'audio'")
    own = u.groupBy("session_id", "segment_id").agg(F.count("*").alias("units"), F.count_if(F.col("availability") != "unavailable").alias("available"), F.median("valid_ratio").alias("ratio"))
    best = evidence.aggregate_observation(u, v.observations(spark, d), ["session_id", "segment_id"], PRIORITIES)
    c = F.col
    return own.join(best, ["session_id", "segment_id"], "left").select("session_id", "segment_id", evidence.modality_line("audio", c("units"), c("available"), c("ratio"), c("name"), c("percentile"), c("n")).alias("line"))


@query("v7_measurement_phrases", f"""SELECT unit_id, name, upper(replace(name, '_', ' ')[1]) || substr(replace(name, '_', ' '), 2) || ' ' || CASE WHEN percentile IS NULL THEN 'had no fitted training reference' ELSE 'was ' || replace(category, '_', ' ') || ' at training-reference percentile ' || round_even(percentile, 0)::INT END || '; measured value '
  || CASE unit WHEN 'ratio' THEN {_NUMBER_SQL('100 * value', 4)} || ' percent' ELSE {_NUMBER_SQL('value', 4)} || ' ' || replace(unit, '_', ' ') END || '. Reliability: ' || reliability || CASE WHEN reliability IN ('direct', 'derived') THEN ' measurement.' ELSE '; signal pattern only.' END
  || CASE WHEN subject_z >= 2 THEN ' It was above this session''s usual level.' WHEN subject_z <= -2 THEN ' It was below this session''s usual level.' ELSE '' END AS phrase FROM observations""", "units", "observations")
def v7(spark, d):
    """V7 and V11."""
    c = F.col
    phrase = evidence.measurement_phrase(c("name"), c("value"), c("unit"), c("percentile"), c("category"), c("reliability"), c("subject_z"))
    return v.observations(spark, d).select("unit_id", "name", phrase.alias("phrase"))
