"""Evidence units as text, word for word: one line of fields, and prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import safe_token
from lumenlake.operators.evidence import rendered_observations
from lumenlake.operators.windowing import format_time

#: How measurements are called where that is not their name with blanks. Fixed values.
DISPLAY_NAMES = {
    "participant_speaking_ratio": "participant speaking coverage", "transcribed_speech_ratio": "transcribed speech coverage (speaker unassigned)", "voiced_activity_ratio": "voiced-frame coverage",
    "jitter_level": "local jitter level", "shimmer_level": "local shimmer level", "naq_level": "normalized amplitude quotient", "qoq_level": "quasi-open quotient", "h1h2_level": "H1-H2 level",
    "psp_level": "parabolic spectral parameter", "mdq_level": "maxima dispersion quotient", "peak_slope_level": "peak-slope level", "rd_level": "glottal Rd level", "creak_activity": "COVAREP creak measurement",
    "facial_action_activity": "facial-action activation", "facial_action_variability": "facial-action variability", "facial_action_change_magnitude": "facial-action change magnitude", "facial_action_presence_ratio": "detected facial-action coverage",
    "au04_intensity": "AU04 intensity", "au12_intensity": "AU12 intensity", "au15_intensity": "AU15 intensity", "au25_intensity": "AU25 intensity",
    "head_motion_variability": "head-rotation variability", "head_rotation_range": "head-rotation range", "head_rotation_speed": "head-rotation speed",
    "gaze_horizontal_angle": "horizontal gaze angle", "gaze_vertical_angle": "vertical gaze angle", "gaze_direction_variability": "gaze-direction variability",
    "facial_landmark_shape_change": "facial-landmark shape change", "facial_shape_variability": "facial-shape variability", "mouth_region_shape_variability": "mouth-region shape variability",
    "eye_region_shape_variability": "eye-region shape variability", "mouth_opening": "mouth opening distance",
}
#: Where a category stands to the reference. Fixed values.
CATEGORY_WORDS = {"very_low": "far below", "low": "below", "typical": "within the central range of", "high": "above", "very_high": "far above"}
#: Why something is missing. Fixed values.
REASON_WORDS = {
    "source_ended_before_window": "the released source ended before this window", "invalid_acoustic_values": "the acoustic values were invalid", "face_detection_failure": "face detection failed",
    "partial_face_detection_failure": "face detection failed for part of the window", "face_tracking_failure": "face tracking failed", "partial_face_tracking": "face tracking was incomplete",
    "partial_acoustic_features": "the acoustic source was incomplete", "speaker_alignment_unavailable": "speaker alignment was unavailable", "transcript_alignment_unavailable": "transcript time alignment was unavailable",
    "privacy_scrubbed": "the interval overlaps privacy-scrubbed material", "technical_interruption": "the interval overlaps a documented technical interruption",
    "external_interruption": "the interval overlaps a documented external interruption", "no_valid_measurements": "no valid measurements were available",
}


def _named(value: Column, names: dict[str, str]) -> Column:
    """A value's words, or the value with blanks."""
    out = F.replace(value, F.lit("_"), F.lit(" "))
    for k, words in names.items():
        out = F.when(value == k, words).otherwise(out)
    return out


def _number(value: Column, digits: int) -> Column:
    fixed = F.format_string(f"%.{digits}f", value)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")).otherwise("null")


def _finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _joined(parts: list[Column], by: str) -> Column:
    """Parts that are not null."""
    return F.concat_ws(by, *parts)


def unit_texts(units: DataFrame, observations: DataFrame, priorities: dict[str, int], most: int = 8) -> DataFrame:
    """``unit_id, dsl, prose`` of units (unit_id, dataset, start_sec, end_sec, modality, source_id, extractor, availability,
    quality, valid_ratio, privacy_scrubbed, reasons) with the best ``most`` of their observations in order.

    A unit has a few dozen observations at most. A null extractor is told by the source; missing
    quality and availability are ``unknown`` and ``unavailable``. Numbers are rounded from their
    shortest decimal form. Neither side of a join is broadcast, however few units Spark expects.
    """
    c = F.col
    level = F.when(c("category") == "unreferenced", F.lit("")).otherwise(c("category"))
    fields = F.concat(
        c("name"), F.lit("="), _number(c("value"), 3), F.lit(":"), safe_token(c("unit")), F.lit("["),
        _joined([F.concat(F.lit("category="), "category"), F.concat(F.lit("p="), F.bround("percentile").cast("int").cast("string")), F.when(c("robust_z").isNotNull(), F.concat(F.lit("z="), _number(c("robust_z"), 2))), F.when(c("subject_z").isNotNull(), F.concat(F.lit("subject_z="), _number(c("subject_z"), 2))), F.concat(F.lit("reliability="), "reliability")], ","), F.lit("]"),
    )
    words = F.lit(None).cast("string")
    for k, w in CATEGORY_WORDS.items():
        words = F.when(level == k, w).otherwise(words)
    known = F.concat(F.lit(" was "), words, F.lit(" the source-specific training reference"), F.coalesce(F.concat(F.lit(" (percentile "), F.bround("percentile").cast("int").cast("string"), F.lit(")")), F.lit("")))
    phrase = F.concat(
        _named(c("name"), DISPLAY_NAMES), F.when(level == "", " had no fitted training reference").otherwise(known),
        F.when(c("unit") == "ratio", F.concat(F.lit(", with a measured value of "), F.format_string("%.1f%%", 100 * c("value")))).otherwise(""),
        F.when(c("reliability").isin("weak", "latent"), F.concat(F.lit(" ["), "reliability", F.lit("-reliability pattern]"))).otherwise(""),
    )
    n = observations.groupBy("unit_id").agg(F.count("*").alias("_all"))
    list_ = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c(name)))), lambda x: x[name]), "; ").alias(name)
    shown = rendered_observations(observations, priorities, most).withColumns({"_fields": fields, "_phrases": phrase})
    told = shown.groupBy("unit_id").agg(list_("_fields"), list_("_phrases"), F.count("*").alias("_shown")).hint("merge").join(n, "unit_id")
    start, end, status, quality = format_time(c("start_sec")), format_time(c("end_sec")), F.coalesce("availability", F.lit("unavailable")), F.coalesce("quality", F.lit("unknown"))
    some = F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0
    dsl = F.concat(
        F.lit("["), _joined([safe_token(c("dataset")), F.concat(start, F.lit("-"), end), F.upper("modality"), safe_token(c("source_id")), F.concat(F.lit("id="), c("unit_id").cast("string"))], "|"), F.lit("] "),
        _joined([
            F.concat(F.lit("availability="), safe_token(status)), F.concat(F.lit("quality="), safe_token(quality)), F.when(_finite(c("valid_ratio")), F.concat(F.lit("valid_ratio="), _number(c("valid_ratio"), 3))),
            F.when(c("privacy_scrubbed"), "privacy_scrubbed=true"), F.when(some, F.concat(F.lit("missing="), F.array_join(F.transform("reasons", safe_token), ","))),
            c("_fields"), F.when(c("_shown") < c("_all"), F.concat(F.lit("observations_shown="), c("_shown").cast("string"), F.lit("/"), c("_all").cast("string"))),
        ], "; "), F.lit("."),
    )
    cover = F.when(_finite(c("valid_ratio")), F.concat(F.lit(", with "), F.format_string("%.1f%%", 100 * c("valid_ratio")), F.lit(" valid coverage."))).otherwise(".")
    prose = _joined([
        F.concat(F.lit("Evidence "), c("unit_id").cast("string"), F.lit(", from "), start, F.lit(" to "), end, F.lit(": the "), "modality", F.lit(" measurements from "), F.coalesce("extractor", "source_id", F.lit("feature")), F.lit(" were "), status, F.lit(".")),
        F.when(some, F.concat(F.lit("Availability note: "), F.array_join(F.transform("reasons", lambda r: _named(r, REASON_WORDS)), "; "), F.lit("."))),
        F.when(c("_phrases").isNotNull(), F.concat(F.lit("Observed measurements: "), "_phrases", F.lit("."))).when(status == "unavailable", "No measurement is substituted for the unavailable source."),
        F.concat(F.lit("Source quality was "), F.replace(quality, F.lit("_"), F.lit(" ")), cover),
        F.lit("These statements describe measurements only; no psychological state is inferred."),
    ], " ")
    return units.join(told.hint("merge"), "unit_id", "left").select("unit_id", dsl.alias("dsl"), prose.alias("prose"))


def session_texts(units: DataFrame, lines: DataFrame, line: str) -> DataFrame:
    """``session_id, text``: a session's lines in order of time and unit, each closed by a line break."""
    rows = units.select("unit_id", "session_id", "start_sec").join(lines.select("unit_id", line), "unit_id")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "unit_id", line))), lambda x: F.concat(x[line], F.lit("\n"))), "")
    return rows.groupBy("session_id").agg(whole.alias("text"))


def token_report(lines: DataFrame, overhead: Column, most_session: int = 7500, most_atomic: int = 512, most_segment: int = 768) -> DataFrame:
    """A session's token audit: for the kinds ``atomic`` and ``segment`` of lines (session_id, kind, tokens, unknown) their
    number, fewest, median, 95th percentile and most tokens, what the ``session`` text takes with and without the chat
    template (``overhead`` tokens more), unknown tokens, the four checks, and whether all pass.

    A kind without lines has zeros; null counts are 0. ``overhead`` is a column of the session's
    aggregates, as a literal is.
    """
    n, p = F.coalesce("tokens", F.lit(0)), {}
    for kind in ("atomic", "segment"):
        own = F.when(F.col("kind") == kind, n)
        q = F.percentile(own, F.array(F.lit(0.5), F.lit(0.95)))
        p |= {f"{kind}_count": F.count(own), f"{kind}_min": F.coalesce(F.min(own), F.lit(0)), f"{kind}_median": F.coalesce(q[0], F.lit(0.0)), f"{kind}_p95": F.coalesce(q[1], F.lit(0.0)), f"{kind}_max": F.coalesce(F.max(own), F.lit(0))}
    p["session_tokens"] = F.coalesce(F.sum(F.when(F.col("kind") == "session", n)), F.lit(0))
    p["unknown_tokens"] = F.coalesce(F.sum("unknown"), F.lit(0))
    each = lines.groupBy("session_id").agg(*[c.alias(k) for k, c in p.items()]).withColumn("session_with_template", F.col("session_tokens") + overhead)
    checks = {
        "no_unknown_tokens": F.col("unknown_tokens") == 0, "session_with_chat_template_within_target": F.col("session_with_template") <= most_session,
        "atomic_p95_within_target": F.col("atomic_p95") <= most_atomic, "segment_p95_within_target": F.col("segment_p95") <= most_segment,
    }
    failed = F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return each.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)
