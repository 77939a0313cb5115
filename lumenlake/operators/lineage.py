"""Checks of what runs, freezes and manifests claim, and small views that belong to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that a data set may go by. Fixed values.
ALIASES = {"daic": "daic_woz", "daicwoz": "daic_woz", "daic_woz": "daic_woz", "daic-woz": "daic_woz", "edaic": "e_daic", "e_daic": "e_daic", "e-daic": "e_daic", "dvlog": "d_vlog", "d_vlog": "d_vlog", "d-vlog": "d_vlog"}
#: Keys of a configuration that do not change a reference.
IRRELEVANT = ("max_sessions", "output_dir", "workers", "renderer")
#: How a reviewed decision ends.
OUTCOMES = {"preserved": "accepted_preserved", "revised": "accepted_revised", "unresolved": "referred_unresolved"}
DECISION_FIELDS = ("should_rethink", "trigger_score", "reasons", "selected_segment_ids", "metrics")


def dataset_name(value: Column) -> Column:
    """The data set that a name stands for; null for an unknown one."""
    names = F.create_map(*[x for a, b in ALIASES.items() for x in (F.lit(a), F.lit(b))])
    return F.try_element_at(names, F.lower(F.trim(value)))


def config_problem(window: Column, stride: Column, tail: Column, least_ratio: Column) -> Column:
    """What a windowing configuration breaks, or null."""
    ok = lambda c: F.coalesce((c > 0) & ~F.isnan(c) & (c < float("inf")), F.lit(False))
    return (
        F.when(~ok(window), "window").when(~ok(stride) | (stride > window), "stride").when(~F.coalesce((tail >= 0) & (tail <= window), F.lit(False)), "min_tail").when(~F.coalesce(least_ratio.between(0, 1), F.lit(False)), "ratio")
    )


def relevant_configuration(config: dict) -> dict:
    return {k: v for k, v in config.items() if k not in IRRELEVANT}


def canonical_digest(value: dict) -> str:
    """SHA-256 of a configuration as compact JSON with sorted keys; its first 16 digits name a reference."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def ids_digest(ids: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """``n, digest`` of a set of ids, whatever their order: digests of ranges of the ids' own digests, then of these.

    No task joins more ids than a range holds, one of 16 to the power of ``digits``.
    """
    own = ids.select(F.col(key).cast("string").alias("_k")).distinct()
    each = own.groupBy(F.substring(F.sha2("_k", 256), 1, digits).alias("_r")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_k")), "\n"), 256).alias("_d"))
    return each.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))


def reservoir(rows: DataFrame, keys: list[str], row_id: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, chosen alike by a hash of seed and row: a uniform sample that every
    rerun repeats. Ranks are cut in each partition before the shuffle."""
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(h, row_id))).filter(F.col("_n") <= most).drop("_n")


def row_slices(windows: DataFrame) -> DataFrame:
    """``first_row, end_row`` of windows over one row a second: from the floor of the start to the ceiling of the end."""
    return windows.withColumns({"first_row": F.floor("start_sec"), "end_row": F.ceil("end_sec")})


def session_durations(sources: list[DataFrame]) -> DataFrame:
    """``session_id, duration``: the largest time that any source (session_id, t) has."""
    out = sources[0].select("session_id", "t")
    for other in sources[1:]:  # a fixed few
        out = out.unionByName(other.select("session_id", "t"))
    return out.groupBy("session_id").agg(F.max("t").alias("duration"))


def missing_reasons(rows: Column, valid: Column, ratio: Column, reasons: Column, partial: str, failed: str = "face_tracking_failure") -> Column:
    """The overlaps' reasons and at most one of the window's own: nothing recorded, nothing valid, or too little."""
    own = F.when(rows == 0, "source_ended_before_window").when(valid == 0, failed).when(ratio < 0.8, partial)
    return F.filter(F.concat(F.coalesce(reasons, F.array().cast("array<string>")), F.array(own)), lambda r: r.isNotNull() & (r != ""))


def evidence_view(lines: DataFrame, view: str) -> DataFrame:
    """Lines of session texts for ``full``, ``audio`` or ``visual``: a segment's line keeps its first four fields and the
    view's own summary."""
    if view == "full":
        return lines
    fields = F.transform(F.split("value", r"\|"), lambda f: F.trim(f))
    kept = F.concat(F.slice(fields, 1, 4), F.filter(F.slice(fields, 5, 100), lambda f: f.startswith(f"{view.upper()} summary;")))
    return lines.withColumn("value", F.when(F.col("value").startswith("SEGMENT S"), F.array_join(kept, " | ")).otherwise(F.col("value")))


def feature_view(features: DataFrame, view: str) -> DataFrame:
    """Long features (session_id, feature, value) of one modality and the session's own; ``full`` keeps all."""
    return features if view == "full" else features.filter(F.col("feature").startswith(f"{view}.") | F.col("feature").startswith("session."))


def window_units(windows: DataFrame, measured: DataFrame, modalities: list[str]) -> DataFrame:
    """A unit for each window (session_id, window_index) and modality, measured (..., modality, valid_ratio) or not."""
    grid = windows.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in modalities])))
    both = grid.join(measured, ["session_id", "window_index", "modality"], "left")
    ratio = F.coalesce("valid_ratio", F.lit(0.0))
    return both.withColumns({"valid_ratio": ratio, "availability": F.when(ratio <= 0, "unavailable").when(ratio < 0.8, "partial").otherwise("present")})


def triple_join(raw: DataFrame, plans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions that all three know, and that each knows once (repeats are an error)."""
    for name, df in (("raw", raw), ("plan", plans), ("decision", decisions)):
        once = df.groupBy("session_id").agg(F.count("*").alias(f"_{name}"))
        raw = raw.join(once, "session_id")
    odd = (F.col("_raw") != 1) | (F.col("_plan") != 1) | (F.col("_decision") != 1)
    checked = raw.withColumn("session_id", F.when(~odd, F.col("session_id")).otherwise(F.raise_error(F.concat(F.lit("repeated session "), F.col("session_id").cast("string"))).cast(raw.schema["session_id"].dataType)))
    return checked.drop("_raw", "_plan", "_decision").join(plans, "session_id").join(decisions, "session_id")


def frozen_with_labels(freeze: DataFrame, labels: DataFrame) -> DataFrame:
    """The frozen test predictions with their labels, in the order (``place``) of the official file; a session on one side
    only is an error."""
    both = labels.select("session_id", "place", F.col("label").alias("_y")).join(freeze.drop("label"), "session_id", "full")
    whole = F.col("_y").isNotNull() & F.col("probability").isNotNull()
    return both.withColumn("label", F.when(whole, F.col("_y")).otherwise(F.raise_error(F.concat(F.lit("cohorts differ at "), F.col("session_id").cast("string"))).cast("int"))).drop("_y")


def seed_freeze(predictions: DataFrame, seeds: list[int]) -> DataFrame:
    """``session_id, split, label, probability`` over seeds, each of which must have the session; test labels are null."""
    s = predictions.groupBy("session_id", "split").agg(F.countDistinct("seed").alias("n"), F.avg("probability").alias("probability"), F.max("label").alias("y"), F.min("label").alias("z"))
    good = (F.col("n") == len(seeds)) & (F.coalesce("y", F.lit(-1)) == F.coalesce("z", F.lit(-1)))
    checked = F.when(good, F.col("probability")).otherwise(F.raise_error(F.concat(F.lit("seeds differ at "), F.col("session_id").cast("string"))).cast("double"))
    return s.select("session_id", "split", F.when(F.col("split") != "test", F.col("y")).alias("label"), checked.alias("probability"))


def freeze_violations(freeze: DataFrame, predictions: DataFrame, threshold: float, tolerance: float = 1e-15) -> DataFrame:
    """Frozen rows whose probability is not the mean of the seeds, whose decision does not follow, or that show a test label."""
    mean = predictions.groupBy("session_id").agg(F.avg("probability").alias("_m"))
    rows = freeze.join(mean, "session_id", "left")
    reason = (
        F.when(F.col("_m").isNull() | (F.abs(F.col("probability") - F.col("_m")) > tolerance), "not_the_mean").when(F.col("predicted") != (F.col("probability") >= threshold).cast("int"), "decision_differs")
        .when((F.col("split") == "test") & F.col("label").isNotNull(), "label_shown")
    )
    return rows.select("session_id", reason.alias("reason")).filter("reason is not null")


def oof_violations(folds: DataFrame, expected: DataFrame) -> DataFrame:
    """What is wrong with out-of-fold predictions (session_id, fold, held_out_fold, label) of ``expected`` sessions:
    missing, repeated, unknown, from another fold, or of another label."""
    own = folds.groupBy("session_id").agg(F.count("*").alias("n"), F.bool_or(F.col("fold") != F.col("held_out_fold")).alias("odd"), F.max("label").alias("y"))
    both = own.join(expected.select("session_id", F.col("label").alias("z"), F.lit(True).alias("known")), "session_id", "full")
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.col("odd"), "not_held_out").when(F.col("y") != F.col("z"), "label_differs")
    return both.select("session_id", reason.alias("reason")).filter("reason is not null")


def label_mismatches(scores: DataFrame, threshold: int = 10, most: int = 24) -> DataFrame:
    """Rows (session_id, score, released) whose score is no whole number of 0 to ``most``, or whose released binary label
    disagrees with the score: the score decides, the label is only audited."""
    s = F.col("score")
    whole = F.coalesce((s == F.floor(s)) & s.between(0, most), F.lit(False))
    reason = F.when(~whole, "bad_score").when(F.col("released").isNotNull() & (F.col("released") != (s >= threshold).cast("int")), "released_label_differs")
    return scores.select("session_id", reason.alias("reason")).filter("reason is not null")


def label_policy(dataset: str, column: str, threshold: float | None) -> None:
    """Raises unless the target is the score column of the data set at 10 or above."""
    wanted = {"daic_woz": "phq8_score", "e_daic": "phq_score"}[dataset]
    if column.strip().lower() != wanted or threshold is None or not math.isfinite(threshold) or threshold != 10:
        raise ValueError(f"{dataset} takes {wanted} at 10 or above as its target")


def provenance_violations(manifests: DataFrame, fit_ids: DataFrame) -> DataFrame:
    """Folds whose sessions (fold, session_id, reference_id) name several references, or whose reference was fitted on
    other sessions (fold, reference_id, session_id) than the fold's fit part (``role`` fit)."""
    several = manifests.groupBy("fold").agg(F.countDistinct("reference_id").alias("n")).filter("n > 1").select("fold", F.lit("several_references").alias("reason"))
    own = manifests.filter("role = 'fit'").select("fold", "session_id")
    fitted = fit_ids.select("fold", "session_id")
    diff = own.join(fitted, ["fold", "session_id"], "left_anti").unionByName(fitted.join(own, ["fold", "session_id"], "left_anti"))
    return several.unionByName(diff.select("fold").distinct().withColumn("reason", F.lit("fitted_on_others")))


def identity_violations(records: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Manifest rows with another data set or protocol than expected: ``session_id, field, value``."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"), F.lit(v).alias("want")) for k, v in expected.items()])
    return records.select("session_id", F.explode(cells).alias("c")).select("session_id", "c.*").filter("not (value <=> want)").select("session_id", "field", "value")


def metric_violations(reported: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Reported metrics (keys, metric, value) that differ from those computed again: ``keys, metric``."""
    both = reported.join(computed.withColumnRenamed("value", "_v"), [*keys, "metric"], "full")
    near = F.abs(F.col("value") - F.col("_v")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("_v")))
    return both.filter(~F.coalesce(near, F.lit(False))).select(*keys, "metric")


def prediction_violations(rows: DataFrame, splits: list[str]) -> DataFrame:
    """Predictions of an unknown split, a probability outside 0 to 1, or a test label shown: ``session_id, reason``."""
    good = F.coalesce(F.col("probability").between(0, 1), F.lit(False))
    reason = F.when(~F.col("split").isin(*splits), "unknown_split").when(~good, "bad_probability").when((F.col("split") == "test") & F.col("label").isNotNull(), "label_shown")
    return rows.select("session_id", reason.alias("reason")).filter("reason is not null")


def prediction_rows(examples: DataFrame, threshold: float, origin: str) -> DataFrame:
    """Predictions with their decision and where they come from."""
    return examples.select("session_id", "label", "probability", F.lit(threshold).alias("threshold"), (F.col("probability") >= threshold).cast("int").alias("predicted_label"), F.lit(origin).alias("prediction_origin"))


def with_transcripts(records: DataFrame, transcripts: DataFrame, marker: str, tiers: list[str]) -> DataFrame:
    """Records with their transcript tiers, or the marker in every tier where a session has none."""
    both = records.join(transcripts, "session_id", "left")
    return both.select(*records.columns, *[F.coalesce(F.col(t), F.lit(marker)).alias(t) for t in tiers])


def token_summary(rows: DataFrame) -> DataFrame:
    """``tier, n, least, most`` of token counts by tier."""
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))


def token_audit(lines: DataFrame, count: Column, limit: int) -> DataFrame:
    """Per session the tokens of its lines (``count`` of a line), the longest line, and whether all fit."""
    own = lines.withColumn("_t", count).groupBy("session_id").agg(F.count("*").alias("lines"), F.sum("_t").alias("tokens"), F.max("_t").alias("longest"))
    return own.withColumn("fits", F.col("tokens") <= limit)


def plan_violations(plans: DataFrame, available: DataFrame) -> DataFrame:
    """Plans (session_id, fold, route, segment_ids) that ask for unknown segments, and folds with several routes."""
    have = available.groupBy("session_id").agg(F.collect_set("segment_id").alias("have"))  # a few segments a session
    odd = plans.join(have, "session_id", "left").filter(F.size(F.array_except("segment_ids", F.coalesce("have", F.array().cast("array<string>")))) > 0)
    routes = plans.groupBy("fold").agg(F.countDistinct("route").alias("n")).filter("n > 1")
    return odd.select(F.col("session_id").cast("string").alias("key"), F.lit("unknown_segment").alias("reason")).unionByName(routes.select(F.col("fold").cast("string").alias("key"), F.lit("several_routes").alias("reason")))


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def query_is_grounded(slots: Column, segment: Column, pattern_count: Column, prompt: Column) -> Column:
    """Whether a query's slots and segment stand in its prompt and its pattern occurs there at all."""
    return F.forall(slots, lambda s: F.contains(prompt, s)) & F.contains(prompt, segment) & (pattern_count > 0)


def selection_is_grounded(picked: Column, shown: Column, budget: int) -> Column:
    """Whether a selection names shown cards only, each once, within the budget."""
    return (F.size(F.array_except(picked, shown)) == 0) & (F.size(picked) == F.size(F.array_distinct(picked))) & (F.size(picked) <= budget)


def fits_without_cut(prompt_tokens: Column, answer_tokens: Column, limit: int) -> Column:
    """Whether prompt and answer fit whole; nothing is ever cut."""
    return prompt_tokens + answer_tokens <= limit


def outcome(status: Column) -> Column:
    """How a review of that status ends; a missing one refers."""
    out = F.lit("referred_unresolved")
    for name, value in OUTCOMES.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def seal_violations(events: DataFrame) -> DataFrame:
    """Runs (run_id, order_key, event_type, outcome, status) sealed with an outcome that their revision does not allow."""
    e = events.groupBy("run_id").agg(F.max(F.when(F.col("event_type") == "agent_closed", F.col("outcome"))).alias("o"), F.max(F.when(F.col("event_type") == "revision_recorded", F.col("status"))).alias("s"), F.count_if(F.col("event_type") == "evidence_released").alias("r"))
    reason = F.when(F.col("o").isNull(), "not_sealed").when(F.col("s").isNotNull() & (F.col("r") == 0), "revision_without_release").when(F.col("o") != outcome(F.col("s")), "outcome_differs")
    return e.select("run_id", reason.alias("reason")).filter("reason is not null")


def initial_problem(probability: Column, anchor: Column, cited: Column, allowed: Column) -> Column:
    """What a first assessment breaks: it must keep its anchor, and name allowed ids only."""
    return F.when(~F.coalesce(F.abs(probability - anchor) <= 1e-8, F.lit(False)), "anchor_moved").when(F.size(F.array_except(cited, allowed)) > 0, "id_not_allowed")


def slot_descriptions(profiles: DataFrame, definitions: DataFrame, sources: list[str]) -> DataFrame:
    """``source_id, description`` (JSON) of the requested sources; an unknown one is an error."""
    wanted = profiles.sparkSession.createDataFrame([(s,) for s in sources], "source_id string")
    own = profiles.join(F.broadcast(definitions), ["modality", "slot_id"]).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("slot_id", "label", "observation_name"))).alias("slots"))
    both = wanted.join(own, "source_id", "left")
    fail = F.raise_error(F.concat(F.lit("unknown source "), F.col("source_id"))).cast("string")
    return both.select("source_id", F.when(F.col("slots").isNotNull(), F.to_json("slots")).otherwise(fail).alias("description"))


def decision_payload(text: Column) -> Column:
    """The allowed fields of a decision's JSON, as a map of JSON values; null where it names a label."""
    from lumenlake.functions.json import names_label

    fields = [F.struct(F.lit(k).alias("key"), F.get_json_object(text, f"$.{k}").alias("value")) for k in DECISION_FIELDS]
    kept = F.filter(F.array(*fields), lambda x: x["value"].isNotNull())
    return F.when(~names_label(text), F.map_from_entries(kept))
