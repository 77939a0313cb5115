"""Session views put together from the other operators, and decisions about what to reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.transcripts import chosen_utterances, cue_counts, shortened


def overview(segments: DataFrame, lines: DataFrame, utterances: DataFrame) -> DataFrame:
    """The first look at a session: for each chosen segment (session_id, segment_id, segment_no) its modality lines
    (session_id, segment_id, line) and its cue families with counts, as ``session_id, segment_no, text``.

    No id of an atom or utterance is told. A segment has a few lines.
    """
    told = lines.groupBy("session_id", "segment_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("_l"))
    cues = cue_counts(utterances, ["session_id", "segment_id"]).groupBy("session_id", "segment_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("family", F.lit(": "), F.col("n").cast("string")))), "; ").alias("_c"))
    both = segments.join(told, ["session_id", "segment_id"], "left").join(cues, ["session_id", "segment_id"], "left")
    text = F.concat_ws("\n", F.concat(F.lit("SEGMENT "), "segment_id"), F.col("_l"), F.coalesce(F.concat(F.lit("Cues: "), "_c"), F.lit("Cues: none")))
    return both.select("session_id", "segment_no", text.alias("text"))


def transcript_detail(utterances: DataFrame, seen: DataFrame, keys: list[str], most: int, length: int) -> DataFrame:
    """``keys, utterance_id, line`` of the chosen utterances that were not shown before, with their speaker, cut at a word."""
    new = utterances.join(seen.select("session_id", "utterance_id").distinct(), ["session_id", "utterance_id"], "left_anti")
    label = F.when(F.col("speaker_role") == "unassigned", "speaker").otherwise(F.col("speaker_role"))
    return chosen_utterances(new, keys, most).select(*keys, "utterance_id", F.concat(label, F.lit(": "), shortened(F.col("text"), length)).alias("line"))


def review(sessions: DataFrame, atoms: DataFrame, utterances: DataFrame, seen_atoms: DataFrame, seen_utterances: DataFrame) -> DataFrame:
    """``session_id, new_atoms, new_utterances, novelty``: what a second look adds; novelty is 1 if all is new, which it is
    for any addition, and 0 for none."""
    a = atoms.join(seen_atoms.select("session_id", "atomic_id").distinct(), ["session_id", "atomic_id"], "left_anti").groupBy("session_id").agg(F.count("*").alias("new_atoms"))
    u = utterances.join(seen_utterances.select("session_id", "utterance_id").distinct(), ["session_id", "utterance_id"], "left_anti").groupBy("session_id").agg(F.count("*").alias("new_utterances"))
    both = sessions.select("session_id").distinct().join(a, "session_id", "left").join(u, "session_id", "left").fillna(0, ["new_atoms", "new_utterances"])
    return both.withColumn("novelty", F.when(F.col("new_atoms") + F.col("new_utterances") > 0, 1.0).otherwise(0.0))


def loaded_utterances(rows: DataFrame, role: str, digest: Column) -> DataFrame:
    """Utterances of the expected role with their place by midpoint, start and id; a text that does not have its recorded
    ``sha256`` is an error."""
    own = rows.filter(F.col("speaker_role") == role)
    whole = F.coalesce(digest == F.sha2("text", 256), F.lit(False))
    checked = own.withColumn("text", F.when(whole, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("text changed: "), F.col("utterance_id").cast("string")))))
    w = Window.partitionBy("session_id").orderBy((F.col("start_sec") + F.col("end_sec")) / 2, "start_sec", "utterance_id")
    return checked.withColumn("place", F.row_number().over(w))


def ordered_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms with their place in the segment by midpoint, start and number."""
    w = Window.partitionBy("session_id", "segment_id").orderBy("mid", "start_sec", "atomic_no")
    return atoms.withColumn("place", F.row_number().over(w))


def targeted(chosen: DataFrame, lines: DataFrame) -> DataFrame:
    """``session_id, segment_id, text`` of chosen atoms (session_id, segment_id, atomic_no) from the lines of their units, in
    order; a choice is of a few atoms."""
    both = chosen.join(lines, ["session_id", "atomic_no"]).groupBy("session_id", "segment_id")
    return both.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atomic_no", "unit_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def atomic_records(projected: DataFrame, units: DataFrame) -> DataFrame:
    """``session_id, atomic_no, record``: JSON of an atom's sources, each with its availability and slots (a few)."""
    cells = F.array_sort(F.collect_list(F.struct("slot_id", "status", "value", "percentile")))
    own = projected.groupBy("unit_id").agg(cells.alias("slots"))
    rows = units.join(own, "unit_id", "left").groupBy("session_id", "atomic_no").agg(F.array_sort(F.collect_list(F.struct("modality", "source_id", "availability", "slots"))).alias("sources"))
    return rows.select("session_id", "atomic_no", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"}).alias("record"))


def segment_records(aggregated: DataFrame, modality: Column) -> DataFrame:
    """``session_id, segment_id, record``: JSON of a segment's sources, audio first, each with its slots (a few)."""
    per = aggregated.groupBy("session_id", "segment_id", (modality != "audio").cast("int").alias("_m"), "source_id").agg(F.array_sort(F.collect_list(F.struct("slot_id", "measured", "units"))).alias("slots"))
    rows = per.groupBy("session_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("_m", "source_id", "slots"))).alias("s"))
    kept = F.transform("s", lambda x: F.struct(x["source_id"].alias("source_id"), x["slots"].alias("slots")))
    return rows.select("session_id", "segment_id", F.to_json(F.struct(kept.alias("sources"))).alias("record"))


def transcript_summary(utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of each session (utterances, scrubbed, characters, seconds), and their sums."""
    each = utterances.groupBy("session_id").agg(F.count("*").alias("utterances"), F.count_if("privacy_scrubbed").alias("scrubbed"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("seconds"))
    return each, each.agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("utterances", "scrubbed", "characters", "seconds")])


def listed_sessions(files: DataFrame, pattern: str) -> DataFrame:
    """``session_id``: the first group of ``pattern`` in the files' paths, each once."""
    return files.select(F.regexp_extract("path", pattern, 1).alias("session_id")).filter("session_id <> ''").distinct()


def prepared_violations(files: DataFrame, forbidden: list[str]) -> DataFrame:
    """``name, reason`` of prepared files (name, columns, rows, expected_rows, sha256, expected_sha256) that show a label
    column, or whose rows or digest differ from the manifest."""
    shown = F.exists("columns", lambda c: F.lower(F.trim(c)).isin(*forbidden))
    reason = F.when(F.col("name").startswith("test") & shown, "label_shown").when(F.col("rows") != F.col("expected_rows"), "rows_differ").when(~(F.col("sha256").eqNullSafe(F.col("expected_sha256"))), "digest_differs")
    return files.select("name", reason.alias("reason")).filter("reason is not null")


def metadata_violations(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Runs (run_id, reference_id, protocol) whose reference (reference_id, protocol) is unknown or of another protocol."""
    both = runs.join(references.select("reference_id", F.col("protocol").alias("_p")), "reference_id", "left")
    reason = F.when(F.col("_p").isNull(), "unknown_reference").when(F.col("_p") != F.col("protocol"), "protocol_differs")
    return both.select("run_id", reason.alias("reason")).filter("reason is not null")


def fold_assignment(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """``session_id, role`` of one fold (holdout or fit), without any label, and the counts by role and class."""
    role = F.when(F.col("fold") == fold, "holdout").otherwise("fit")
    return folds.select("session_id", role.alias("role")), folds.groupBy(role.alias("role"), "label").agg(F.count("*").alias("n"))


def to_run(planned: DataFrame, stored: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """Planned arms that must be run, and the stored results that are reused: those whose ``identity`` is the same."""
    keys = ["session_id", "arm_id"]
    return planned.join(stored.select(*keys, *identity), [*keys, *identity], "left_anti"), stored.join(planned.select(*keys, *identity), [*keys, *identity], "left_semi")


def evidence_identity(manifests: DataFrame, summaries: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``session_id`` with the digests of its evidence, training summary (by fold) and transcript; a missing one is an error."""
    both = manifests.join(summaries, "fold", "left").join(transcripts, "session_id", "left")
    whole = F.col("summary_sha256").isNotNull() & F.col("transcript_sha256").isNotNull()
    checked = F.when(whole, F.col("evidence_sha256")).otherwise(F.raise_error(F.concat(F.lit("incomplete identity of "), F.col("session_id").cast("string"))))
    return both.select("session_id", checked.alias("evidence_sha256"), "summary_sha256", "transcript_sha256")


def comparison_violations(summary: DataFrame, threshold: float, least: int) -> DataFrame:
    """``dataset, reason`` of comparison summaries (dataset, threshold, participants, boundary) that cannot be used."""
    reason = F.when(F.col("threshold") != threshold, "threshold_differs").when(F.col("participants") < least, "too_few").when(F.col("boundary") != "out_of_fold", "boundary_differs")
    return summary.select("dataset", reason.alias("reason")).filter("reason is not null")


def source_assessment(probability: Column, reliability: Column) -> Column:
    """A source's status, risk and reliability; without any reliability it is unavailable and has no values."""
    there = F.coalesce(reliability > 0, F.lit(False))
    return F.struct(F.when(there, "available").otherwise("unavailable").alias("status"), F.when(there, probability).alias("risk_probability"), F.when(there, F.least(F.lit(1.0), reliability)).alias("reliability"))


def filled_segments(groups: list[Column], all_ids: Column, most: int) -> Column:
    """Segments by priority of their groups, filled up with the others in order."""
    own = F.filter(F.array_distinct(F.flatten(F.array(*groups))), lambda x: F.array_contains(all_ids, x))
    return F.slice(F.array_union(own, all_ids), 1, most)


def session_texts(evidence: DataFrame, transcripts: DataFrame, tier: str, marker: str) -> DataFrame:
    """``session_id, text``: the evidence text with a tier of the transcript, or the marker where there is none."""
    both = evidence.join(transcripts.select("session_id", F.col(tier).alias("_t")), "session_id", "left")
    return both.select("session_id", F.concat(F.rtrim("text"), F.lit("\n\nTRANSCRIPT\n"), F.coalesce("_t", F.lit(marker)), F.lit("\n")).alias("text"))


def resolved_files(sources: DataFrame, derived: DataFrame) -> DataFrame:
    """``name, path``: the derived file where it was made of the source's present content, else the source itself."""
    both = sources.join(derived.select("name", F.col("path").alias("_d"), "source_sha256"), "name", "left")
    same = F.coalesce(F.col("source_sha256") == F.col("sha256"), F.lit(False))
    return both.select("name", F.when(same, F.col("_d")).otherwise(F.col("path")).alias("path"))


def appended(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger entries for new events (run_id, order_key, payload) that go on from each run's last entry.

    The existing rows are chained before the new ones and left out of the result, so sequence and
    hash follow; a ledger that was tampered with does not verify together with what is appended.
    """
    from lumenlake.operators.records import chain

    old = ledger.select("run_id", F.struct(F.lit(0).alias("new"), F.col("sequence").cast("long").alias("at")).alias("order_key"), "payload")
    new = events.select("run_id", F.struct(F.lit(1).alias("new"), F.col("order_key").cast("long").alias("at")).alias("order_key"), "payload")
    have = ledger.groupBy("run_id").agg(F.count("*").alias("_n"))
    return chain(old.unionByName(new)).join(have, "run_id", "left").filter(F.col("sequence") >= F.coalesce("_n", F.lit(0))).drop("_n")
