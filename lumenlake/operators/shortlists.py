"""Evidence queries: enumeration, shortlists, choices, release, and replay of what was released.

Scored candidates are rows (session_id, segment_id, query_id, atomic_id, atomic_no, mid, duration,
pattern_relevance, coverage, reliability).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.text import normal_key
from lumenlake.operators.retrieval import candidate_limit, diverse, final_score

#: Temporal patterns in their order, and the modality of the fixed slots of the examples. Fixed values.
PATTERNS = ("extreme", "change point", "cross-modal co-change", "quality boundary", "representative window")


def unseen(atoms: DataFrame, seen: DataFrame) -> DataFrame:
    """Atoms (session_id, atomic_id, ...) that were not released before."""
    return atoms.join(seen.select("session_id", "atomic_id").distinct(), ["session_id", "atomic_id"], "left_anti")


def exclusion_violations(atoms: DataFrame, seen: DataFrame) -> DataFrame:
    """Excluded ids that repeat or that name no atom; must be none."""
    own = seen.groupBy("session_id", "atomic_id").agg(F.count("*").alias("n")).join(atoms.select("session_id", "atomic_id", F.lit(True).alias("known")).distinct(), ["session_id", "atomic_id"], "left")
    reason = F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return own.select("session_id", "atomic_id", reason.alias("reason")).filter("reason is not null")


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds ``score``; candidates that cover no slot are dropped."""
    return candidates.filter("coverage > 0").withColumn("score", F.round(final_score(F.col("pattern_relevance"), F.col("coverage"), F.col("reliability")), 9))


def shortlist(candidates: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """For each query the diverse choice among its ranked candidates, ``pick`` from 1, as many as its budget and
    number of candidates allow."""
    keys = ["session_id", "segment_id", "query_id"]
    rows = ranked(candidates)
    n = F.count("*").over(Window.partitionBy(*keys))
    able = rows.withColumn("_most", candidate_limit(F.lit(most).cast("long"), n, F.lit(budget).cast("long")))
    return diverse(able, keys, min(most, max(2 * budget, budget + 2))).filter(F.col("pick") <= F.col("_most")).drop("_most")


def quality_summary(quality: Column) -> Column:
    return F.when(quality >= 0.8, "good measured coverage").when(quality >= 0.4, "partial measured coverage").otherwise("limited measured coverage")


def cues(pattern: Column, availability_changed: Column, quality: Column) -> Column:
    """Why a candidate is shown, without any value."""
    first = (
        F.when((pattern == "quality boundary") & availability_changed, "measurement availability changes near this window").when(pattern == "quality boundary", "measurement quality changes near this window")
        .when(pattern == "representative window", "target slots are representative of this segment").when(pattern == "cross-modal co-change", "audio and visual target slots have aligned temporal changes")
        .when(pattern == "change point", "target slots change from an earlier window").otherwise("a target slot is unusual relative to the fold reference")
    )
    return F.concat_ws("; ", first, F.when(quality < 0.8, "measurement quality is incomplete and requires review"))


def card(atomic_id: Column, start: Column, end: Column, cue: Column, slots: Column, quality: Column) -> Column:
    """A candidate's card: address, cue and quality; values stay hidden."""
    t = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), r"0+$", ""), r"\.$", "")
    return F.concat(atomic_id, F.lit(" | time "), t(start), F.lit(" to "), t(end), F.lit(" seconds | retrieval cue: "), cue, F.lit(" | requested slots present: "), F.array_join(slots, ", "), F.lit(" | quality: "), quality)


def canonical_names(value: Column, allowed: list[str]) -> Column:
    """The allowed name that ``value`` stands for whatever its case and separators; null for none."""
    keys = F.array(*[normal_key(F.lit(a)) for a in allowed])
    at = F.array_position(keys, normal_key(value))
    return F.when(at > 0, F.element_at(F.array(*[F.lit(a) for a in allowed]), F.when(at > 0, at).otherwise(1).cast("int")))


def enumerated(slots: DataFrame, patterns: list[str]) -> DataFrame:
    """Every query of a segment's slots (session_id, segment_id, slot_id, modality; a few a segment): single slots,
    and for cross-modal patterns each audio slot with each visual one."""
    single = slots.select("session_id", "segment_id", F.array("slot_id").alias("target_slots"))
    by = slots.groupBy("session_id", "segment_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("modality") == m, F.col("slot_id")))).alias(m) for m in ("audio", "visual")])
    pairs = by.select("session_id", "segment_id", F.explode("audio").alias("a"), "visual").select("session_id", "segment_id", "a", F.explode("visual").alias("v")).select("session_id", "segment_id", F.array("a", "v").alias("target_slots"))
    alone, both = [p for p in patterns if not p.startswith("cross-modal")], [p for p in patterns if p.startswith("cross-modal")]
    out = single.withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in alone])))
    return out.unionByName(pairs.withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in both])))) if both else out


def query_scores(shortlisted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, relevance, top_two, n`` of each query's shortlist; queries without relevance are dropped unless they
    ask for a representative window (``pattern``)."""
    s = shortlisted.groupBy(*keys, "pattern").agg(F.max("pattern_relevance").alias("relevance"), F.sum(F.when(F.col("pick") <= 2, F.col("score")).otherwise(0.0)).alias("top_two"), F.count("*").alias("n"))
    return s.filter((F.col("relevance") > 0) | (F.col("pattern") == "representative window"))


def best_per_pattern(scores: DataFrame) -> DataFrame:
    """Each session's best query of each pattern, in an order rotated by the session's hash."""
    w = Window.partitionBy("session_id", "pattern").orderBy(F.desc("relevance"), F.desc("top_two"), F.desc("n"), "target_slots", "segment_id")
    best = scores.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    offset = F.pmod(F.conv(F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(len(PATTERNS)))
    place = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("pattern")) - 1
    return best.withColumn("turn", F.pmod(place - offset, F.lit(len(PATTERNS))))


def best_query(scores: DataFrame) -> DataFrame:
    """Each session's query of most relevance, then of the best two candidates, of most candidates, by name."""
    w = Window.partitionBy("session_id").orderBy(F.desc("relevance"), F.desc("top_two"), F.desc("n"), "pattern", "segment_id", "target_slots")
    return scores.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def random_choice(shortlisted: DataFrame, keys: list[str], budget: int, seed: int) -> DataFrame:
    """``budget`` candidates of each query in the order of a hash: the same on every run."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("atomic_id").cast("string")), 256)
    return shortlisted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(h))).filter(F.col("_n") <= budget).drop("_n")


def top_choice(shortlisted: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` candidates of each query."""
    return shortlisted.filter(F.col("pick") <= budget)


def collection_segments(natural: DataFrame, scores: DataFrame, most: int = 3) -> DataFrame:
    """``session_id, segment_id``: what the trigger chose (session_id, segment_ids), or else the first distinct segments
    of the session's best queries."""
    own = natural.filter("size(segment_ids) > 0").select("session_id", F.explode("segment_ids").alias("segment_id"))
    others = best_per_pattern(scores).join(own.select("session_id").distinct(), "session_id", "left_anti")
    first = others.groupBy("session_id", "segment_id").agg(F.min("turn").alias("t"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("t"))
    return own.unionByName(first.withColumn("_n", rank).filter(F.col("_n") <= most).select("session_id", "segment_id"))


def release_violations(selected: DataFrame, shortlisted: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """``keys, reason`` of selections that name what was not shown, repeat, or exceed the budget; must be none."""
    shown = shortlisted.select(*keys, "atomic_id", F.lit(True).alias("shown")).distinct()
    s = selected.join(shown, [*keys, "atomic_id"], "left").groupBy(*keys).agg(F.count_if(F.col("shown").isNull()).alias("odd"), F.count("*").alias("n"), F.countDistinct("atomic_id").alias("d"))
    reason = F.when(F.col("odd") > 0, "not_a_candidate").when(F.col("n") > F.col("d"), "repeated").when(F.col("n") > budget, "over_budget")
    return s.select(*keys, reason.alias("reason")).filter("reason is not null")


def release(selected: DataFrame, texts: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Selected atoms (session_id, atomic_id, start_sec) with their text; a text of another time is an error."""
    both = selected.join(texts.select("session_id", "atomic_id", F.col("start_sec").alias("_t"), "text"), ["session_id", "atomic_id"])
    same = F.abs(F.col("start_sec") - F.col("_t")) <= tolerance
    return both.withColumn("text", F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("time differs of "), F.col("atomic_id").cast("string"))))).drop("_t")


def replay_violations(ledger: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Where a ledger's shortlists (keys, atomic_ids) differ from those computed again: ``keys, reason``."""
    both = ledger.select(*keys, F.col("atomic_ids").alias("_a")).join(again.select(*keys, F.col("atomic_ids").alias("_b")), keys, "full")
    reason = F.when(F.col("_a").isNull(), "not_in_ledger").when(F.col("_b").isNull(), "not_computed").when(F.col("_a") != F.col("_b"), "candidates_differ")
    return both.select(*keys, reason.alias("reason")).filter("reason is not null")


def repaired(answers: DataFrame, turns: int = 2) -> DataFrame:
    """Each session's last attempt (session_id, attempt, cited, allowed, probability) within ``turns`` repairs, with the
    ids that are not allowed dropped; the probability stays as it was said."""
    w = Window.partitionBy("session_id").orderBy("attempt")
    fine = F.size(F.array_except("cited", "allowed")) == 0
    rows = answers.filter(F.col("attempt") <= turns).withColumn("_ok", fine)
    first = F.min(F.when(F.col("_ok"), F.col("attempt"))).over(Window.partitionBy("session_id"))
    last = F.max("attempt").over(Window.partitionBy("session_id"))
    own = rows.withColumns({"_take": F.coalesce(first, last), "_n": F.row_number().over(w)}).filter("attempt = _take")
    return own.select("session_id", "attempt", F.filter("cited", lambda x: F.array_contains(F.col("allowed"), x)).alias("cited"), "probability", (~F.col("_ok")).alias("ids_dropped"))
