"""Training records: drafts, weak targets, preferences, budgets, refreshes and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.policy import entropy

#: Kinds of preference pairs that decide, and those that only teach a constraint. Fixed values.
ACTION_KINDS = ("state_action",)
CONSTRAINT_KINDS = ("hallucinated_evidence", "inconsistent_summary", "unsupported_change")
TRANSITIONS = ("CC_preserve", "WC_revise", "WW_refer")
SEGMENT = r"^SEGMENT (S[0-9]+) \|"


def frozen_drafts(predictions: DataFrame, split: str, model: str, view: str) -> DataFrame:
    """The out-of-fold predictions of one split, model and view; any other origin is an error."""
    rows = predictions.filter((F.col("split") == split) & (F.col("model") == model) & (F.col("view") == view))
    fair = F.col("prediction_origin").contains("out_of_fold") | F.col("prediction_origin").contains("oof")
    fail = F.raise_error(F.concat(F.lit("not out of fold: "), F.col("session_id").cast("string")))
    return rows.withColumn("probability", F.when(F.coalesce(fair, F.lit(False)), F.col("probability")).otherwise(fail.cast("double")))


def draft_violations(drafts: DataFrame) -> DataFrame:
    """``reason``s why drafts cannot be used: repeated sessions, several thresholds, one class only."""
    repeats = drafts.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    s = drafts.agg(F.countDistinct("threshold").alias("t"), F.countDistinct("label").alias("l")).crossJoin(F.broadcast(repeats))  # one row each
    bad = F.array(F.when(F.col("n") > 1, "repeated_session"), F.when(F.col("t") != 1, "several_thresholds"), F.when(F.col("l") != 2, "one_class"))
    return s.select(F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("reason"))


def segment_signals(lines: DataFrame) -> DataFrame:
    """``session_id, segment_id`` with reliability and salience by modality, from lines of session texts
    (session_id, value): coverage in percent and percentiles are read from each modality's field."""
    rows = lines.filter(F.col("value").rlike(SEGMENT)).withColumn("fields", F.transform(F.split("value", r"\|"), lambda f: F.trim(f)))
    out = {"session_id": F.col("session_id"), "segment_id": F.regexp_extract("value", SEGMENT, 1)}
    field_of = lambda m: F.filter("fields", lambda f: F.lower(f).startswith(f"{m}:") | f.startswith(f"{m.upper()} summary"))
    for m in ("audio", "visual"):
        own = F.coalesce(F.get(field_of(m), F.lit(0)), F.lit(""))
        covered = F.regexp_extract(own, r"([0-9]+) percent", 1)
        shares = F.transform(F.regexp_extract_all(own, F.lit(r"percentile ([0-9]+)"), 1), lambda p: F.abs(p.cast("int") - 50) / 50)
        out[f"{m}_reliability"] = F.when(covered != "", covered.cast("double") / 100).when(F.lower(own).contains("unavailable"), 0.0)
        out[f"{m}_salience"] = F.least(F.lit(1.0), F.coalesce(F.array_max(shares), F.lit(0.0)))
    return rows.select(*[c.alias(n) for n, c in out.items()])


def weak_targets(drafts: DataFrame, signals: DataFrame, most: int = 4) -> DataFrame:
    """A first assessment for each draft (session_id, probability, threshold, audio, visual risks).

    Confidence falls with entropy and missing reliability. A source that agrees with the decision
    gives its two most salient segments as support, else as contradiction; the least reliable and
    the most disagreeing segments are uncertain.
    """
    w = lambda c: Window.partitionBy("session_id").orderBy(F.desc(c), F.desc("segment_id"))
    zero = F.lit(0.0)
    rows = signals.withColumns({
        "_low": 1 - F.least(F.coalesce("audio_reliability", zero), F.coalesce("visual_reliability", zero)), "_apart": F.abs(F.col("audio_salience") - F.col("visual_salience")),
    }).withColumns({"_a": F.row_number().over(w("audio_salience")), "_v": F.row_number().over(w("visual_salience")), "_l": F.row_number().over(w("_low")), "_d": F.row_number().over(w("_apart"))})
    first = lambda c, k: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col(c) <= k, F.struct(F.col(c).alias("n"), "segment_id"))), lambda x: x.isNotNull())), lambda x: x["segment_id"])
    mean = lambda c: F.avg(c)
    own = rows.groupBy("session_id").agg(first("_a", 2).alias("by_audio"), first("_v", 2).alias("by_visual"), first("_l", most).alias("low"), first("_d", most).alias("apart"), mean("audio_reliability").alias("ra"), mean("visual_reliability").alias("rv"))
    d = drafts.join(own, "session_id")
    c = F.col
    reliability = F.coalesce((F.when(c("ra") > 0, c("ra")) + F.when(c("rv") > 0, c("rv"))) / 2, F.when(c("ra") > 0, c("ra")), F.when(c("rv") > 0, c("rv")), zero)
    confidence = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (1 - entropy(c("probability"))) * (0.5 + 0.5 * reliability)))
    agrees = lambda s: (c(s) >= c("threshold")) == (c("probability") >= c("threshold"))
    none = F.array().cast("array<string>")
    side = lambda yes: F.array_distinct(F.concat(F.when(agrees("audio") == yes, c("by_audio")).otherwise(none), F.when(agrees("visual") == yes, c("by_visual")).otherwise(none)))
    uncertain = F.slice(F.array_distinct(F.concat("low", "apart")), 1, 4)
    out = d.select("session_id", confidence.alias("confidence"), side(True).alias("supporting"), side(False).alias("contradictory"), uncertain.alias("uncertain"))
    return out.withColumn("requested", F.slice(F.array_distinct(F.concat("uncertain", "contradictory", "supporting")), 1, most))


def correct_side(label: Column, threshold: Column) -> Column:
    """A probability well on the label's side of the threshold."""
    up = F.least(F.lit(0.95), F.greatest(threshold + 0.10, threshold + (1 - threshold) * 0.65))
    return F.when(label == 1, up).otherwise(F.greatest(F.lit(0.05), F.least(threshold - 0.10, threshold * 0.35)))


def transition_target(label: Column, initial: Column, threshold: Column, unresolved: Column) -> Column:
    """Right first decisions are kept; wrong ones are revised, or referred where nothing resolves them."""
    right = (initial >= threshold).cast("int") == label
    return F.when(right, "CC_preserve").when(unresolved, "WW_refer").otherwise("WC_revise")


def revision(status: Column, probability: Column, initial: Column, cited: Column, segments: Column) -> Column:
    """A revision of the template: what is kept, what stays in conflict, and the summary that fits."""
    open_, none = status == "unresolved", F.array().cast("array<string>")
    summary = F.when(open_, "insufficient_reliable_detail").when(F.abs(probability - initial) <= 1e-12, "risk_unchanged_after_review").when(probability > initial, "risk_increased_after_review").otherwise("risk_decreased_after_review")
    return F.struct(
        status.alias("revision_status"), probability.alias("revised_risk_probability"), cited.alias("cited_evidence_ids"), F.when(open_, none).otherwise(cited).alias("preserved_evidence_ids"),
        F.when(open_, segments).otherwise(none).alias("residual_conflict_segment_ids"), summary.alias("change_summary"),
    )


def preferences(rows: DataFrame) -> DataFrame:
    """Preference pairs of sessions (session_id, transition, label, initial, threshold, cited, segments): one on the
    action and three on constraints, each a chosen and a rejected revision."""
    c = F.col
    status = F.when(c("transition") == "CC_preserve", "preserved").when(c("transition") == "WC_revise", "revised").otherwise("unresolved")
    to = F.when(c("transition") == "WC_revise", correct_side(c("label"), c("threshold"))).otherwise(c("initial"))
    other = F.when(c("transition") == "WC_revise", c("initial")).otherwise(correct_side(1 - (c("initial") >= c("threshold")).cast("int"), c("threshold")))
    wrong = F.when(c("transition") == "WC_revise", "preserved").otherwise("revised")
    chosen = revision(status, to, c("initial"), c("cited"), c("segments"))
    invented = F.concat(F.array(F.lit("E999999")), F.slice("cited", 2, 1000))
    rejected = {
        "state_action": revision(wrong, other, c("initial"), c("cited"), c("segments")), "hallucinated_evidence": revision(status, to, c("initial"), invented, c("segments")),
        "inconsistent_summary": chosen.withField("change_summary", F.when(chosen["change_summary"] == "risk_increased_after_review", "risk_decreased_after_review").otherwise("risk_increased_after_review")),
        "unsupported_change": revision(F.lit("revised"), F.least(F.lit(1.0), c("initial") + 0.3), c("initial"), F.array().cast("array<string>"), c("segments")),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("preference_kind"), r.alias("rejected")) for k, r in rejected.items()])).alias("p")
    return rows.select("session_id", "transition", chosen.alias("chosen"), pairs).select("session_id", "transition", "chosen", "p.preference_kind", "p.rejected")


def sample_weight(label: Column, initial: Column, threshold: Column) -> Column:
    """Two for a positive that the first decision missed, else one."""
    return F.when((label == 1) & (initial < threshold), 2.0).otherwise(1.0)


def without_holdout(records: DataFrame, holdout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of sessions that are not held out, and a log of the others (session_id, records)."""
    held = holdout.select("session_id").distinct()
    return records.join(held, "session_id", "left_anti"), records.join(held, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("records"))


def best_score(scores: DataFrame, arms: list[str], wanted: Column) -> DataFrame:
    """Each session's valid arm, but direct referral, of most utility among the ``wanted``; ties by no referral,
    tokens, atoms and the order of arms."""
    place = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("arm_id"))
    w = Window.partitionBy("session_id").orderBy(F.desc("utility"), "referred", "released_tokens", "atomic_records", place)
    own = scores.filter((F.col("arm_id") != "direct_refer") & F.col("arm_valid") & wanted)
    return own.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _digest(seed: int, c: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")), 256)


def within_session_budget(pairs: DataFrame, per_session: int, share: float, seed: int) -> DataFrame:
    """All action pairs, and of a hashed ``share`` of sessions the constraint pairs, rotated by the hash, up to
    ``per_session``. A constraint kind that nobody has gets its first pair back."""
    w = Window.partitionBy("session_id")
    is_action = F.col("preference_kind").isin(*ACTION_KINDS)
    d = _digest(seed, "session_id")
    rows = pairs.withColumns({"_action": is_action, "_actions": F.count_if(is_action).over(w), "_n": F.count_if(~is_action).over(w), "_all": F.count("*").over(w)})
    rows = rows.withColumns({
        "_i": F.row_number().over(Window.partitionBy("session_id", "_action").orderBy("preference_kind")) - 1, "_draw": F.conv(F.substring(d, 9, 8), 16, 10).cast("double") / float(2**32 - 1),
        "_offset": F.conv(F.substring(d, 1, 8), 16, 10).cast("long"),
    })
    turn = F.expr("pmod(_i - pmod(_offset, greatest(_n, 1)), greatest(_n, 1))")
    # whether any session is over its budget decides for all: one row, broadcast
    over = pairs.groupBy("session_id").agg(F.count("*").alias("m")).agg((F.max("m") > per_session).alias("_over"))
    rows = rows.crossJoin(F.broadcast(over))
    keep = ~F.col("_over") | F.col("_action") | ((F.col("_draw") < share) & (turn < per_session - F.col("_actions")))
    marked = rows.withColumn("_keep", keep)
    kinds = marked.groupBy("preference_kind").agg(F.bool_or("_keep").alias("_some"), F.min(F.struct("session_id")).alias("_first"))  # a few kinds
    back = marked.join(F.broadcast(kinds), "preference_kind").filter(F.col("_keep") | (~F.col("_some") & (F.col("session_id") == F.col("_first.session_id"))))
    return back.select(*pairs.columns)


def record_violations(records: DataFrame, strata: list[str]) -> DataFrame:
    """What is wrong with records (session_id, preference_kind, transition, prompt, cited, chosen, rejected):
    ``key, reason``; must be none. Texts must differ, cited ids stand in the prompt, a session has each kind once,
    and every required stratum occurs."""
    key = F.concat_ws(":", F.col("session_id").cast("string"), "preference_kind")
    one = records.select(key.alias("key"), F.filter(F.array(
        F.when(F.col("chosen") == F.col("rejected"), F.lit("equal_texts")), F.when(~F.forall("cited", lambda x: F.contains(F.col("prompt"), x)), F.lit("ungrounded")), F.when(~F.col("transition").isin(*TRANSITIONS), F.lit("unknown_transition")),
    ), lambda x: x.isNotNull()).alias("r")).select("key", F.explode("r").alias("reason"))
    twice = records.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit("repeated").alias("reason"))
    wanted = records.sparkSession.createDataFrame([(s,) for s in strata], "key string")
    missing = wanted.join(records.select(F.col("transition").alias("key")).distinct(), "key", "left_anti").select("key", F.lit("missing_stratum").alias("reason"))
    return one.unionByName(twice).unionByName(missing)


def outcome_is_correct(status: Column, probability: Column, threshold: Column, label: Column, transition: Column) -> Column:
    """Whether a revision ends where its transition should."""
    right = (probability >= threshold).cast("int") == label
    return F.when(transition == "WW_refer", status == "unresolved").when(transition == "CC_preserve", (status == "preserved") & right).otherwise((status == "revised") & right)


def refresh_gate(generations: DataFrame, least: int = 12, share: float = 0.15) -> DataFrame:
    """``n, accepted, required, missing, passed`` of new revisions (transition, accepted)."""
    s = generations.agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.array_sort(F.collect_set(F.when(F.col("accepted"), F.col("transition")))).alias("_have"))  # three at most
    required = F.greatest(F.lit(least), F.ceil(F.col("n") * share).cast("int"))
    missing = F.array_except(F.array(*[F.lit(t) for t in TRANSITIONS]), "_have")
    return s.select("n", "accepted", required.alias("required"), F.array_join(missing, ",").alias("missing"), ((F.col("accepted") >= required) & (F.size(missing) == 0)).alias("passed"))


def refreshed(pairs: DataFrame, accepted: DataFrame, least: int) -> DataFrame:
    """Pairs whose chosen text is the accepted one of its session (session_id, text), topped up with old pairs in
    the order of their ids to ``least``; ``refreshed`` tells which."""
    joined = pairs.join(accepted, "session_id", "left").withColumn("refreshed", F.col("text").isNotNull())
    new = joined.filter("refreshed").select("session_id", "preference_kind", F.col("text").alias("chosen"), "rejected", "refreshed")
    rest = joined.filter("not refreshed").select("session_id", "preference_kind", "chosen", "rejected", "refreshed")
    missing = max(0, least - new.count())
    return new.unionByName(rest.orderBy("session_id", "preference_kind").limit(missing))


def first_tier_that_fits(rows: DataFrame, tiers: list[str], budget: int) -> DataFrame:
    """``session_id, tier`` of token counts (a column for each tier): the first within the budget; none is an error."""
    pick = F.coalesce(*[F.when(F.col(t) <= budget, F.lit(t)) for t in tiers], F.raise_error(F.concat(F.lit("no tier fits "), F.col("session_id").cast("string"))).cast("string"))
    return rows.select("session_id", pick.alias("tier"))


def entry_gate(trajectories: Column, variance_share: Column, rules_passed: Column, reasoning_errors: Column) -> Column:
    """The names of the criteria that a group-relative stage does not meet."""
    from lumenlake.operators.evaluation import checks

    return checks(trajectory_pool_at_least_5000=trajectories >= 5000, reward_variance_ratio_at_least_0_60=variance_share >= 0.6, rule_reward_audit_passed=rules_passed, residual_errors_are_reasoning=reasoning_errors)


def literacy_rows(curriculum: DataFrame) -> DataFrame:
    """Two records for each item (session_id, item, query, cards, picked): to ask, then to choose."""
    kinds = F.array(
        F.struct(F.lit("query").alias("kind"), F.col("item").alias("prompt"), F.col("query").alias("answer")),
        F.struct(F.lit("selection").alias("kind"), F.concat_ws("\n", F.array(F.col("query")), F.col("cards")).alias("prompt"), F.to_json("picked").alias("answer")),
    )
    return curriculum.select("session_id", "item", F.explode(kinds).alias("k")).select("session_id", "item", "k.*")


def reviewer_routes(gates: DataFrame, adapters: DataFrame) -> DataFrame:
    """``fold, route``: the fold's adapter where its gate passed, else ``fallback``."""
    return gates.join(adapters, "fold", "left").select("fold", F.when(F.col("passed") & F.col("adapter").isNotNull(), F.col("adapter")).otherwise("fallback").alias("route"))


def capability_split(rows: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same rows twice: what inference may see, and the outcomes with the key alone."""
    seen = [c for c in rows.columns if c not in hidden]
    return rows.select(*seen), rows.select("session_id", *hidden)


def freeze_violations(arms: DataFrame, expected: list[str]) -> DataFrame:
    """Sessions whose arms are not each expected arm once, in order, on one first probability."""
    own = arms.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "arm_id"))).alias("a"), F.countDistinct("initial_probability").alias("anchors"))  # a few arms
    names = F.transform("a", lambda x: x["arm_id"])
    reason = F.when(names != F.array(*[F.lit(e) for e in expected]), "arms_differ").when(F.col("anchors") != 1, "anchors_differ")
    return own.select("session_id", reason.alias("reason")).filter("reason is not null")


def crossfit_rows(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every expected session once: with its prediction, or closed (first probability, referred) without one."""
    both = expected.join(predicted.select("session_id", F.col("final_probability").alias("_p"), F.col("referred").alias("_r")), "session_id", "left")
    return both.select("session_id", F.coalesce("_p", "initial_probability").alias("final_probability"), F.coalesce("_r", F.lit(True)).alias("referred"), F.col("_p").isNotNull().alias("arm_valid"))


def prompt(parts: dict[str, Column]) -> Column:
    """A prompt of titled parts in order; empty ones are left out."""
    told = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{title}\n"), F.trim(c))) for title, c in parts.items()]
    return F.concat_ws("\n\n", *told)


def session_audit(sessions: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """``session_id, units, texts, error`` of each session: none, or the first thing missing."""
    own = sessions.join(units.groupBy("session_id").agg(F.count("*").alias("units")), "session_id", "left").join(texts.groupBy("session_id").agg(F.count("*").alias("texts")), "session_id", "left").fillna(0, ["units", "texts"])
    return own.withColumn("error", F.when(F.col("units") == 0, "no_units").when(F.col("texts") == 0, "no_text"))


def header_audit(headers: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """``session_id, errors, warnings`` of files' headers (session_id, columns): required and optional names missing."""
    have = F.transform("columns", lambda c: F.lower(F.trim(c)))
    lack = lambda names: F.array_join(F.array_except(F.array(*[F.lit(n) for n in names]), have), ",")
    return headers.select("session_id", lack(required).alias("errors"), lack(optional).alias("warnings"))


def report_rows(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``base`` with each optional part joined by ``key`` as a struct; a missing part is null."""
    out = base
    for name, part in parts.items():  # a fixed few
        out = out.join(part.select(key, F.struct(*[c for c in part.columns if c != key]).alias(name)), key, "left")
    return out
