"""Checks that return violations as rows: ledgers, folds, citations and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_grammar(events: DataFrame) -> DataFrame:
    """``run_id, violations`` of (run_id, order_key, event_type) logs; one aggregation, no lists of events."""
    t, o = F.col("event_type"), F.col("order_key")
    n = lambda x: F.count_if(t == x)
    at = lambda x: F.min(F.when(t == x, o))
    last = lambda *x: F.max(F.when(t.isin(*x), o))
    a = events.groupBy("run_id").agg(
        F.min_by(t, o).alias("first"), F.max(o).alias("end"), n("agent_opened").alias("opens"), n("agent_closed").alias("closes"), n("agent_aborted").alias("aborts"), n("revision_recorded").alias("revisions"),
        at("agent_closed").alias("close"), at("agent_aborted").alias("abort"), at("revision_recorded").alias("revision"), at("evidence_released").alias("release"),
        last("candidates_exposed", "evidence_released").alias("access"), F.max(F.when(t != "agent_closed", o)).alias("other"),
    )
    c = F.col
    bad = {
        "not_opened_first": c("first") != "agent_opened", "multiple_opens": c("opens") > 1, "multiple_closes": c("closes") > 1, "records_after_close": c("close") < c("end"), "multiple_aborts": c("aborts") > 1,
        "records_after_abort": c("other") > c("abort"), "multiple_revisions": c("revisions") > 1, "revision_before_release": c("revision").isNotNull() & ~F.coalesce(c("release") < c("revision"), F.lit(False)), "access_after_revision": c("access") > c("revision"),
    }
    return a.select("run_id", F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in bad.items()]), lambda x: x.isNotNull()).alias("violations"))


def fold_cover(assignments: DataFrame, key: str, folds: int) -> DataFrame:
    """Keys that not every fold names, or that are not held out exactly once (``split`` is fit or holdout)."""
    own = assignments.groupBy(key).agg(F.countDistinct("fold").alias("folds"), F.count_if(F.col("split") == "holdout").alias("holdouts"))
    return own.filter((F.col("folds") != folds) | (F.col("holdouts") != 1))


def unknown_citations(cited: Column, available: Column) -> Column:
    return F.array_except(cited, available)


def named_in(ids: Column, text: Column) -> Column:
    """Whether every id occurs in the text."""
    return F.forall(ids, lambda x: F.contains(text, x))


def revision_inconsistency(status: Column, summary: Column, delta: Column, conflicts: Column) -> Column:
    """The first rule that a revision breaks, or null. Moves of 0.05 divide preserved from revised."""
    direction = F.when(delta > 0, "risk_increased_after_review").otherwise("risk_decreased_after_review")
    return (
        F.when((status == "preserved") & (F.abs(delta) > 0.05), "preserved_probability_moved")
        .when((status == "preserved") & (summary != "risk_unchanged_after_review"), "preserved_summary_mismatch")
        .when((status == "revised") & (F.abs(delta) < 0.05), "revised_probability_unchanged")
        .when((status == "revised") & (summary != direction), "revised_summary_direction_mismatch")
        .when(~status.isin("preserved", "revised") & (summary != "insufficient_reliable_detail"), "unresolved_summary_mismatch")
        .when(~status.isin("preserved", "revised") & (F.size(conflicts) == 0), "unresolved_without_residual_conflict")
    )


def unlock_once(requests: DataFrame, ledger: DataFrame, key: str, order: str) -> DataFrame:
    """Requests that may unlock: the first of each ``key`` that the ledger does not hold."""
    new = requests.join(ledger.select(key).distinct(), key, "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def longest_run(rows: DataFrame, group: str, order: str, passed: Column) -> DataFrame:
    """``group, longest``: the most rows in a row for which ``passed`` holds."""
    fails = F.sum((~passed).cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_ok", passed).withColumn("_run", fails).groupBy(group, "_run").agg(F.count_if("_ok").alias("_len"))
    return runs.groupBy(group).agg(F.max("_len").alias("longest"))


def matched_transitions(y: Column, before: Column, after: Column) -> list[Column]:
    """Counts and rates of what a candidate keeps, harms and recovers (booleans before and after)."""
    a, b = before == y, after == y
    harmed, recovered, right, wrong = F.count_if(a & ~b), F.count_if(~a & b), F.count_if(a), F.count_if(~a)
    return [
        F.count_if(a & b).alias("preserved"), harmed.alias("harmed"), recovered.alias("recovered"), F.count_if(~a & ~b).alias("remaining"), (recovered - harmed).alias("net_corrected"),
        F.when(right > 0, harmed / right).otherwise(0.0).alias("harm_rate"), F.when(wrong > 0, recovered / wrong).otherwise(0.0).alias("recovery_rate"),
    ]
