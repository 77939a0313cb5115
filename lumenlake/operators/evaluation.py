"""Scored arms, paired bootstraps, gates and choices between runs.

Arm rows are (session_id, arm_id, label, initial_probability, initial_confidence, threshold,
final_probability, final_confidence, referred, natural_triggered, queries, atomic_records,
released_tokens, arm_valid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators import bootstraps
from lumenlake.operators.metrics import log_loss, transition

EPSILON = 1e-7


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def fail_closed(arms: DataFrame) -> DataFrame:
    """Arms (with ``status``, null where the session's first pass failed) whose failures keep the first
    probability, are referred and cost nothing; ``direct_refer`` is always so, and valid."""
    direct, failed = F.col("arm_id") == "direct_refer", F.coalesce(F.col("status") != "ok", F.lit(True))
    closed = direct | failed
    keep = lambda own, first: F.when(closed, F.col(first)).otherwise(F.col(own))
    nothing = {c: F.when(closed, F.lit(0)).otherwise(F.col(c)).cast("long") for c in ("queries", "atomic_records", "released_tokens")}
    reason = F.when(direct, F.lit(None)).when(F.col("status").isNull(), "initial_assessment_failed").when(failed, F.coalesce("error_type", F.lit("unknown_failure")))
    return arms.withColumns({
        "final_probability": keep("final_probability", "initial_probability"), "final_confidence": keep("final_confidence", "initial_confidence"), "referred": closed | F.coalesce("referred", F.lit(False)), **nothing,
        "arm_valid": direct | ~failed, "failure_reason": reason.cast("string"), "revision_status": F.when(direct, "direct_refer").when(failed, "fail_closed_refer").otherwise(F.col("revision_status")),
    })


def deployed(arms: DataFrame) -> DataFrame:
    """What the policy would have shown: where it did not trigger, the first prediction at no cost."""
    on = F.col("natural_triggered")
    first = {"final_probability": "initial_probability", "final_confidence": "initial_confidence"}
    zero = {c: F.when(on, F.col(c)).otherwise(F.lit(0)).cast("long") for c in ("queries", "atomic_records", "released_tokens")}
    return arms.withColumns({c: F.when(on, F.col(c)).otherwise(F.col(f)) for c, f in first.items()} | zero | {"referred": on & F.col("referred"), "arm_valid": ~on | F.col("arm_valid"), "arm_applied": on})


def scored(arms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``transition, brier, loss, harm, utility``; ``weights`` of brier, harm, query, atomic, token and refer."""
    p, y, t, q, r = _c("final_probability", "label", "threshold", "initial_probability", "referred")
    before, after = (q >= t).cast("int"), (p >= t).cast("int")
    cut = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    rows = arms.withColumns({"transition": transition(y, before, after, r), "brier": (p - y) * (p - y), "loss": -F.when(y == 1, F.ln(cut)).otherwise(F.ln(1 - cut)), "harm": (before == y) & ~r & (after != y)})
    cost = [("brier", F.col("brier")), ("harm", F.col("harm").cast("int")), ("query", F.col("queries")), ("atomic", F.col("atomic_records")), ("token", F.col("released_tokens")), ("refer", r.cast("int"))]
    return rows.withColumn("utility", sum((-F.lit(float(weights.get(n, 0.0))) * c for n, c in cost), -F.col("loss")))


def best_arm(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each session's arm of most utility; ties go to no harm, no referral, fewer tokens, fewer atoms, then
    the order of arms."""
    place = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("arm_id"))
    w = Window.partitionBy("session_id").orderBy(F.desc("utility"), "harm", "referred", "released_tokens", "atomic_records", place)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def loop_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rates, costs and corrections of scored arms; a rate over nothing is null."""
    p, y, t, r = _c("final_probability", "label", "threshold", "referred")
    taken = ~r
    n = lambda c: F.count_if(c)
    hits = n(taken & (y == 1))
    recovered, harmed = n(F.col("transition") == "wrong_to_correct"), n(F.col("transition") == "correct_to_wrong")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("participants"), F.avg("brier").alias("brier"), log_loss(p, y, EPSILON).alias("log_loss"), F.avg(taken.cast("double")).alias("coverage"), n(taken).alias("accepted"), n(r).alias("referred"),
        F.when(hits > 0, n(taken & (y == 1) & (p < t)) / hits).alias("accepted_fnr"), recovered.alias("recovered"), harmed.alias("harmed"), (recovered - harmed).alias("net_correction"),
        F.avg("queries").alias("mean_queries"), F.avg("atomic_records").alias("mean_atomic_records"), F.avg("released_tokens").alias("mean_tokens"), n(~F.col("arm_valid")).alias("failures"),
    )


def improvements(rows: DataFrame) -> DataFrame:
    """``session_id`` and what the final prediction gains: ``brier_improvement, log_loss_improvement, net_correction``."""
    p, q, y, t, r = _c("final_probability", "initial_probability", "label", "threshold", "referred")
    loss = lambda x: -F.when(y == 1, F.ln(F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1 - EPSILON)))).otherwise(F.ln(1 - F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1 - EPSILON))))
    a, b = (q >= t).cast("int") == y, (p >= t).cast("int") == y
    return rows.select("session_id", ((q - y) * (q - y) - (p - y) * (p - y)).alias("brier_improvement"), (loss(q) - loss(p)).alias("log_loss_improvement"), ((~a & b & ~r).cast("double") - (a & ~b & ~r).cast("double")).alias("net_correction"))


def paired_bootstrap(rows: DataFrame, key: str, values: list[str], samples: int, seed: int) -> DataFrame:
    """``statistic, estimate, low, high``: mean and 2.5 and 97.5 % quantiles of the replicates' means.

    The same row counts alike for every statistic. A value that is null or NaN is left out of its
    statistic.
    """
    return bootstraps.means(rows, key, values, samples, seed).groupBy("statistic").agg(F.avg("m").alias("estimate"), *bootstraps.ends("m"))


def checks(**conditions: Column) -> Column:
    """The names of the checks that fail, in order; null counts as failed."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())


def validity_gate(predictions: DataFrame, keys: list[str], margin: float = 0.03, least_range: float = 0.05) -> DataFrame:
    """``keys, failed``: whether scores (p, y) beat a constant prior and are not collapsed."""
    from lumenlake.operators.metrics import auc, average_precision

    p, y = _c("p", "y")
    s = predictions.groupBy(*keys).agg(F.avg("y").alias("prior"), F.avg((p - y) * (p - y)).alias("brier"), log_loss(p, y, 1e-15).alias("loss"), F.max("p").alias("hi"), F.min("p").alias("lo"), F.countDistinct("p").alias("values"), F.count("*").alias("n"))
    s = s.join(auc(predictions, keys), keys).join(average_precision(predictions, keys), keys)
    c = F.col
    constant = -(c("prior") * F.ln(c("prior")) + (1 - c("prior")) * F.ln(1 - c("prior")))
    failed = checks(
        roc_auc_above_random=c("auc") > 0.5, average_precision_above_prior=c("average_precision") > c("prior") + margin, brier_better_than_prior=c("brier") < c("prior") * (1 - c("prior")),
        log_loss_better_than_prior=c("loss") < constant, probabilities_not_collapsed=(c("values") >= F.least(F.lit(10), c("n"))) & (c("hi") - c("lo") >= least_range),
    )
    return s.select(*keys, failed.alias("failed"))


def comparison_gate(summary: DataFrame) -> DataFrame:
    """Whether a candidate (``new_...``) supports itself against a frozen one (``old_...``): ``failed``,
    ``developmental`` and, with the lower end of its Brier gain, ``confirmatory``."""
    c = F.col
    failed = checks(
        brier_strictly_lower=c("new_brier") < c("old_brier"), log_loss_strictly_lower=c("new_log_loss") < c("old_log_loss"), roc_auc_not_lower=c("new_auc") >= c("old_auc"),
        average_precision_not_lower=c("new_ap") >= c("old_ap"), net_corrected_nonnegative=c("net_corrected") >= 0,
    )
    return summary.withColumn("failed", failed).withColumn("developmental", F.size("failed") == 0).withColumn("confirmatory", c("developmental") & F.coalesce(c("brier_low") > 0, F.lit(False)))


def benefit_gate(bootstrap: DataFrame, net_correction: int) -> DataFrame:
    """``point_pass, uncertainty_pass`` of a ``paired_bootstrap`` of the three improvements."""
    of = lambda name, c: F.max(F.when(F.col("statistic") == name, F.col(c)))
    point = (of("brier_improvement", "estimate") > 0) & (of("log_loss_improvement", "estimate") > 0) & F.lit(net_correction > 0)
    sure = (of("brier_improvement", "low") > 0) & (of("log_loss_improvement", "low") > 0) & (of("net_correction", "low") >= 0)
    return bootstrap.agg(point.alias("point_pass"), sure.alias("uncertainty_pass"))


def memorised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, failed`` of a run meant to learn its rows (y, margin) by heart, with the run's ``auc, ap, ba, loss``."""
    signed = F.when(F.col("y") == 1, F.col("margin")).otherwise(-F.col("margin"))
    s = rows.groupBy(*keys).agg(F.min(signed).alias("least"), F.count_if(signed > 2).alias("high"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("auc", "ap", "ba", "loss")])
    c = F.col
    failed = checks(
        roc_auc_is_one=c("auc") >= 1 - 1e-12, average_precision_is_one=c("ap") >= 1 - 1e-12, balanced_accuracy=c("ba") >= 0.95, log_loss=c("loss") <= 0.10, margins_positive=c("least") > 0, margins_above_2=c("high") >= c("n") - 1,
    )
    return s.select(*keys, failed.alias("failed"))


def best_checkpoint(history: DataFrame, keys: list[str], step: str, metric: str) -> DataFrame:
    """Each run's step of the best metric; equal within 1e-12 the smaller loss wins, then the earlier step."""
    better = F.col(metric) if metric == "log_loss" else -F.col(metric)
    order = [F.round(better, 12), F.col(step)] if metric == "log_loss" else [F.round(better, 12), F.col("log_loss"), F.col(step)]
    return history.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def prior_shift(margins: DataFrame, column: str, prior: float, reach: float = 80.0, rounds: int = 100, tolerance: float = 1e-13) -> float:
    """The shift of logits, within ``reach``, under which their mean probability is ``prior``.

    Newton steps that stay within the bracket known so far, else its middle. Each round is one pass
    over ``margins``, which should be stored; a handful do.
    """
    low, high, shift = -reach, reach, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col(column) + F.lit(shift))))
        mean, slope = margins.agg(F.avg(p), F.avg(p * (1 - p))).first()
        if mean is None or abs(mean - prior) <= tolerance or high - low <= tolerance:
            break
        low, high = (shift, high) if mean < prior else (low, shift)
        step = shift - (mean - prior) / slope if slope else low
        shift = step if low < step < high else (low + high) / 2
    return shift


def preference_audit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, accuracy, mean_margin`` of preference pairs with a ``margin``; won where it is above 0."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("margin") > 0).cast("double")).alias("accuracy"), F.avg("margin").alias("mean_margin"))


def literacy_gate(answers: DataFrame, expected: int, least: float = 0.9) -> DataFrame:
    """Rates of valid, grounded and exact answers over a whole hold-out, and what fails."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    s = answers.agg(F.count("*").alias("n"), rate("valid").alias("valid"), rate("grounded").alias("grounded"), rate("exact").alias("exact"))
    failed = checks(full_holdout=F.col("n") == expected, valid_rate=F.col("valid") >= least, grounded_rate=F.col("grounded") >= least, exact_rate=F.col("exact") >= least)
    return s.withColumn("failed", failed)


def seed_spread(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, statistic, mean, sd`` over seeds; one seed has a deviation of 0."""
    each = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("statistic"), F.col(v).alias("x")) for v in values])).alias("s")).select(*keys, "s.*")
    return each.groupBy(*keys, "statistic").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))


def log_odds(logp: Column) -> Column:
    """Log-odds of a mean log-probability, cut just below 0."""
    cut = F.least(logp, F.lit(-1e-9))
    return cut - F.ln(-F.expm1(cut))


def preference_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    """Cross-entropy of the chosen answer and, by ``beta``, the softplus of the lost lead in log-odds."""
    lead = log_odds(chosen) - log_odds(rejected)
    softplus = F.greatest(-lead, F.lit(0.0)) + F.log1p(F.exp(-F.abs(lead)))
    return -chosen + beta * softplus


def sensitivity(predictions: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Confusion counts, sensitivity and specificity, Brier and log loss."""
    p, y = _c("p", "y")
    hit = p >= threshold
    tp, fn, tn, fp = F.count_if(hit & (y == 1)), F.count_if(~hit & (y == 1)), F.count_if(~hit & (y == 0)), F.count_if(hit & (y == 0))
    rate = lambda a, b: F.when(a + b > 0, a / (a + b))
    return predictions.groupBy(*keys).agg(tp.alias("tp"), fn.alias("fn"), tn.alias("tn"), fp.alias("fp"), rate(tp, fn).alias("sensitivity"), rate(tn, fp).alias("specificity"), F.avg((p - y) * (p - y)).alias("brier"), log_loss(p, y, 1e-15).alias("log_loss"))
