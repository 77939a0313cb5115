"""When to look again: uncertainty, disagreement, triggers and the audit's features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(p: Column) -> Column:
    """Binary entropy in bits."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def reliable_disagreement(risks: Column, reliabilities: Column, least: float = 0.6) -> Column:
    """Range of the risks of sources that are reliable enough; 0 for fewer than two."""
    own = F.filter(F.arrays_zip(risks.alias("risk"), reliabilities.alias("rel")), lambda s: s["risk"].isNotNull() & (s["rel"] >= least))
    own = F.transform(own, lambda s: s["risk"])
    return F.when(F.size(own) >= 2, F.array_max(own) - F.array_min(own)).otherwise(F.lit(0.0))


def pair_disagreement(d: Column, r1: Column, r2: Column, v1: Column, v2: Column, threshold: float) -> tuple[Column, Column]:
    """Reliable and unreliable parts of the disagreement ``d`` of two sources; nulls give 0."""
    both = r1 * r2 * v1 * v2 * d
    doubtful = F.when(F.greatest(r1, r2) > threshold, (1 - F.least(r1, r2)) * d).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    return F.coalesce(both, zero), F.coalesce(F.when(d.isNotNull() & r1.isNotNull() & r2.isNotNull(), doubtful), zero)


def trigger_reasons(signals: dict[str, Column]) -> Column:
    """Names of the signals that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in signals.items()]), lambda r: r.isNotNull())


def pick_segments(groups: list[Column], available: Column, most: int = 3) -> Column:
    """The first available ids by priority of their groups, without repeats."""
    ids = F.array_distinct(F.flatten(F.array(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups])))
    own = F.filter(ids, lambda i: F.array_contains(available, i))
    fallback = F.transform(F.array_sort(F.transform(available, lambda i: F.struct(F.regexp_extract(i, r"(\d+)", 1).cast("int").alias("n"), i.alias("id")))), lambda s: s["id"])
    return F.slice(F.when(F.size(own) > 0, own).otherwise(fallback), 1, most)


def risk_threshold(risks: DataFrame, rate: float) -> DataFrame:
    """The risk at or above which a share ``rate`` lies: the k-th largest, k rounded half to even."""
    from lumenlake.operators.quantiles import prefix_sums

    n = risks.groupBy().agg(F.count("*").alias("n")).withColumn("k", F.bround(F.col("n") * rate).cast("long"))
    counts = prefix_sums(risks.groupBy("risk").agg(F.count("*").alias("m")), [], [F.desc("risk")], ["m"])
    found = counts.crossJoin(F.broadcast(n)).filter("m_before < k and m_before + m >= k").groupBy().agg(F.max("risk").alias("t"))  # one row
    return n.crossJoin(found).select(F.when(F.col("k") <= 0, F.lit(1.0)).otherwise(F.col("t")).alias("threshold"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, penalty: float, rounds: int = 50, tolerance: float = 1e-10, weight: str = "1D") -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Newton steps; the intercept is free, rows may have a weight.

    Every step is one aggregation of the gradient and the curvature, a row of fixed size.
    """
    names = [*features, "1D"]
    k = len(names)
    w = np.zeros(k)
    for _ in range(rounds):
        z = " + ".join(f"({float(c)!r}D) * {x}" for c, x in zip(w, names, strict=True))
        p = f"(1 / (1 + exp(-greatest(-30D, least(30D, {z})))))"
        scored = rows.select(*features, F.expr(f"{weight} * ({p} - {label})").alias("_e"), F.expr(f"{weight} * {p} * (1 - {p})").alias("_c"))
        sums = [F.expr(f"sum(_e * {a})") for a in names] + [F.expr(f"sum(_c * {a} * {b})") for i, a in enumerate(names) for b in names[i:]]
        got = np.array([x or 0.0 for x in scored.agg(*sums).first()])
        gradient, curve = got[:k], np.zeros((k, k))
        curve[np.triu_indices(k)] = got[k:]
        curve = curve + np.triu(curve, 1).T
        reg = penalty * np.array([1.0] * (k - 1) + [0.0])
        step = np.linalg.solve(curve + np.diag(reg) + 1e-9 * np.eye(k), gradient + reg * w)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    return w[:-1], float(w[-1])


def evidence_overlap(supporting: Column, contradictory: Column) -> dict[str, Column]:
    """Shared ids in the order of support, their share of all ids, and whether both sides have any."""
    empty = F.array().cast("array<string>")
    a, b = F.array_distinct(F.coalesce(supporting, empty)), F.array_distinct(F.coalesce(contradictory, empty))
    either = F.size(F.array_union(a, b))
    shared = F.filter(a, lambda i: F.array_contains(b, i))
    return {"overlap": shared, "overlap_ratio": F.when(either > 0, F.size(shared) / either).otherwise(F.lit(0.0)), "coexists": (F.size(a) > 0) & (F.size(b) > 0)}


def trigger_score(uncertainty: Column, confidence: Column, disagreement: Column, mean_reliability: Column, least_reliability: Column, coexists: Column) -> Column:
    """The largest of six signals, within 0 and 1; missing reliabilities give no deficit."""
    zero = F.lit(0.0)
    parts = [uncertainty, 1 - confidence, disagreement, F.coalesce(1 - mean_reliability, zero), F.coalesce(1 - least_reliability, zero), F.when(coexists, 1.0).otherwise(0.0)]
    return F.least(F.lit(1.0), F.greatest(zero, *parts))


def natural_key(identifier: Column) -> Column:
    """A sort key in which runs of digits compare as numbers and come before text."""
    parts = F.regexp_extract_all(F.lower(identifier), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    number = lambda p: p.rlike("^[0-9]")
    return F.transform(parts, lambda p: F.struct((~number(p)).cast("int").alias("kind"), F.when(number(p), p.cast("decimal(38,0)")).alias("number"), F.when(~number(p), p).alias("text")))


AUDIT_FEATURES = ("confidence", "reliability_audio", "reliability_visual", "reliable_disagreement", "unreliable_disagreement", "missing_fraction", "entropy")


def audit_features(rows: DataFrame, validity: dict[str, float], threshold: float = 0.6) -> DataFrame:
    """Adds the audit's features to assessments (``risk, confidence, audio_risk, audio_rel, visual_risk, visual_rel``).

    A source without a reliability counts 0 there and as missing.
    """
    c = F.col
    d = F.abs(c("audio_risk") - c("visual_risk"))
    good, bad = pair_disagreement(d, c("audio_rel"), c("visual_rel"), F.lit(validity.get("audio", 1.0)), F.lit(validity.get("visual", 1.0)), threshold)
    missing = (c("audio_rel").isNull().cast("int") + c("visual_rel").isNull().cast("int")) / 2.0
    return rows.withColumns({
        "reliability_audio": F.coalesce("audio_rel", F.lit(0.0)), "reliability_visual": F.coalesce("visual_rel", F.lit(0.0)), "reliable_disagreement": good, "unreliable_disagreement": bad,
        "missing_fraction": missing, "entropy": entropy(c("risk")),
    })


def source_validity(rows: DataFrame, label: str, sources: dict[str, str]) -> DataFrame:
    """``source, validity``: 2 AUC - 1 within 0 and 1, over the rows where the source has a risk."""
    from lumenlake.operators.metrics import auc

    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(c).alias("p")) for s, c in sources.items()]))
    own = rows.select(F.col(label).alias("y"), cells.alias("c")).select("y", "c.source", "c.p").filter("p is not null and y is not null")
    return auc(own, ["source"]).select("source", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.col("auc") - 1)).alias("validity"))


def fit_audit(rows: DataFrame, target: str, penalty: float = 1.0) -> dict:
    """Means, scales, weights and intercept of the audit on ``AUDIT_FEATURES``; a scale of 0 counts 1.

    All that comes to the driver are sums of fixed size. ``rows`` is read once a step: pass a
    stored table.
    """
    names = list(AUDIT_FEATURES)
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    scale = {c: stats[f"s_{c}"] if (stats[f"s_{c}"] or 0) > 1e-12 else 1.0 for c in names}
    z = rows.select(*[((F.col(c) - stats[f"m_{c}"]) / scale[c]).alias(c) for c in names], target)
    w, b = fit_logistic(z, names, target, penalty)
    return {"mean": {c: stats[f"m_{c}"] for c in names}, "scale": scale, "weights": dict(zip(names, map(float, w), strict=True)), "intercept": b}


def audit_risk(model: dict) -> Column:
    """The probability that a first decision is wrong; logits are cut at 30."""
    z = F.lit(float(model["intercept"]))
    for c, w in model["weights"].items():
        z = z + (F.col(c) - model["mean"][c]) / model["scale"][c] * w
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def decide(rows: DataFrame, model: dict, threshold: float, failed: Column) -> DataFrame:
    """Adds ``audit_risk`` and ``should_rethink``; a failed first pass has no risk and is always looked at again."""
    risk = F.when(~failed, audit_risk(model))
    return rows.withColumns({"audit_risk": risk, "should_rethink": failed | F.coalesce(risk >= threshold, F.lit(False))})


def error_target(p: Column, threshold: Column, label: Column) -> Column:
    """1 where the first decision was wrong."""
    return ((p >= threshold) != (label == 1)).cast("int")
