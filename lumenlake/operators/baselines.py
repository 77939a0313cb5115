"""Feature matrices, TF-IDF and resampling of session-level results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators import bootstraps


def impute_scale(rows: DataFrame, columns: list[str], train: str) -> DataFrame:
    """Median-imputed, standardised ``columns`` and ``<column>_missing``; fitted on ``train`` rows.

    Deviations are of the population and taken after imputing; one of 0 counts as 1.
    """
    own = rows.filter(train)
    medians = own.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    full = lambda d: d.crossJoin(F.broadcast(medians)).withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns} | {c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    moments = full(own).agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return full(rows).crossJoin(F.broadcast(moments)).withColumns(z).drop(*[f"_{k}_{c}" for c in columns for k in "as"])  # one row each


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 2, most: int = 50_000) -> DataFrame:
    """``key, term, weight`` of words and word pairs: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of length 1.

    Terms of at least ``min_df`` documents, the ``most`` commonest of them (ties by term): that
    bound lets the vocabulary be broadcast.
    """
    words = docs.select(key, F.expr(rf"regexp_extract_all(lower(`{text}`), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0)").alias("_w"))
    pairs = F.expr("transform(slice(_w, 1, greatest(size(_w) - 1, 0)), (x, i) -> concat(x, ' ', _w[i + 1]))")
    counts = words.select(key, F.explode(F.concat("_w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_all")).filter(F.col("df") >= min_df).orderBy(F.desc("_all"), "term").limit(most)
    n = docs.groupBy().agg(F.count("*").alias("_n"))
    raw = (1 + F.ln("tf")) * (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1)
    own = counts.join(F.broadcast(vocabulary), "term").crossJoin(F.broadcast(n)).withColumn("_raw", raw)
    return own.withColumn("weight", F.col("_raw") / F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))).select(key, "term", "weight")


def bootstrap(rows: DataFrame, key: str, value: str, stratum: str, samples: int, seed: int) -> DataFrame:
    """``estimate, low, high``: the mean of ``value`` and 2.5 and 97.5 % quantiles of its replicates, which weigh each
    stratum by its share of the rows."""
    drawn = bootstraps.means(rows, key, [value], samples, seed, stratum).agg(*bootstraps.ends("m"))
    return rows.agg(F.avg(value).alias("estimate")).crossJoin(drawn)  # one row each


def session_features(units: DataFrame, observations: DataFrame) -> DataFrame:
    """Long features (session_id, feature, value) of units and their measurements: length, units, the share of each
    availability, and eight statistics and the slope over time of every quality and measurement.

    Units grow with the data, however few Spark expects, so they are never broadcast.
    """
    from lumenlake.operators.features import session_stats

    mid = F.col("start_sec")
    length = units.groupBy("session_id").agg(F.max("start_sec").alias("value")).select("session_id", F.lit("session.duration_seconds").alias("feature"), "value")
    n = units.groupBy("session_id", "modality").agg(F.count("*").cast("double").alias("unit_count"), *[F.avg((F.col("availability") == s).cast("double")).alias(f"availability.{s}_fraction") for s in ("present", "partial", "unavailable")])
    names = [c for c in n.columns if c not in ("session_id", "modality")]
    shares = n.select("session_id", "modality", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").alias("value")) for c in names])).alias("x")).select("session_id", F.concat_ws(".", "modality", "x.f").alias("feature"), "x.value")
    quality = units.select("session_id", F.concat("modality", F.lit(".quality.valid_ratio")).alias("name"), mid.alias("t_sec"), F.col("valid_ratio").alias("value"))
    told = units.select("unit_id", "session_id", "modality", mid.alias("t_sec")).hint("merge").join(observations.select("unit_id", F.col("name").alias("_n"), "value"), "unit_id").select("session_id", F.concat("modality", F.lit(".observation."), "_n").alias("name"), "t_sec", "value")
    stats = session_stats(quality.unionByName(told), ["session_id", "name"])
    cells = [F.struct(F.lit(f).alias("f"), F.col(c).cast("double").alias("value")) for f, c in {"count": "n", "mean": "mean", "std": "std", "median": "median", "q10": "q10", "q90": "q90", "min": "lowest", "max": "highest", "slope": "slope"}.items()]
    long = stats.select("session_id", "name", F.explode(F.array(*cells)).alias("x")).select("session_id", F.concat_ws(".", "name", "x.f").alias("feature"), "x.value")
    return length.unionByName(shares).unionByName(long)


def feature_matrix(features: DataFrame, train: DataFrame, most: int = 2000) -> DataFrame:
    """Wide rows of the features that some training session has, by name; others are dropped, missing cells are null.

    The names are the schema, so they come to the driver: at most ``most``, more is an error.
    """
    names = [r[0] for r in features.join(train, "session_id", "left_semi").select("feature").distinct().orderBy("feature").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} features")
    return features.groupBy("session_id").pivot("feature", names).agg(F.first("value"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows / (2 * rows of the class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("_m"))
    total = n.agg(F.sum("_m").alias("_n"))
    return rows.join(F.broadcast(n.crossJoin(F.broadcast(total))), label).withColumn("weight", F.col("_n") / (2 * F.col("_m"))).drop("_m", "_n")  # two classes


def out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str, folds: int, penalty: float) -> DataFrame:
    """``session_id, label, probability, fold, prediction_origin`` of a class-balanced logistic regression that never sees the
    fold it predicts. ``rows`` should be stored: each fit reads it a few times."""
    from lumenlake.operators.policy import fit_logistic

    out = None
    for k in range(folds):  # a few fits
        w, b = fit_logistic(class_weights(rows.filter(F.col(fold) != k), label), features, label, penalty, weight="weight")
        z = F.lit(float(b))
        for c, x in zip(features, w, strict=True):
            z = z + F.col(c) * F.lit(float(x))
        own = rows.filter(F.col(fold) == k).select("session_id", F.col(label).alias("label"), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("probability"), F.lit(k).alias("fold"), F.lit("participant_out_of_fold").alias("prediction_origin"))
        out = own if out is None else out.unionByName(own)
    return out


def by_view(predictions: DataFrame) -> DataFrame:
    """``session_id, views``: each session's probabilities as a map from view."""
    return predictions.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("view", "probability")))).alias("views"))  # a few views
