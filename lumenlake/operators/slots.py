"""Fixed slots: which measurement of a source speaks for each slot of its modality.

Profiles and slot definitions are small dimension tables: profiles (source_id, modality, slot_id,
binding_order, observation_name, mapping), definitions (modality, slot_id, label). Units are
(unit_id, source_id, modality, availability); observations (unit_id, name, value, percentile,
reliability, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a mapping's quality and a measurement's reliability are worth, fixed values.
MAPPING_WEIGHT = {"direct": 1.0, "derived": 0.8, "approximate": 0.5}
RELIABILITY_ORDER = {"direct": 2, "derived": 1}


def _weighed(column: str, weights: dict) -> F.Column:
    out = F.lit(None)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out


def merged_profiles(builtin: DataFrame, configured: DataFrame) -> DataFrame:
    """Profiles of the configuration replace the built-in ones of the same source, whole."""
    return builtin.join(configured.select("source_id").distinct(), "source_id", "left_anti").unionByName(configured)


def profile_mismatches(units: DataFrame, profiles: DataFrame) -> DataFrame:
    """Units of an unknown source or of another modality than their source's profile; must be none."""
    own = profiles.groupBy("source_id").agg(F.first("modality").alias("profile_modality"))
    joined = units.join(F.broadcast(own), "source_id", "left")  # one row a source
    reason = F.when(F.col("profile_modality").isNull(), "unknown_source").when(F.col("profile_modality") != F.col("modality"), "modality_mismatch")
    return joined.select("unit_id", "source_id", reason.alias("reason")).filter("reason is not null")


def project(units: DataFrame, observations: DataFrame, profiles: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row for each unit and slot of its modality, with the first binding that the unit measures.

    ``status`` is measured, unavailable (a binding exists, none is measured) or not_measured (the
    source has no binding). The unit's observations join the bindings, at most a few rows a unit;
    the dimension tables are broadcast.
    """
    grid = units.join(F.broadcast(definitions), "modality")
    bound = profiles.select("source_id", "slot_id", "binding_order", F.col("observation_name").alias("name"), "mapping")
    supported = bound.select("source_id", "slot_id").distinct().withColumn("supported", F.lit(True))
    hits = units.select("unit_id", "source_id").join(observations, "unit_id").join(F.broadcast(bound), ["source_id", "name"])
    first = hits.groupBy("unit_id", "slot_id").agg(F.min_by(F.struct("name", "value", "percentile", "mapping"), "binding_order").alias("hit"))
    rows = grid.join(F.broadcast(supported), ["source_id", "slot_id"], "left").join(first, ["unit_id", "slot_id"], "left")
    status = F.when(F.col("hit").isNotNull(), "measured").when(F.col("supported"), "unavailable").otherwise("not_measured")
    reason = (
        F.when(F.col("hit").isNotNull(), "a validated source observation is available").when(~F.coalesce("supported", F.lit(False)), "this source has no validated measurement for the slot")
        .when(F.col("availability") == "unavailable", "the source window is unavailable").otherwise("the source supports this slot, but no valid measurement passed the window checks")
    )
    return rows.select("unit_id", "source_id", "modality", "slot_id", status.alias("status"), reason.alias("reason"), F.col("hit.name").alias("name"), F.col("hit.value").alias("value"), F.col("hit.percentile").alias("percentile"), F.col("hit.mapping").alias("mapping"))


def extensions(units: DataFrame, observations: DataFrame, profiles: DataFrame, most: int = 2) -> DataFrame:
    """Each unit's best ``most`` measurements that no slot is bound to: by reliability, salience, name."""
    bound = profiles.select("source_id", F.col("observation_name").alias("name")).distinct()
    free = units.select("unit_id", "source_id").join(observations, "unit_id").join(F.broadcast(bound), ["source_id", "name"], "left_anti")
    salience = F.coalesce(F.abs(F.col("percentile") - 50), F.lit(-1.0))
    order = Window.partitionBy("unit_id").orderBy(F.desc(_weighed("reliability", RELIABILITY_ORDER)), F.desc(salience), "name")
    own = free.filter(F.col("reliability").isin(*RELIABILITY_ORDER))
    return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("unit_id", "name", "rank")


def aggregate_slots(projected: DataFrame, segments: DataFrame) -> DataFrame:
    """Slots of a segment from those of its units (``segments``: unit_id, session_id, segment_id).

    The dominant measurement is that of most units, ties to the smaller name; medians are over
    measured units; coverage is their share; salience is -1 where nothing is measured.
    """
    keys = ["session_id", "segment_id", "source_id", "slot_id"]
    rows = projected.join(segments, "unit_id")
    measured = F.col("status") == "measured"
    names = rows.filter(measured).groupBy(*keys, "name").agg(F.count("*").alias("n"))
    names = names.groupBy(*keys).agg(F.max_by("name", F.struct("n", F.col("name"))).alias("dominant"))
    out = rows.groupBy(*keys).agg(
        F.count_if(measured).alias("measured"), F.count("*").alias("units"), F.count_if(F.col("status") != "not_measured").alias("supported"), F.median("value").alias("value"), F.median("percentile").alias("percentile"),
        F.max(_weighed("mapping", MAPPING_WEIGHT)).alias("weight"),
    ).join(names, keys, "left")
    salience = F.when((F.col("measured") > 0) & F.col("percentile").isNotNull(), F.abs(F.col("percentile") - 50) * F.col("weight") * F.col("measured") / F.col("units")).otherwise(F.lit(-1.0))
    return out.withColumn("salience", salience)


def selected_slots(aggregated: DataFrame, keys: list[str], anchors: list[str], most: int) -> DataFrame:
    """The most salient measured slots of each group; an anchor comes first if its salience is 10 or more."""
    anchor = F.col("slot_id").isin(*anchors) & (F.col("salience") >= 10)
    order = Window.partitionBy(*keys).orderBy(F.desc(anchor), F.desc("salience"), F.desc("measured"), F.desc("slot_id"))
    return aggregated.filter("measured > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def coverage_state(measured: F.Column, supported: F.Column, units: F.Column) -> F.Column:
    """M n/N where measured, U N/N where only supported, else NM."""
    return F.when(measured > 0, F.format_string("M %d/%d", measured, units)).when(supported > 0, F.format_string("U %d/%d", units, units)).otherwise("NM")


def coverage_lines(projected: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """A line for each source with the state of its slots in the order of their ids."""
    c = projected.groupBy(*keys, "modality", "source_id", "slot_id").agg(F.count_if(F.col("status") == "measured").alias("m"), F.count_if(F.col("status") != "not_measured").alias("s"), F.count("*").alias("n"))
    named = c.join(F.broadcast(definitions), ["modality", "slot_id"]).withColumn("field", F.concat("label", F.lit("="), coverage_state(F.col("m"), F.col("s"), F.col("n"))))
    fields = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot_id", "field"))), lambda x: x["field"]), "; ")  # a few slots a source
    return named.groupBy(*keys, "modality", "source_id").agg(fields.alias("_f")).select(*keys, "source_id", F.concat(F.lit("- "), F.upper("modality"), F.lit(" "), F.col("source_id"), F.lit(" | "), F.col("_f")).alias("line"))


def source_payload(units: DataFrame, keys: list[str]) -> DataFrame:
    """Windows by availability, the median of the finite valid ratios, and the commonest extractor."""
    ratio = F.when(~F.isnan("valid_ratio") & (F.abs(F.col("valid_ratio")) < float("inf")), F.col("valid_ratio"))
    extractors = units.groupBy(*keys, "extractor").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("extractor", F.struct("n", "extractor")).alias("extractor"))
    states = [F.count_if(F.col("availability") == s).alias(s) for s in ("present", "partial", "unavailable")]
    return units.groupBy(*keys).agg(*states, F.median(ratio).alias("median_valid_ratio")).join(extractors, keys)
