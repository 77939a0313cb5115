"""Salience, choice and wording of evidence: windows (atoms), segments and their observations.

Observations are rows (unit_id, name, value, unit, percentile, robust_z, subject_z, reliability,
category); units are (unit_id, session_id, segment_id, atomic_id, modality, availability,
valid_ratio, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.transcripts import uniform_places

#: What a measurement counts by its reliability, fixed values.
RELIABILITY_WEIGHT = {"direct": 1.0, "derived": 0.9, "weak": 0.35, "latent": 0.2}


def reliability_weight(c: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in RELIABILITY_WEIGHT.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out


def observation_score(percentile: Column, subject_z: Column, reliability: Column) -> Column:
    """Seven tenths of the distance from the middle and three of the subject's deviation, by reliability."""
    far = F.coalesce(F.abs(percentile - 50) / 50, F.lit(0.0))
    odd = F.coalesce(F.least(F.abs(subject_z), F.lit(4.0)) / 4, F.lit(0.0))
    return reliability_weight(reliability) * (0.7 * far + 0.3 * odd)


def atom_salience(units: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, salience`` of atomic windows: the mean over units of their two best scores and quality,
    and a tenth more where two modalities are there."""
    scored = observations.select("unit_id", observation_score(F.col("percentile"), F.col("subject_z"), F.col("reliability")).alias("s"))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("s")))).filter("_r <= 2")
    strongest = best.groupBy("unit_id").agg(F.avg("s").alias("strongest"))
    ratio = F.when(F.isnan("valid_ratio"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("valid_ratio", F.lit(0.0)))))
    rows = units.join(strongest, "unit_id", "left").withColumn("u", 0.8 * F.coalesce("strongest", F.lit(0.0)) + 0.2 * ratio)
    bonus = F.when(F.count_if(F.col("availability") != "unavailable") >= 2, 0.1).otherwise(0.0)
    return rows.groupBy(*keys).agg((F.avg("u") + bonus).alias("salience"))


def segment_salience(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, salience``: seven tenths of the mean of the four best atoms, three of the mean of all."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("salience")))
    rows = atoms.withColumn("_r", rank)
    return rows.groupBy(*keys).agg((0.7 * F.avg(F.when(F.col("_r") <= 4, F.col("salience"))) + 0.3 * F.avg("salience")).alias("salience"))


def chosen_atoms(atoms: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The most salient half of ``most`` atoms and an even choice of the rest (``mid``, ``atomic_no``)."""
    w = Window.partitionBy(*keys)
    head = max(1, most // 2)
    rows = atoms.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc("salience"), "mid", "atomic_no"))})
    rows = rows.withColumn("_first", F.col("_r") <= head)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy("_first", "mid", "atomic_no")) - 1)
    places = uniform_places(F.col("_n") - head, most - head) if most > head else F.array().cast("array<int>")
    return rows.filter((F.col("_n") <= most) | F.col("_first") | F.array_contains(places, F.col("_i"))).select(*atoms.columns)


def aggregate_observation(units: DataFrame, observations: DataFrame, keys: list[str], priorities: dict[str, int]) -> DataFrame:
    """``keys, name, percentile, n, score``: the measurement that says most about a group of units.

    Its score weighs the name's priority (of 20), the distance of its median percentile from the
    middle, and the share of units that have it, by its best reliability.
    """
    total = units.groupBy(*keys).agg(F.count("*").alias("units"))
    rows = units.select("unit_id", *keys).join(observations.filter("percentile is not null"), "unit_id")
    each = rows.groupBy(*keys, "name").agg(F.median("percentile").alias("percentile"), F.count("*").alias("n"), F.max(reliability_weight(F.col("reliability"))).alias("w")).join(total, keys)
    priority = F.lit(0.0)
    for name, p in priorities.items():
        priority = F.when(F.col("name") == name, p / 20.0).otherwise(priority)
    score = F.col("w") * (0.55 * priority + 0.35 * F.abs(F.col("percentile") - 50) / 50 + 0.10 * F.col("n") / F.greatest(F.lit(1), F.col("units")))
    best = F.max_by(F.struct("name", "percentile", "n", "score"), F.struct("score", "name"))
    return each.withColumn("score", score).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def shown_observations(observations: DataFrame, anchors: list[str], most: int) -> DataFrame:
    """Each unit's first available anchor, then its best by reliability, salience and name."""
    w = Window.partitionBy("unit_id")
    place = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(anchors))):
        place = F.when(F.col("name") == name, i).otherwise(place)
    class_ = F.when(F.col("reliability").isin("direct", "derived"), 2).when(F.col("reliability") == "weak", 1).otherwise(0)
    salience = F.coalesce(F.abs(F.col("percentile") - 50), F.lit(-1.0))
    rows = observations.withColumn("_p", place).withColumn("_anchor", F.coalesce(F.col("_p") == F.min("_p").over(w), F.lit(False)))
    rank = F.row_number().over(w.orderBy(F.desc("_anchor"), F.desc(class_), F.desc(salience), F.desc("name")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).drop("_p", "_anchor")


def rendered_observations(observations: DataFrame, priorities: dict[str, int], most: int) -> DataFrame:
    """Each unit's best ``most`` by priority, salience, reliability and place, in their first order (``pos``)."""
    order = F.lit(0)
    for name, p in priorities.items():
        order = F.when(F.col("name") == name, p).otherwise(order)
    class_ = F.when(F.col("reliability") == "direct", 3).when(F.col("reliability") == "derived", 2).when(F.col("reliability") == "weak", 1).otherwise(0)
    salience = F.coalesce(F.abs(F.col("percentile") - 50), F.lit(-1.0))
    rank = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc(order), F.desc(salience), F.desc(class_), "pos"))
    return observations.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def initial_segments(segments: DataFrame, most: int) -> DataFrame:
    """Segments (session_id, segment_no, salience, cue_score) of a first look: an even third of them,
    then by salience and by cues in turn, rounded to the side of salience."""
    w = Window.partitionBy("session_id")
    even = min(most, max(2, most // 3))
    by_salience = (most - even + 1) // 2
    rows = segments.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("segment_no")) - 1})
    rows = rows.withColumn("_even", F.array_contains(uniform_places(F.col("_n"), even), F.col("_i")))
    rank = F.row_number().over(Window.partitionBy("session_id", "_even").orderBy(F.desc("salience"), "segment_no"))
    rows = rows.withColumn("_a", F.col("_even") | (rank <= by_salience))
    rank = F.row_number().over(Window.partitionBy("session_id", "_a").orderBy(F.desc("cue_score"), "segment_no"))
    rows = rows.withColumn("_c", rank)
    return rows.filter((F.col("_n") <= most) | F.col("_a") | (F.col("_c") <= most - even - by_salience)).select(*segments.columns)


def review_segments(segments: DataFrame, most: int = 4) -> DataFrame:
    """Segments to look at again: by cues where the session has any words, else by salience."""
    w = Window.partitionBy("session_id")
    rows = segments.withColumn("_words", F.bool_or("has_text").over(w))
    key = F.when(F.col("_words"), F.col("cue_score")).otherwise(F.col("salience"))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc(key), "segment_no"))).filter(F.col("rank") <= most).drop("_words")


def cross_modal_context(units: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """What modalities an atom has, and how many measurements are two deviations off, by modality."""
    odd = observations.filter("abs(subject_z) >= 2").groupBy("unit_id").agg(F.count("*").alias("n"))
    there = lambda m: F.bool_or((F.col("modality") == m) & (F.col("availability") != "unavailable"))
    count = lambda m: F.coalesce(F.sum(F.when(F.col("modality") == m, F.col("n"))), F.lit(0))
    rows = units.join(odd, "unit_id", "left").groupBy(*keys).agg(there("audio").alias("a"), there("visual").alias("v"), count("audio").alias("audio_odd"), count("visual").alias("visual_odd"))
    text = F.when(F.col("a") & F.col("v"), "audio and visual measurements were both available").when(F.col("a"), "only audio measurements were available").when(F.col("v"), "only visual measurements were available").otherwise("audio and visual measurements were unavailable")
    return rows.select(*keys, text.alias("availability"), "audio_odd", "visual_odd")


def segment_contrast(units: DataFrame, observations: DataFrame, keys: list[str], anchors: list[str], least: float = 10.0) -> DataFrame:
    """Per group the measurement whose percentile changes most from the first to the last window that
    has it (anchors first, then the change, then the name), and how they relate."""
    rows = units.select("unit_id", "start_sec", *keys).join(observations.filter("percentile is not null").select("unit_id", "name", "percentile"), "unit_id")
    ends = rows.groupBy(*keys, "name").agg(F.min_by("percentile", F.struct("start_sec", "unit_id")).alias("first"), F.max_by("percentile", F.struct("start_sec", "unit_id")).alias("last"), F.count("*").alias("n")).filter("n >= 2")
    delta = F.col("last") - F.col("first")
    best = F.max_by(F.struct("name", "first", "last"), F.struct(F.col("name").isin(*anchors), F.abs(delta), "name"))
    relation = F.when(F.col("b.last") - F.col("b.first") >= least, "higher").when(F.col("b.last") - F.col("b.first") <= -least, "lower").otherwise("similar")
    return ends.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.name", "b.first", "b.last", relation.alias("relation"))


def percentile_words(p: Column) -> Column:
    return (
        F.when(p < 5, "far below the training reference").when(p < 25, "below the training reference").when(p <= 75, "within the central training-reference range")
        .when(p < 95, "above the training reference").otherwise("far above the training reference")
    )


def plain_number(value: Column, digits: int) -> Column:
    """Fixed digits without trailing zeros; minus nought is nought."""
    fixed = F.format_string(f"%.{digits}f", value)
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def measurement_phrase(name: Column, value: Column, unit: Column, percentile: Column, category: Column, reliability: Column, subject_z: Column) -> Column:
    """A sentence about one measurement; a ratio is told in percent."""
    known = percentile.isNotNull() & (category != "unreferenced")
    where = F.when(known, F.concat(F.lit("was "), F.replace(category, F.lit("_"), F.lit(" ")), F.lit(" at training-reference percentile "), F.bround(percentile).cast("int").cast("string"))).otherwise("had no fitted training reference")
    amount = F.when(unit == "ratio", F.concat(plain_number(100 * value, 4), F.lit(" percent"))).otherwise(F.concat(plain_number(value, 4), F.lit(" "), F.replace(unit, F.lit("_"), F.lit(" "))))
    label = F.replace(name, F.lit("_"), F.lit(" "))
    trust = F.when(reliability.isin("direct", "derived"), F.concat(F.lit(" Reliability: "), reliability, F.lit(" measurement."))).otherwise(F.concat(F.lit(" Reliability: "), reliability, F.lit("; signal pattern only.")))
    usual = F.when(subject_z >= 2, " It was above this session's usual level.").when(subject_z <= -2, " It was below this session's usual level.").otherwise("")
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 20), F.lit(" "), where, F.lit("; measured value "), amount, F.lit("."), trust, usual)


def modality_line(modality: str, units: Column, available: Column, ratio: Column, name: Column, percentile: Column, n: Column) -> Column:
    """A line about a modality of a segment, without any exact value of a window."""
    pattern = F.when(name.isNull(), "no referenced observation was available").otherwise(
        F.concat(F.lit("most salient aggregate was "), F.replace(name, F.lit("_"), F.lit(" ")), F.lit(", "), percentile_words(percentile), F.lit(" at median percentile "), F.bround(percentile).cast("int").cast("string"), F.lit(" across "), n.cast("string"), F.lit(" windows"))
    )
    cover = F.when(ratio.isNull(), "valid coverage not reported").otherwise(F.concat(F.lit("median valid coverage "), F.bround(100 * ratio).cast("int").cast("string"), F.lit(" percent")))
    return F.when(units == 0, f"{modality.capitalize()}: source unavailable").otherwise(
        F.concat(F.lit(f"{modality.capitalize()}: "), available.cast("string"), F.lit(" of "), units.cast("string"), F.lit(" windows available; "), cover, F.lit("; "), pattern, F.lit("."))
    )


def unit_line(units: DataFrame, observations: DataFrame) -> DataFrame:
    """``unit_id, line``: a unit and its measurements (few a unit, in the order ``pos``) on one line."""
    token = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_.+-]+", "_")
    one = F.concat(
        F.col("name"), F.lit("="), plain_number(F.col("value"), 4), F.lit(":"), token(F.col("unit")), F.lit("[category="), F.col("category"),
        F.coalesce(F.concat(F.lit(",p="), F.bround("percentile").cast("int").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(",z="), plain_number(F.col("robust_z"), 2)), F.lit("")),
        F.lit(",reliability="), F.col("reliability"), F.lit("]"),
    )
    told = observations.groupBy("unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"]), "; ").alias("_t"))
    head = F.concat(F.lit("["), F.upper("modality"), F.lit("|id="), F.col("unit_id").cast("string"), F.lit("] availability="), F.col("availability"), F.coalesce(F.concat(F.lit("; valid_ratio="), plain_number(F.col("valid_ratio"), 4)), F.lit("")))
    return units.join(told, "unit_id", "left").select("unit_id", F.concat(head, F.coalesce(F.concat(F.lit("; "), F.col("_t")), F.lit("")), F.lit(".")).alias("line"))


def atom_index(atoms: DataFrame, segments: DataFrame) -> DataFrame:
    """Atoms (session_id, atomic_id, ...) with the segment that lists them (session_id, segment_id, atomic_ids)."""
    listed = segments.select("session_id", "segment_id", F.explode("atomic_ids").alias("atomic_id"))
    return atoms.join(listed, ["session_id", "atomic_id"], "left")


def index_violations(atoms: DataFrame, segments: DataFrame) -> DataFrame:
    """Atoms that are not in exactly one segment, and listed ids without an atom; must be none."""
    listed = segments.select("session_id", F.explode("atomic_ids").alias("atomic_id")).groupBy("session_id", "atomic_id").agg(F.count("*").alias("listed"))
    own = atoms.groupBy("session_id", "atomic_id").agg(F.count("*").alias("atoms"))
    both = own.join(listed, ["session_id", "atomic_id"], "full").select("session_id", "atomic_id", F.coalesce("atoms", F.lit(0)).alias("atoms"), F.coalesce("listed", F.lit(0)).alias("listed"))
    reason = F.when(F.col("atoms") == 0, "unknown_atom").when(F.col("atoms") > 1, "repeated_atom").when(F.col("listed") == 0, "without_segment").when(F.col("listed") > 1, "in_several_segments")
    return both.select("session_id", "atomic_id", reason.alias("reason")).filter("reason is not null")
