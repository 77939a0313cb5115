"""Utterances: cleaning, visibility, lexical cues, tiers, choices and session intervals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Families of cue words and their terms, fixed values.
CUE_FAMILIES = {
    "sleep or rest words": ("sleep", "slept", "insomnia", "nightmare", "tired", "rest"),
    "mood or distress words": ("depressed", "unhappy", "upset", "cry", "crying", "irritated", "irritable"),
    "interest or activity words": ("enjoy", "interest", "interested", "fun", "hobby", "motivation"),
    "energy words": ("energy", "exhausted", "fatigue", "fatigued", "lazy"),
    "appetite or weight words": ("appetite", "eating", "food", "weight"),
    "self-evaluation words": ("failure", "worthless", "guilty", "guilt", "blame", "proud"),
    "attention words": ("focus", "focused", "concentrate", "concentration", "attention"),
    "movement or tension words": ("restless", "fidget", "fidgeting", "agitated", "slowed"),
    "safety-related words": ("suicide", "suicidal", "kill myself", "hurt myself", "self harm"),
}
#: Utterances of a segment that each tier shows; none means all. Fixed values.
TIERS = {"full": None, "standard": 4, "compact": 2, "minimal": 1}


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition. ASCII texts, which it leaves alone, stay in the JVM."""
    plain = text.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))


def normalised(text: Column) -> Column:
    """Compatibility composition, one blank for each white space run, no bar."""
    out = F.regexp_replace(nfkc(text), r"[|\t-\r\x1c-\x20\x85\u1680\u2028\u2029]+", " ")
    return F.trim(out)


def visible(utterances: DataFrame, role: str = "participant") -> DataFrame:
    """Utterances that are not scrubbed and have text: those of ``role``, or all of a session in which
    nobody has a role."""
    shown = utterances.filter("not coalesce(privacy_scrubbed, false) and text is not null and trim(text) <> ''")
    roles = F.max((F.col("speaker_role") != "unassigned").cast("int")).over(Window.partitionBy("session_id"))
    return shown.withColumn("_roles", roles).filter((F.col("speaker_role") == role) | (F.coalesce("_roles", F.lit(0)) == 0)).drop("_roles")


def cue_families(text: Column) -> Column:
    """The families that a text holds a term of, in order; terms stand between other characters than a-z."""
    low = F.lower(text)
    found = [F.when(low.rlike(r"(?<![a-z])(?:" + "|".join(terms) + r")(?![a-z])"), F.lit(name)) for name, terms in CUE_FAMILIES.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def cue_counts(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, family, n``: utterances of a group with a cue of each family."""
    return utterances.select(*keys, F.explode(cue_families(F.col("text"))).alias("family")).groupBy(*keys, "family").agg(F.count("*").alias("n"))


def segment_score(text: Column) -> Column:
    """Ten for each family of each utterance, and a little for length (an aggregate)."""
    return 10.0 * F.sum(F.size(cue_families(text))) + 0.001 * F.least(F.sum(F.length(text)), F.lit(1000))


def uniform_places(n: Column, k: int) -> Column:
    """The places (from 0) of k out of n items, spread evenly; half goes up, one alone takes the lower middle."""
    if k == 1:
        return F.array(F.floor((n - 1) / 2).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(k - 1) + 0.5).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(spread)


def even_places(n: Column, k: int) -> Column:
    """The same with half to even, and the upper middle for one alone."""
    if k == 1:
        return F.array(F.floor(n / 2).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(k - 1)).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(spread)


def tier(utterances: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The utterances of each group that a tier shows, evenly chosen in time order."""
    most = TIERS[name]
    if most is None:
        return utterances
    w = Window.partitionBy(*keys)
    rows = utterances.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("start_sec", "utterance_id")) - 1})
    return rows.filter(F.array_contains(even_places(F.col("_n"), most), F.col("_i"))).drop("_n", "_i")


def middle_confidence(c: str) -> Column:
    """The upper median: element n // 2 of the sorted values (an aggregate)."""
    return F.percentile_disc(c, 0.5) if hasattr(F, "percentile_disc") else F.expr(f"element_at(array_sort(collect_list({c})), cast(count({c}) div 2 + 1 as int))")


def chosen_utterances(utterances: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Up to half (rounded up) by cues, the rest spread evenly over what is left, in time order."""
    w = Window.partitionBy(*keys)
    rows = utterances.withColumn("_cues", F.size(cue_families(F.col("text"))))
    rows = rows.withColumns({"_n": F.count("*").over(w), "_with": F.count_if(F.col("_cues") > 0).over(w)})
    rank = F.row_number().over(w.orderBy(F.desc("_cues"), F.desc(F.length("text")), "start_sec", "utterance_id"))
    by_cue = max(1, (most + 1) // 2)
    first = (F.col("_rank") <= by_cue) & ((F.col("_with") == 0) | (F.col("_cues") > 0))
    rows = rows.withColumn("_rank", rank).withColumn("_first", first)
    taken = F.least(F.lit(by_cue), F.when(F.col("_with") > 0, F.col("_with")).otherwise(F.col("_n")))
    rows = rows.withColumns({"_left": F.col("_n") - taken, "_i": F.row_number().over(w.orderBy("_first", "start_sec", "utterance_id")) - 1, "_k": F.lit(most) - taken})
    # how many are left to choose depends on the cues found, between none and most
    places = F.lit(None).cast("array<int>")
    for k in range(1, most + 1):
        places = F.when(F.col("_k") == k, uniform_places(F.col("_left"), k)).otherwise(places)
    picked = (F.col("_n") <= most) | F.col("_first") | F.coalesce(F.array_contains(places, F.col("_i")), F.lit(False))
    return rows.filter(picked).select(*utterances.columns)


def shortened(text: Column, limit: int) -> Column:
    """Cut at a word's end, with an ellipsis, where the text is longer than ``limit``."""
    cut = F.substring(text, 1, limit - 1)
    word = F.rtrim(F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.when(F.length(word) > 0, word).otherwise(cut)), F.lit("…")))


def session_intervals(utterances: DataFrame) -> DataFrame:
    """Intervals by kind from utterances: participant speech, scrubbed passages, any speech."""
    c = F.col
    kinds = F.array(
        F.when(c("speaker_role") == "participant", F.struct(F.lit("participant").alias("kind"), F.lit("participant_speaking").alias("reason"))),
        F.when(F.coalesce("privacy_scrubbed", F.lit(False)), F.struct(F.lit("privacy").alias("kind"), F.lit("privacy_scrubbed").alias("reason"))),
        F.struct(F.lit("speech").alias("kind"), F.lit("any_speech").alias("reason")),
    )
    rows = utterances.filter("end_sec > start_sec").select("session_id", "start_sec", "end_sec", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.select("session_id", "k.kind", "start_sec", "end_sec", "k.reason")


def window_ratios(windows: DataFrame, keys: list[str], intervals: DataFrame, kinds: list[str], width: float) -> DataFrame:
    """The share of each window that the intervals of each kind cover, as ``<kind>_ratio``."""
    from lumenlake.operators.intervals import overlap_duration

    out = windows
    for kind in kinds:  # a fixed few
        covered = overlap_duration(windows, keys, intervals.filter(F.col("kind") == kind), width).select(*keys, "covered")
        out = out.join(covered.withColumnRenamed("covered", "_c"), keys).withColumn(f"{kind}_ratio", F.when(F.col("end_sec") > F.col("start_sec"), F.col("_c") / (F.col("end_sec") - F.col("start_sec"))).otherwise(F.lit(0.0))).drop("_c")
    return out
