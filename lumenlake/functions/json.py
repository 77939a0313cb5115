"""JSON completions, key guards and value predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.text import normal_key

#: Keys that may not occur in what a model sees, as ``normal_key`` writes them. Fixed values.
LABEL_KEYS = (
    "label", "label2", "label3", "labels", "target", "targetlabel", "groundtruth", "goldlabel", "samplelabel", "truelabel", "ytrue",
    "diagnosis", "depressed", "depressionlabel", "phq8", "phq8binary", "phq8score", "phq9", "phq9score", "phqbinary", "phqscore",
)


def completion(text: Column) -> Column:
    """The JSON object that a completion is, with or without a code fence; null for anything else."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(t, r"(?s)\A```(?:json)?\s*(\{.*\})\s*```\z", 1)
    own = F.when(fenced != "", fenced).otherwise(t)
    return F.when(own.startswith("{") & F.json_object_keys(own).isNotNull() & (leading_object(own) == own), own)


def leading_object(text: Column) -> Column:
    """The complete JSON object that a text begins with, whatever follows; null without one.

    Strings are blanked first, so that only real braces count; the object ends where as many are
    closed as opened. The fold keeps a depth and a place, whatever the length.
    """
    t = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    marks = F.regexp_replace(t, r'"(?:[^"\\]|\\.)*"', "")  # what is left has no strings
    shape = F.regexp_replace(marks, r"[^{}]", "")
    # the number of braces up to the one that closes the first
    closes = F.aggregate(
        F.split(shape, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.when((a["end"] > 0) | (x == ""), a).otherwise(F.struct(
            (a["depth"] + F.when(x == "{", 1).otherwise(-1)).alias("depth"), (a["n"] + 1).alias("n"), F.when((a["depth"] == 1) & (x == "}"), a["n"] + 1).otherwise(0).alias("end"),
        )),
        lambda a: a["end"],
    )
    pattern = F.concat(F.lit(r'(?s)^((?:(?:[^"{}]|"(?:[^"\\]|\\.)*")*[{}]){'), closes.cast("string"), F.lit("})"))
    found = F.call_function("regexp_extract", t, pattern, F.lit(1))  # the pattern is a column
    return F.when(t.startswith("{") & (closes > 0) & F.json_object_keys(found).isNotNull(), found)


def all_keys(text: Column) -> Column:
    """The keys that occur in a JSON text at any depth: names in front of a colon, outside other strings."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1))


def names_label(text: Column) -> Column:
    """Whether some key of a JSON text is a label key, whatever its case or separators."""
    return F.exists(all_keys(text), lambda k: normal_key(k).isin(*LABEL_KEYS))


def key_differences(text: Column, expected: list[str]) -> Column:
    """``missing`` and ``extra`` top-level keys of a JSON object, sorted."""
    have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    want = F.array(*[F.lit(k) for k in expected])
    return F.struct(F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("extra"))


def unit_number(text: Column, path: str) -> Column:
    """A JSON number within 0 and 1 at a top-level key; null for anything else, true and false included,
    and for a text that is no JSON or repeats a key."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{path}", "variant")
    n = F.try_variant_get(value, "$", "double")
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE)") & n.between(0, 1), n)


def source_problem(status: Column, risk: Column, reliability: Column) -> Column:
    """What a source's assessment breaks, or null: available ones have both values within 0 and 1, others none."""
    ok = F.coalesce(risk.between(0, 1), F.lit(False)) & F.coalesce(reliability.between(0, 1), F.lit(False))
    return (
        F.when(~F.coalesce(status.isin("available", "unavailable"), F.lit(False)), "unknown_status").when((status == "available") & ~ok, "value_out_of_range")
        .when((status == "unavailable") & (risk.isNotNull() | reliability.isNotNull()), "value_of_unavailable_source")
    )


def task_problem(task: Column, definition: Column, negative: Column, positive: Column) -> Column:
    """What a task's description breaks, or null."""
    line = lambda c, n: F.coalesce((F.length(F.trim(c)) > 0) & (F.length(c) <= n) & ~c.rlike(r"[\r\n]"), F.lit(False))
    return (
        F.when(~F.coalesce(task.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)), "bad_task_id").when(~line(definition, 1000), "bad_definition").when(~line(negative, 64) | ~line(positive, 64), "bad_label_name")
        .when(F.lower(negative) == F.lower(positive), "equal_label_names")
    )


def id_key(identifier: Column) -> Column:
    """Prefix and number of an identifier, to order by."""
    return F.struct(F.regexp_extract(identifier, r"^([^0-9]*)", 1).alias("prefix"), F.regexp_extract(identifier, r"([0-9]+)$", 1).try_cast("long").alias("number"))


def ordered_ids(ids: Column) -> Column:
    """Trimmed, non-empty ids without repeats, in order."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
