"""Keys, number formats and text guards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What texts may not contain.
INTERPRETIVE = [
    r"\bdepress(?:ed|ion|ive)?\b",
    r"\banxi(?:ous|ety)\b",
    r"\bsad(?:ness)?\b",
    r"\bhopeless(?:ness)?\b",
    r"\bdull gaze\b",
    r"\bhelpless(?:ness)?\b",
    r"\bsuicid(?:e|al)\b",
]
SHORTHAND = [
    r"(?i)\b(?:spk|au_var|head_var|gaze_var|pitch_var|loud_var)\b",
    r"\b(?:VL|VH|L|T)\d+\b",
    r"\^[A-Za-z]",
    r"(?:^|\|)(?:A|V)\[",
]
GROUND_TRUTH = r"""(?i)(?:"|')?(?:ground[ _-]?truth|gold[ _-]?label|sample[ _-]?label|target[ _-]?label|true[ _-]?label|label)(?:"|')?\s*[:=]"""

# The facet of an observation by parts of its name, first match.
FACETS = [("dispersion", "variability|std|variance"), ("iqr", "iqr|_range"), ("slope_or_change", "slope|trend|change_magnitude|_speed")]


def interpretive(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(INTERPRETIVE))


def opaque(text: Column) -> Column:
    hits = [text.rlike(p) for p in SHORTHAND]
    return hits[0] | hits[1] | hits[2] | hits[3]


def marks_truth(text: Column) -> Column:
    return text.rlike(GROUND_TRUTH)


def facet(name: Column) -> Column:
    out = F.lit("level")
    for label, pattern in reversed(FACETS):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def collection_condition(session: Column) -> Column:
    """By the range that a numeric session id lies in."""
    n = session.try_cast("long")
    return F.when(n.between(300, 492), "wizard_of_oz").when(n.between(600, 718), "autonomous_ai").otherwise("unknown")


def normal_key(value: Column) -> Column:
    """Lower-case letters and digits only; sharp s counts as ss."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, "[ßẞ]", "ss")), "[^a-z0-9]", "")


def safe_token(value: Column) -> Column:
    """Runs of other characters become one underscore; ``unknown`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_.:-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def number(value: Column, digits: int = 3) -> Column:
    """Fixed digits without trailing zeros; null and non-finite values are ``unavailable``."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value), "0+$", ""), r"\.$", "")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.when(plain.isin("", "-0"), "0").otherwise(plain)).otherwise("unavailable")


def plain_number(raw: Column) -> Column:
    """A decimal number, blanks around it or not; null for anything else, as for ``1d``, ``5f``, ``NaN`` and ``0x1``, of
    which a cast would take some."""
    t = F.trim(raw)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def normal_id(raw: Column) -> Column:
    """``300.0`` becomes ``300``; what is no whole number stays as it is, trimmed."""
    t = F.trim(raw)
    n = plain_number(t)
    return F.when(n.isNotNull() & (F.abs(n) < 1e15) & (n == F.floor(n)), n.cast("long").cast("string")).otherwise(t)
