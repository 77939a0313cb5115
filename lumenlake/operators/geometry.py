"""Head, gaze and mouth measures of frames (aggregate columns; deviations are of the population)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def motion_variability(axes: list[Column]) -> Column:
    return F.sqrt(sum((F.var_pop(a) for a in axes[1:]), F.var_pop(axes[0])) / len(axes))


def rotation_range(pitch: Column, yaw: Column, roll: Column) -> Column:
    return F.array_sort(F.array(*[F.max(a) - F.min(a) for a in (pitch, yaw, roll)]))[1]


def direction_variability(x: Column, y: Column) -> Column:
    return F.sqrt(F.var_pop(x) + F.var_pop(y))


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Radians; null where a vector's length is 1e-8 or less."""
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > 1e-8) & (nb > 1e-8), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def semitones(hertz: Column) -> Column:
    return 12 * F.log2(hertz / 27.5)


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def expected_count(duration: Column, rate: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.bround(duration * rate).cast("long"))
