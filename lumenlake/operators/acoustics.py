"""Window aggregates of action units, voice descriptors and landmarks.

Functions return aggregate columns, so that one ``groupBy(...).agg(...)`` measures a window in a
single pass. NaN counts as missing, as null does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.features import consecutive_change, iqr
from lumenlake.operators.geometry import semitones


def known(c: Column) -> Column:
    """``c`` as a double, null where it is NaN."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def middle(values: list[Column]) -> Column:
    """The median of some columns of a row; nulls are left out."""
    own = F.array_sort(F.filter(F.array(*values), lambda x: x.isNotNull()))
    n = F.size(own)
    return F.when(n > 0, (own[F.floor((n - 1) / 2).cast("int")] + own[F.floor(n / 2).cast("int")]) / 2)


def action_units(intensities: list[Column], presences: list[Column]) -> dict[str, Column]:
    """Mean intensity of all cells, the median of the columns' deviations, and the share present."""
    own, seen = [known(c) for c in intensities], [known(c) for c in presences]
    mean = lambda cells: sum((F.sum(c) for c in cells[1:]), F.sum(cells[0])) / sum((F.count(c) for c in cells[1:]), F.count(cells[0]))
    return {"facial_action_activity": mean(own), "facial_action_variability": middle([F.stddev_pop(c) for c in own]), **({"facial_action_presence_ratio": mean(seen)} if seen else {})}


def unit_intensity(names: list[str], intensities: list[Column], unit: str) -> Column | None:
    """The mean of one action unit, found whatever its case; none where it is not measured."""
    at = [n.strip().lower() for n in names]
    return F.avg(known(intensities[at.index(unit.lower())])) if unit.lower() in at else None


def level(c: Column) -> Column:
    return F.median(known(c))


def spread(c: Column) -> Column:
    return iqr(known(c))


def voiced_by_pitch(pitch: Column) -> Column:
    """A frame counts as voiced where its pitch is finite and above 0."""
    return F.coalesce(known(pitch).isNotNull() & (F.abs(pitch) < float("inf")) & (pitch > 0), F.lit(False))


def voiced_by_decision(f0: Column, vuv: Column, least: float = 0.5) -> Column:
    """... where its voicing decision is at least ``least`` as well."""
    return voiced_by_pitch(f0) & F.coalesce(known(vuv).isNotNull() & (vuv >= least), F.lit(False))


def voice_descriptors(loudness: Column, flux: Column, pitch: Column, **voiced_levels: Column) -> dict[str, Column]:
    """Loudness, spectral flux, voiced share, pitch in semitones, and medians over voiced frames."""
    on = voiced_by_pitch(pitch)
    return {
        "loudness_level": level(loudness), "loudness_variability": spread(loudness), "spectral_flux_level": level(flux), "spectral_flux_variability": spread(flux),
        "voiced_activity_ratio": F.avg(on.cast("double")), "pitch_level": level(F.when(on, pitch)), "pitch_variability": spread(F.when(on, pitch)),
        **{name: level(F.when(on, c)) for name, c in voiced_levels.items()},
    }


def glottal_descriptors(f0: Column, vuv: Column, creak: Column, **voiced_levels: Column) -> dict[str, Column]:
    """Voiced share, pitch from hertz, medians over voiced frames, and the mean creak of all frames."""
    on = voiced_by_decision(f0, vuv)
    tone = semitones(F.when(on, f0))
    return {
        "voiced_activity_ratio": F.avg(on.cast("double")), "pitch_level": level(tone), "pitch_variability": spread(tone),
        **{name: level(F.when(on, c)) for name, c in voiced_levels.items()}, "creak_activity": F.avg(known(creak)),
    }


def vector_change(frames: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """``keys, change, pairs`` of the chosen columns: cepstra, spectra or landmarks."""
    return consecutive_change(frames.select(*keys, "row_idx", F.array(*columns).alias("features")), keys)


def landmark_variability(xs: list[Column], ys: list[Column]) -> Column:
    """The median over points of the root of the summed variances of x and y."""
    return middle([F.sqrt(F.var_pop(known(x)) + F.var_pop(known(y))) for x, y in zip(xs, ys, strict=True)])


def mouth_opening(xs: list[Column], ys: list[Column], pairs: tuple = ((61, 67), (62, 66), (63, 65))) -> Column:
    """The median over frames of the mean distance of the inner lip pairs."""
    gaps = [F.sqrt((xs[a] - xs[b]) * (xs[a] - xs[b]) + (ys[a] - ys[b]) * (ys[a] - ys[b])) for a, b in pairs]
    return level(sum(gaps[1:], gaps[0]) / len(pairs))


def tracking_confidence(frames: DataFrame, keys: list[str], confidences: list[str]) -> DataFrame:
    """``keys, confidence``: the median of the confidences of several streams taken together."""
    pooled = frames.select(*keys, F.explode(F.array(*[known(F.col(c)) for c in confidences])).alias("_c"))
    return pooled.groupBy(*keys).agg(F.median("_c").alias("confidence"))


def mean_ratio(ratios: list[Column]) -> Column:
    """The mean of several streams' valid ratios; a stream without one counts 0."""
    own = [F.coalesce(r, F.lit(0.0)) for r in ratios]
    return sum(own[1:], own[0]) / len(own)


def frame_is_valid(confidence: Column, success: Column, interrupted: Column, least: float = 0.8) -> Column:
    """A tracked frame: finite confidence of at least ``least``, success of 0.5, no interruption."""
    finite = lambda c: known(c).isNotNull() & (F.abs(c) < float("inf"))
    return F.coalesce(finite(confidence) & (confidence >= least) & finite(success) & (success >= 0.5) & ~F.coalesce(interrupted, F.lit(False)), F.lit(False))


def face_missed(values: Column) -> Column:
    """A frame of zeros only, the mark of a face that was not found."""
    return F.forall(values, lambda x: x == 0)
