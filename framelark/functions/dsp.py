"""Scalar and array expressions of the signal domain (all are Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def midi_to_hz(pitch: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (pitch - 69) / 12.0)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def unit_db(amplitude: Column) -> Column:
    """Decibels from -100 to 0 mapped to 0..1."""
    return clip((20.0 * F.log10(F.greatest(amplitude, F.lit(1e-7))) + 100.0) / 100.0, 0.0, 1.0)


def sample_bin(spectrum: Column, position: Column) -> Column:
    """Linear interpolation at a fractional bin; 0 beyond the last bin."""
    low = F.floor(position).cast("int")
    part = position - low
    a, b = F.try_element_at(spectrum, low + 1), F.try_element_at(spectrum, low + 2)
    return F.when((position < 0) | (low + 1 > F.size(spectrum)), F.lit(0.0)).otherwise(a * (1 - part) + F.coalesce(b, F.lit(0.0)) * part)


def salience(harmonics: Column, count: int) -> Column:
    """Weighted mean of unit decibels of `count` harmonics, weights 1/sqrt(h)."""
    weights = [1.0 / (h**0.5) for h in range(1, count + 1)]
    total = sum(weights)
    w = F.array(*(F.lit(x / total) for x in weights))
    return F.aggregate(F.zip_with(harmonics, w, lambda a, b: unit_db(a) * b), F.lit(0.0), lambda s, x: s + x)


def harmonics(spectrum: Column, fundamental: Column, count: int, semitones: float = 0.0) -> Column:
    """Unit decibels at the first `count` harmonics of a fundamental bin, moved by so many semitones."""
    moved = fundamental * (2.0 ** (semitones / 12.0))
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda h: unit_db(sample_bin(spectrum, moved * h)))


def weighted(units: Column, count: int) -> Column:
    """Mean of units of harmonics with weights 1/sqrt(h)."""
    weights = [1.0 / (h**0.5) for h in range(1, count + 1)]
    w = F.array(*(F.lit(x / sum(weights)) for x in weights))
    return F.aggregate(F.zip_with(units, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def sides(spectrum: Column, fundamental: Column, count: int, semitones: float = 0.5) -> Column:
    """Mean unit decibels a little below and above each harmonic."""
    low, high = (harmonics(spectrum, fundamental, count, x) for x in (-semitones, semitones))
    return F.zip_with(low, high, lambda a, b: 0.5 * (a + b))


def local_contrast(spectrum: Column, fundamental: Column, count: int, every_harmonic: bool) -> Column:
    """Salience less its sides: those of the fundamental alone, or of every harmonic with its weight."""
    loud = weighted(harmonics(spectrum, fundamental, count), count)
    side = weighted(sides(spectrum, fundamental, count), count) if every_harmonic else sides(spectrum, fundamental, 1)[0]
    return centred(loud - side)


def local_profile(spectrum: Column, fundamental: Column, count: int) -> Column:
    """Each harmonic less its sides."""
    return F.zip_with(harmonics(spectrum, fundamental, count), sides(spectrum, fundamental, count), lambda a, b: centred(a - b))


def centred(difference: Column) -> Column:
    """A signed difference put around one half and clipped to 0..1."""
    return clip(difference + 0.5, 0.0, 1.0)


def compress(x: Column, floor: float, span: float) -> Column:
    """1 - exp(-(x - floor)+ / span)."""
    return 1.0 - F.exp(-F.greatest(x - floor, F.lit(0.0)) / span)


def blend(a: Column, b: Column, weight: float) -> Column:
    return a * (1 - weight) + b * weight


def velocity(amplitude: Column, floor: float, span: float) -> Column:
    """MIDI velocity 1..127; ties go to the even number."""
    return clip(F.rint(1 + 126 * F.sqrt(compress(amplitude, floor, span))), 1, 127).cast("int")


def cents(ratio: Column) -> Column:
    return 1200.0 * F.log2(ratio)


def gcd_coprime(x: Column, n: int) -> Column:
    """Whether x and n have no common divisor, by Euclid's steps folded over a fixed number of rounds."""
    rounds = F.sequence(F.lit(1), F.lit(64))
    state = F.struct(x.cast("long").alias("a"), F.lit(n).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b"))
    return F.aggregate(rounds, state, step)["a"] == 1
