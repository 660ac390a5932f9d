"""Two causal frontends on blocks: spectral pitch features, and acoustic evidence from a short and a long window.

Both are numpy on the frames of one block inside tasks; `blocks.features` deals the blocks, carries averages over
their borders and stacks lagged frames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.operators.blocks import FRAMES, Frontend, features
from framelark.operators.quantiles import quantiles
from framelark.operators.sized import small
from framelark.written import written

SAMPLE_RATE = 22_050
LOW, HIGH = 40, 88
FFT, HARMONICS, ALPHA = 2_048, 6, 0.08
SHORT_FFT, LONG_FFT, TRACKED_HARMONICS = 512, 4_096, 11
OWNER_STRENGTH, OWNER_CENTS = 1.05, 18.0
FLOOR, LOUD, ATTACK_LOUD = 0.0015, 0.10, 0.035
MASK_FROM, MASK_SPAN = 1.02, 0.18
OWN_PART, LONG_PART = 0.72, 0.78
FLUX_GAIN = 40.0
GROUPS = ("fundamental", "harmonic_salience", "local_contrast", "subharmonic_margin", "positive_flux", "fast_slow_attack")
GLOBALS = ("rms", "broadband_flux", "spectral_centroid")
CONTEXT = (0, 1, 2, 4, 8, 16, 32)


def hz(pitches: np.ndarray) -> np.ndarray:
    return 440.0 * 2.0 ** ((pitches - 69) / 12.0)


def unit_db(x: np.ndarray) -> np.ndarray:
    """Decibels from -100 to 0 as 0..1."""
    return np.clip(np.log10(np.maximum(x, 1e-7)) / 5 + 1, 0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def spectrum(frames: np.ndarray) -> np.ndarray:
    """Magnitudes of Hann-windowed frames, a full-scale tone being about 1."""
    window = np.hanning(frames.shape[1]).astype(np.float32)
    return (np.abs(np.fft.rfft(frames * window, axis=1)) * (2.0 / window.sum(dtype=np.float64))).astype(np.float32)


class Bins:
    """Spectra read at fractional bins, between the two bins next to each; 0 above the last one."""

    def __init__(self, frequencies: np.ndarray, fft: int, rate: int):
        at = frequencies * fft / rate
        self.low = np.minimum(np.floor(at).astype(int), fft // 2)
        self.high = np.minimum(self.low + 1, fft // 2)
        self.part, self.inside = at - self.low, at <= fft // 2

    def of(self, magnitude: np.ndarray) -> np.ndarray:
        return np.where(self.inside, magnitude[:, self.low] * (1 - self.part) + magnitude[:, self.high] * self.part, 0.0)


@dataclass(frozen=True)
class PitchFeatures(Frontend):
    """Spectral features of each pitch, and three of the whole frame.

    every_harmonic: the contrast is taken at the sides of every harmonic, not of the fundamental alone. profile: each harmonic's own
    contrast, harmonic by harmonic. contrast_attack: flux and fast-minus-slow of the contrast too.
    """

    rate: int = SAMPLE_RATE
    low: int = LOW
    high: int = HIGH
    harmonics: int = HARMONICS
    fft: int = FFT
    alpha: float = ALPHA
    every_harmonic: bool = False
    side_semitones: float = 0.5
    profile: bool = False
    contrast_attack: bool = False
    before = 1

    def __post_init__(self):
        if self.profile and not self.every_harmonic:
            raise ValueError("the profile needs the sides of every harmonic")

    @property
    def size(self) -> int:
        return self.fft

    @property
    def pitches(self) -> np.ndarray:
        return np.arange(self.low, self.high + 1)

    def names(self) -> list[str]:
        groups = [*GROUPS]
        groups += [f"harmonic_local_profile_h{h}" for h in range(1, self.harmonics + 1)] if self.profile else []
        groups += ["contrast_positive_flux", "contrast_fast_slow_attack"] if self.contrast_attack else []
        return [f"{g}:midi_{p}" for g in groups for p in self.pitches] + [*GLOBALS]

    def start(self) -> np.ndarray:
        n = len(self.pitches)
        return np.concatenate([np.zeros(n), np.full(n, 0.5)]) if self.contrast_attack else np.zeros(n)

    def measure(self, frames: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        n, base = len(self.pitches), hz(self.pitches)
        steps = np.arange(1, self.harmonics + 1)
        weights = 1 / np.sqrt(steps)
        weights /= weights.sum()
        m = spectrum(frames)
        at = lambda f: unit_db(Bins(f, self.fft, self.rate).of(m))
        tones = (base[:, None] * steps).ravel()  # pitch by pitch
        loud = at(tones).reshape(len(m), n, self.harmonics)
        shift = 2.0 ** (self.side_semitones / 12)
        sides = tones if self.every_harmonic else base
        side = 0.5 * (at(sides / shift) + at(sides * shift)).reshape(len(m), n, -1)
        salience = loud @ weights
        contrast = unit(salience - (side @ weights if self.every_harmonic else side[..., 0]) + 0.5)
        margin = unit(salience - at(base / 2) + 0.5)
        # the frame before each: nothing sounds before a signal's first
        earlier = lambda x, nothing: np.concatenate([x[:1] * 0 + nothing, x])[: len(x)] if first == 0 else x[:-1]
        own = slice(0 if first == 0 else 1, None)
        flux = unit(salience[own] - earlier(salience, 0))
        rms = unit_db(np.sqrt(np.mean(frames[own].astype(np.float64) ** 2, axis=1)))
        rise = np.maximum(m[own] - earlier(m, 0), 0).mean(axis=1, dtype=np.float64)
        total = m[own].sum(axis=1, dtype=np.float64)
        centre = m[own].astype(np.float64) @ np.arange(m.shape[1]) * (self.rate / self.fft)
        centre = np.where(total > 1e-9, centre / np.maximum(total, 1e-9), 0.0) / (self.rate / 2)
        columns = [loud[own, :, 0], salience[own], contrast[own], margin[own], flux]
        if self.profile:
            columns.append(unit(loud[own] - side[own] + 0.5).transpose(0, 2, 1).reshape(len(flux), -1))
        if self.contrast_attack:
            columns.append(unit(contrast[own] - earlier(contrast, 0.5)))
        columns.append(np.stack([rms, unit(rise * FLUX_GAIN), unit(centre)], axis=1))
        averaged = [salience[own], contrast[own]] if self.contrast_attack else [salience[own]]
        return np.concatenate(columns, axis=1), np.concatenate(averaged, axis=1)

    def finish(self, raw, values, earlier, average):
        n = len(self.pitches)
        attack = unit(values - average + 0.5)
        parts = [raw[:, : 5 * n], attack[:, :n]]
        rest = raw[:, 5 * n :]
        if self.contrast_attack:
            k = rest.shape[1] - len(GLOBALS)
            parts += [rest[:, :k], attack[:, n:], rest[:, k:]]
        else:
            parts.append(rest)
        return np.concatenate(parts, axis=1).astype(np.float32)


def ownership(frequencies: np.ndarray, harmonics: int, cents: float = OWNER_CENTS) -> np.ndarray:
    """Rows (pitch, harmonic, owner, owner's harmonic), from 0 and harmonics from 1: harmonics that a lower pitch has within so many cents."""
    pitch, h, owner = (g.ravel() for g in np.meshgrid(np.arange(len(frequencies)), np.arange(1, harmonics + 1), np.arange(len(frequencies)), indexing="ij"))
    ratio = frequencies[pitch] * h / frequencies[owner]
    own = np.rint(ratio).astype(int)
    with np.errstate(divide="ignore"):
        near = np.abs(1200 * np.log2(ratio / np.maximum(own, 1))) <= cents
    return np.stack([pitch, h, owner, own], axis=1)[(owner < pitch) & (own >= 2) & (own <= harmonics) & near]


@dataclass(frozen=True)
class DualResolution(Frontend):
    """Acoustic evidence: a long window says which pitches sound, a short one when they are struck.

    What lower pitches' harmonics explain is taken off each harmonic; the long window's tuning mask then holds for the fundamentals of both.
    Features: activity, onset, attack energy and fundamental amplitude, each of every pitch.
    """

    rate: int = SAMPLE_RATE
    low: int = LOW
    high: int = HIGH
    harmonics: int = TRACKED_HARMONICS
    short: int = SHORT_FFT
    long: int = LONG_FFT
    decay: float = 1.0
    alpha: float = ALPHA

    @property
    def size(self) -> int:
        return self.long

    @property
    def pitches(self) -> np.ndarray:
        return np.arange(self.low, self.high + 1)

    def start(self) -> np.ndarray:
        return np.zeros(len(self.pitches))

    def residual(self, amplitude: np.ndarray) -> np.ndarray:
        """(frames, pitches, harmonics) less what owners explain: the smaller of their harmonic as measured and as their fundamental lets expect."""
        links = ownership(hz(self.pitches), self.harmonics)
        pitch, h, owner, own = links.T
        expected = amplitude[:, owner, 0] * (OWNER_STRENGTH / own.astype(float) ** self.decay)
        explained = np.minimum(amplitude[:, owner, own - 1], expected)
        cell = pitch * self.harmonics + h - 1  # ascending
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        out = amplitude.copy()
        if len(links):
            out[:, pitch[starts], h[starts] - 1] -= np.add.reduceat(explained, starts, axis=1)
        return np.maximum(out, 0.0)

    def measure(self, frames: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        steps = np.arange(1, self.harmonics + 1)
        weights = steps**-self.decay
        weights /= weights.sum()
        tones = (hz(self.pitches)[:, None] * steps).ravel()
        both = {}
        for name, size in (("long", self.long), ("short", self.short)):
            amplitude = Bins(tones, size, self.rate).of(spectrum(frames[:, -size:])).reshape(len(frames), -1, self.harmonics)
            both[name] = (amplitude, self.residual(amplitude))
        fundamental = both["long"][0][..., 0]
        beside = np.pad(fundamental, ((0, 0), (1, 1)))
        stands_out = fundamental / np.maximum(np.maximum(beside[:, :-2], beside[:, 2:]), 1e-8)
        mask = unit((stands_out - MASK_FROM) / MASK_SPAN)
        pitch = {}
        for name, (_, rest) in both.items():
            rest[..., 0] *= mask
            loud = 1 - np.exp(-np.maximum(rest - FLOOR, 0) / (LOUD - FLOOR))
            pitch[name] = OWN_PART * loud[..., 0] + (1 - OWN_PART) * (loud @ weights)
        activity = unit(LONG_PART * pitch["long"] + (1 - LONG_PART) * pitch["short"])
        struck = both["short"][1]
        return np.concatenate([activity, both["long"][1][..., 0]], axis=1), LONG_PART * struck[..., 0] + (1 - LONG_PART) * (struck @ weights)

    def finish(self, raw, values, earlier, average):
        n = len(self.pitches)
        attack = np.maximum(values - earlier, 0)
        onset = 1 - np.exp(-np.maximum(attack - FLOOR, 0) / ATTACK_LOUD)
        return np.concatenate([raw[:, :n], onset, attack, raw[:, n:]], axis=1).astype(np.float32)


def evidence(cut: DataFrame, frontend: DualResolution = DualResolution(), frames: int = FRAMES) -> DataFrame:  # noqa: B008
    """track, frame, activity, onset, attack, fundamental (arrays over pitches): the input of `tracker.track`."""
    n = len(frontend.pitches)
    x = features(cut, frontend, frames=frames)
    return x.select("track", "frame", *(F.slice("x", k * n + 1, n).alias(name) for k, name in enumerate(("activity", "onset", "attack", "fundamental"))))


@dataclass(frozen=True)
class Thermometer:
    """Thresholds (columns x levels) and which of the bits, column by column, are literals."""

    thresholds: np.ndarray
    kept: np.ndarray

    def words(self, x: np.ndarray) -> np.ndarray:
        """64 literals in a word, the first in the lowest bit."""
        bits = (x[:, :, None] >= self.thresholds).reshape(len(x), -1)[:, self.kept]
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<i8")

    def encode(self, x: Column) -> Column:
        """The words of an array column; the thresholds go to each task once."""

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def run(rows: pa.Array) -> pa.Array:
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), len(self.thresholds))
            out = self.words(flat)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return run(x)


def literals(cut: DataFrame, thermometer: Thermometer, frontend: PitchFeatures = PitchFeatures(), lags: tuple[int, ...] = CONTEXT, frames: int = FRAMES) -> DataFrame:  # noqa: B008
    """track, frame, words: an unlabelled dataset of cut signals for inference."""
    width = len(frontend.names()) * len(lags)
    if len(thermometer.thresholds) != width:
        raise ValueError(f"thresholds of {len(thermometer.thresholds)} columns, features of {width}")
    x = features(cut, frontend, lags, frames)
    return x.select("track", "frame", thermometer.encode(F.col("x")).alias("words"))


LEVELS = (0.5, 0.7, 0.85, 0.95)


def fit_thermometer(x: DataFrame, lags: tuple[int, ...] = (0,), levels: tuple[float, ...] = LEVELS) -> Thermometer:
    """Thresholds at exact quantiles of every column of the lag-stacked features, from the features themselves (track, frame, x).

    A column that lags by k has the column's values without the last k of each track, and k zeros for each: so it is counted
    from the column's values, and the stack isn't made. Bits that are always or never set are left out.
    """
    x = written(x)  # read for the counts, and in each round of the quantiles
    last = x.groupBy("track").agg(F.max("frame").alias("last"))
    each = x.join(small(last), "track").select((F.col("last") - F.col("frame")).alias("after"), "last", F.posexplode("x").alias("d", "v"))
    delays = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(k).alias("lag")) for i, k in enumerate(lags))))
    seen = each.select("d", "v", "after", delays.alias("k")).where(F.col("after") >= F.col("k.lag")).select(F.col("k.slot").alias("slot"), "d", "v")
    zeros = x.groupBy("track").agg(F.max("frame").alias("last"), F.max(F.size("x")).alias("width")).select(
        delays.alias("k"), "last", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("d")
    ).select(F.col("k.slot").alias("slot"), "d", F.explode(F.array_repeat(F.lit(0.0).cast("float"), F.least(F.col("k.lag"), F.col("last") + 1).cast("int"))).alias("v"))
    stacked = seen.unionByName(zeros)
    cuts = quantiles(stacked, levels, ("slot", "d")).withColumn("t", F.col("v").cast("float")).select("slot", "d", "q", "t")
    ends = stacked.groupBy("slot", "d").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    got = cuts.join(small(ends), ["slot", "d"]).orderBy("slot", "d", "q").toPandas()  # a row for each column and level
    t = got["t"].to_numpy(np.float32)
    return Thermometer(t.reshape(-1, len(levels)), (got["most"].to_numpy() >= t) & (got["least"].to_numpy() < t))
