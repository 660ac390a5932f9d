"""Framing, spectra and counter-based random numbers: the parts that need numpy inside tasks.

Framing is stateless: frame n is the last `size` samples that end at sample 1 + n * hop,
zero-padded on the left. Signals come in blocks with the samples before them (`blocks.with_halo`), so one
long track is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.operators.blocks import HOP, SPAN, floats, frames_of, lists
from framelark.operators.frontend import spectrum

FFT = 2048


def framed(cut: DataFrame, size: int = FFT, hop: int = HOP) -> DataFrame:
    """track, frame, x: the samples of each frame of cut signals (`blocks.with_halo`); a signal's first frames are shorter."""
    first = F.col("block") * (SPAN // hop)
    each = cut.where(F.size("samples") > 0).select("track", first.alias("first"), F.size("halo").alias("h"), F.concat("halo", "samples").alias("x"), F.explode(F.sequence(F.lit(0), F.ceil(F.size("samples") / hop).cast("int") - 1)).alias("k"))
    end = F.col("h") + F.col("k") * hop + 1
    begin = F.greatest(end - size, F.lit(0))
    return each.select("track", (F.col("first") + F.col("k")).alias("frame"), F.slice("x", begin + 1, end - begin).alias("x"))


def spectra(cut: DataFrame, size: int = FFT, hop: int = HOP) -> DataFrame:
    """track, frame, magnitude: Hann-windowed magnitudes over half the window's sum, of cut signals."""

    def run(batches):
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            for i, (b, halo, samples) in enumerate(zip(blocks, floats(batch.column("halo")), floats(batch.column("samples")), strict=True)):
                if len(samples):
                    m = spectrum(frames_of(halo, samples, size, hop))
                    track = batch.column("track").take(pa.array(np.full(len(m), i)))
                    yield pa.RecordBatch.from_arrays([track, pa.array(b * (SPAN // hop) + np.arange(len(m))), lists(m, pa.float64())], names=["track", "frame", "magnitude"])

    return cut.mapInArrow(run, f"track {cut.schema['track'].dataType.simpleString()}, frame long, magnitude array<double>")


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.arrow_udf(T.DoubleType())
def uniform64(*keys: pa.Array) -> pa.Array:
    """A number in [0, 1) from a counter of several long keys, independent of row order."""
    state = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        state = _splitmix(state ^ np.asarray(k).astype(np.int64).view(np.uint64))
    return pa.array((state >> np.uint64(11)).astype(float) / float(1 << 53))


def train_clauses(rows: DataFrame, members: list[dict], features: int, sample: int = 4096) -> DataFrame:
    """Clause models (a Tsetlin machine), one for each entry of `members` (keys member, clauses, threshold, s, epochs, seed).

    Members train in parallel, each in one task on the same rows (y, literals): training is
    sequential by definition, so the rows of one model are one group: at most `sample` of `rows`, chosen by a hash of their columns.
    Returns member, clause, weight, literal for the included literals.
    """

    def run(key, pdf):
        m = pdf.iloc[0]
        x = np.zeros((len(pdf), 2 * features), bool)
        for i, lits in enumerate(pdf["literals"]):
            x[i, np.asarray(lits, int)] = True
        x[:, features:] = ~x[:, :features]
        y = pdf["y"].to_numpy(bool)
        c = int(m["clauses"])
        rng = np.random.Generator(np.random.Philox(int(m["seed"])))
        state = np.full((c, 2 * features), 127, np.int16)  # included above 127
        sign = np.where(np.arange(c) % 2 == 0, 1, -1)
        limit, s = int(m["threshold"]), float(m["s"])
        for _ in range(int(m["epochs"])):
            for i in rng.permutation(len(x)):
                include = state > 127
                fired = ~(include & ~x[i]).any(axis=1)
                total = int(np.clip((sign * fired).sum(), -limit, limit))
                chance = (limit - total) / (2 * limit) if y[i] else (limit + total) / (2 * limit)
                chosen = rng.random(c) < chance
                first = chosen & ((sign > 0) == y[i])
                up = first[:, None] & fired[:, None] & x[i] & (rng.random((c, 1)) < (s - 1) / s)
                down = first[:, None] & ~(fired[:, None] & x[i]) & (rng.random((c, 2 * features)) < 1 / s)
                second = (chosen & ((sign > 0) != y[i]) & fired)[:, None] & ~x[i] & ~include
                state = np.clip(state + up + second - down, 0, 255).astype(np.int16)
        clause, literal = np.nonzero(state > 127)
        return pd.DataFrame({"member": np.full(len(clause), key[0]), "clause": clause, "weight": sign[clause], "literal": literal})

    each = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in m.items())) for m in members)))
    bounded = rows.orderBy(F.xxhash64(*rows.columns)).limit(sample)
    return bounded.select("y", "literals", each.alias("m")).select("y", "literals", "m.*").groupBy("member").applyInPandas(run, "member int, clause int, weight int, literal int")


def energy(magnitude: Column) -> Column:
    return F.aggregate(magnitude, F.lit(0.0), lambda a, v: a + v * v)
