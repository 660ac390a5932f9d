"""Feature matrices: lags, flux, averages, thermometer bits and packing.

The wide form is (track, frame, x array<double>), the long form
(track, frame, d, v). Bits are sparse: a row for each set literal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from framelark.operators.quantiles import quantile_columns
from framelark.operators.quantiles import quantiles as exact_quantiles
from framelark.operators.sized import small

FRAME = ("track", "frame")
LAGS = (0, 1, 2, 4, 8, 16, 32)


def to_long(wide: DataFrame, *keep: str) -> DataFrame:
    return wide.select(*FRAME, *keep, F.posexplode("x").alias("d", "v"))


def _order() -> W:
    return W.partitionBy("track").orderBy("frame")


def lag_stack(wide: DataFrame, width: int, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Concatenated lags of the vector, zeros where the track has not begun (one window, no join)."""
    zeros = F.array_repeat(F.lit(0.0), width)
    parts = [F.coalesce(F.lag("x", k).over(_order()), zeros) if k else F.col("x") for k in lags]
    return wide.select(*FRAME, F.concat(*parts).alias("ctx"))


def flux(wide: DataFrame, initial: float = 0.0) -> DataFrame:
    """Positive change from the frame before, clipped to 0..1."""
    before = F.lag("x").over(_order())
    first = F.transform("x", lambda _: F.lit(initial))
    change = F.zip_with("x", F.coalesce(before, first), lambda a, b: F.greatest(F.least(a - b, F.lit(1.0)), F.lit(0.0)))
    return wide.select(*FRAME, change.alias("x"))


SPAN = 4096  # frame numbers of a block


def smoothed(wide: DataFrame, alpha: float = 0.08, span: int = SPAN) -> DataFrame:
    """Fast minus slow: clip(x - ema + 0.5), the average being updated first.

    The average is linear, so tracks are cut into blocks of `span` frame numbers: each block is averaged from
    zero, the ends of a track's blocks are carried on (a vector for each block), and a block then adds what
    was carried to it. So a task holds one block, however long a track is.
    """
    keep = 1.0 - alpha

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        x = np.stack(frame["x"].to_list())
        slow, ema = np.empty_like(x), np.zeros_like(x[0])
        for i, row in enumerate(x):
            ema = keep * ema + alpha * row
            slow[i] = ema
        return pd.DataFrame({"track": frame["track"], "block": frame["block"], "frame": frame["frame"], "k": np.arange(1, len(x) + 1), "x": list(x), "slow": list(slow)})

    blocks = wide.select(*FRAME, "x", F.floor(F.col("frame") / span).alias("block"))
    schema = "track long, block long, frame long, k long, x array<double>, slow array<double>"
    averaged = blocks.groupBy("track", "block").applyInPandas(local, schema)
    ends = averaged.groupBy("track", "block").agg(F.max_by("slow", "k").alias("end"), F.max("k").alias("n"), F.min_by("x", "k").alias("first"))

    def on(carried: Column, block: Column) -> Column:
        decay = F.pow(F.lit(keep), block["n"])
        now = F.element_at(carried, -1)["carry"]
        after = F.zip_with(now, block["end"], lambda c, e: c * decay + e)
        return F.concat(carried, F.array(F.struct(F.lit(None).cast("long").alias("block"), after.alias("carry"))))

    listed = ends.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("block", "n", "end", "first"))).alias("b"))
    start = F.array(F.struct(F.lit(None).cast("long").alias("block"), F.col("b")[0]["first"].alias("carry")))  # a track begins at its first value
    carry = listed.select("track", "b", F.aggregate("b", start, on).alias("c")).select("track", F.explode(F.arrays_zip("b", F.slice("c", 1, F.size("b")))).alias("z"))
    carry = carry.select("track", F.col("z")["b"]["block"].alias("block"), F.col("z").getField("1")["carry"].alias("carry"))
    slow = F.zip_with("slow", "carry", lambda s, c: s + c * F.pow(F.lit(keep), F.col("k")))
    fast = F.zip_with("x", slow, lambda x, e: F.greatest(F.least(x - e + 0.5, F.lit(1.0)), F.lit(0.0)))
    return averaged.join(carry, ["track", "block"]).select(*FRAME, fast.alias("x"))


QUANTILES = (0.5, 0.7, 0.85, 0.95)


def thermometer_fit(long: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """d, q, threshold: exact quantiles of each column, as float32 values. A row for each column and quantile."""
    cuts = exact_quantiles(long, quantiles, ("d",), "v")
    return cuts.select("d", "q", F.col("v").cast("float").cast("double").alias("threshold"))


def thermometer_bits(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """track, frame, d, q, bit: v >= threshold. The thresholds are a row for each column and quantile, so they are broadcast."""
    return long.join(small(thresholds), "d").select(*FRAME, "d", "q", (F.col("v") >= F.col("threshold")).cast("int").alias("bit"))


def varying_literals(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """literal, d, q, threshold of the literals that are neither always nor never set; numbered in (d, q) order.

    A bit varies if its threshold lies above the column's least value and not above its greatest.
    """
    ends = long.groupBy("d").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    kept = thresholds.join(small(ends), "d").where("threshold > least and threshold <= most")
    # one row for each literal: small, so a single window is fine
    return kept.select((F.row_number().over(W.orderBy("d", "q")) - 1).alias("literal"), "d", "q", "threshold")


def encode_wide(wide: DataFrame, literals: DataFrame) -> DataFrame:
    """track, frame, literal of the set literals: each vector is held against all thresholds at once, as one broadcast array."""
    all_ = literals.agg(F.array_sort(F.collect_list(F.struct("literal", "d", "threshold"))).alias("all"))  # one row
    met = F.transform(F.filter("all", lambda c: F.get(F.col("x"), c["d"]) >= c["threshold"]), lambda c: c["literal"])
    return wide.crossJoin(F.broadcast(all_)).select(*FRAME, F.explode(met).alias("literal"))


def encode(bits: DataFrame, literals: DataFrame) -> DataFrame:
    """track, frame, literal of the set literals."""
    return bits.where("bit = 1").join(small(literals), ["d", "q"]).select(*FRAME, "literal")


def with_negations(set_bits: DataFrame, frames: DataFrame, count: int) -> DataFrame:
    """Literal f where the bit is set and f + count where it is not."""
    grid = frames.select(*FRAME, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("literal"))
    on = set_bits.withColumn("on", F.lit(1))
    return grid.join(on, [*FRAME, "literal"], "left").select(*FRAME, (F.col("literal") + F.when(F.col("on").isNull(), count).otherwise(0)).alias("literal"))


def pack(set_bits: DataFrame) -> DataFrame:
    """track, frame, word, bits: 64 literals in a bigint, lowest first."""
    word = F.floor(F.col("literal") / 64).cast("int")
    one = F.expr("shiftleft(1L, cast(literal % 64 as int))")
    return set_bits.groupBy(*FRAME, word.alias("word")).agg(F.bit_or(one).alias("bits"))


def unpack(words: DataFrame) -> DataFrame:
    each = words.select(*FRAME, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return each.where("getbit(bits, b) = 1").select(*FRAME, (F.col("word") * 64 + F.col("b")).alias("literal"))


def literal_audit(words: DataFrame) -> DataFrame:
    """Per frame the number of set literals, as a histogram with its quantiles."""
    n = words.groupBy(*FRAME).agg(F.sum(F.bit_count("bits")).alias("n"))
    return n.agg(F.count("*").alias("frames"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"))


def ulp_equal(a: Column, b: Column, ulps: Column) -> Column:
    """Whether two floats are within some units in the last place."""

    @F.arrow_udf(T.BooleanType())
    def near(x, y, n):
        import pyarrow as pa

        def ordered(v):
            i = np.asarray(v, np.float32).view(np.int32).astype(np.int64)
            return np.where(i < 0, -(2**31) - i, i)

        return pa.array(np.abs(ordered(x) - ordered(y)) <= np.asarray(n))

    return near(a, b, ulps)


def tuning_mask(long: DataFrame) -> DataFrame:
    """How far a pitch stands out of its neighbours: clip((f / max(neighbours) - 1.02) / 0.18)."""
    by = W.partitionBy(*FRAME).orderBy("d")
    side = F.greatest(F.coalesce(F.lag("v").over(by), F.lit(0.0)), F.coalesce(F.lead("v").over(by), F.lit(0.0)), F.lit(1e-9))
    mask = F.greatest(F.least((F.col("v") / side - 1.02) / 0.18, F.lit(1.0)), F.lit(0.0))
    return long.select(*FRAME, "d", mask.alias("mask"))


def owners(pitches: DataFrame, harmonics: int = 11, tolerance: float = 18.0) -> DataFrame:
    """pitch, owner, h: pairs whose frequency ratio is within `tolerance` cents of harmonic h (2..harmonics).

    A theta join written as an equi-join: for each (owner, h) the nearest pitches are
    computed, then tested; the pitch table stays a dimension of some dozens of rows.
    """
    steps = F.explode(F.sequence(F.lit(2), F.lit(harmonics))).alias("h")
    guess = pitches.select(F.col("pitch").alias("owner"), steps)
    exact = F.col("owner") + 12 * F.log2(F.col("h").cast("double"))
    near = guess.withColumn("exact", exact).withColumn("pitch", F.explode(F.sequence(F.floor("exact").cast("int"), F.ceil("exact").cast("int"))))
    return near.where(F.abs(F.col("pitch") - F.col("exact")) * 100 <= tolerance).join(pitches, "pitch", "left_semi").select("pitch", "owner", "h").distinct()


def owner_residual(cells: DataFrame, links: DataFrame, decay: float = 1.0, slack: float = 1.05) -> DataFrame:
    """Amplitude of each pitch less what its owners' harmonics explain; links are a small dimension."""
    owned = cells.select("track", "frame", F.col("pitch").alias("owner"), F.col("amp").alias("owner_amp"))
    pull = links.join(owned, "owner").select("track", "frame", "pitch", (F.col("owner_amp") / F.pow(F.col("h").cast("double"), F.lit(decay)) * slack).alias("part"))
    summed = pull.groupBy("track", "frame", "pitch").agg(F.sum("part").alias("explained"))
    rest = F.greatest(F.col("amp") - F.coalesce("explained", F.lit(0.0)), F.lit(0.0))
    return cells.join(summed, ["track", "frame", "pitch"], "left").select("track", "frame", "pitch", rest.alias("residual"))


def gain(samples: DataFrame, target: float = 0.5, limit_db: float = 24.0) -> DataFrame:
    """Per track the factor that brings the 99th percentile of |x| to `target`, within +-limit_db."""
    top = 10 ** (limit_db / 20)
    factor = F.greatest(F.least(F.lit(target) / F.greatest(F.col("peak"), F.lit(1e-12)), F.lit(top)), F.lit(1 / top))
    return quantile_columns(samples, ("track",), F.abs("v"), peak=0.99).select("track", F.round(factor, 6).alias("gain"))
