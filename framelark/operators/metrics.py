"""Confusion counts and rates of sparse rolls, tolerant and one-to-one event matching."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

VOICE = ("track", "pitch")


def cells(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """track, pitch, frame, y, p for every cell in which either sounds; silence on both sides has no row."""
    key = [*VOICE, "frame"]
    a = truth.select(*key, F.lit(1).alias("y"))
    b = predicted.select(*key, F.lit(1).alias("p"))
    return a.join(b, key, "full").select(*key, F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("p", F.lit(0)).alias("p"))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    y, p = F.col("y") == 1, F.col("p") == 1
    return rows.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(p).alias("predicted"), F.count_if(y).alias("target")
    )


def interval_confusion(truth: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """`confusion` of two sides' cells, from intervals (track, pitch, start, end) that don't overlap within a side and voice.

    Between the borders of a voice's intervals nothing changes, so frames are counted by lengths and never made.
    """
    border = lambda df, y, p: df.select(*VOICE, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("b")).select(
        *VOICE, "b.at", (F.col("b.d") * y).alias("dy"), (F.col("b.d") * p).alias("dp")
    )
    both = border(truth, 1, 0).unionByName(border(predicted, 0, 1))
    order = W.partitionBy(*VOICE).orderBy("at")
    so_far = order.rangeBetween(W.unboundedPreceding, 0)
    steps = both.select(*VOICE, F.sum("dy").over(so_far).alias("y"), F.sum("dp").over(so_far).alias("p"), (F.lead("at").over(order) - F.col("at")).alias("n")).where("n > 0 and (y > 0 or p > 0)")
    y, p = F.col("y") > 0, F.col("p") > 0
    frames = lambda where: F.coalesce(F.sum(F.when(where, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    named = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "predicted": p, "target": y}
    return steps.groupBy(*by).agg(*(frames(where).alias(name) for name, where in named.items()))


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing, null where a count is null."""
    return F.when(whole.isNotNull(), part / F.greatest(whole, F.lit(1)))


def precision() -> Column:
    return share(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return share(F.col("tp"), F.col("tp") + F.col("fn"))


def f_beta(beta: float = 1.0) -> Column:
    b = beta * beta
    below = b * precision() + recall()
    return F.when(below.isNotNull(), (1 + b) * precision() * recall() / F.greatest(below, F.lit(1e-12)))


def with_rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    return counts.select("*", F.round(precision(), digits).alias("precision"), F.round(recall(), digits).alias("recall"), F.round(f_beta(), digits).alias("f1"))


def tolerant_presence(truth: DataFrame, predicted: DataFrame, radius: int, *by: str, apart: tuple[str, ...] = ()) -> DataFrame:
    """Counts in which a cell is right if the other side has one within `radius` frames (not one to one).

    Sorted events of both sides share one window; nothing is joined by range. Events meet within a voice and equal columns `apart`.
    """
    both = truth.select(*apart, *VOICE, "frame", F.lit(1).alias("t")).unionByName(predicted.select(*apart, *VOICE, "frame", F.lit(0).alias("t")))
    near = W.partitionBy(*apart, *VOICE).orderBy("frame").rangeBetween(-radius, radius)
    seen = both.withColumn("with_t", F.max("t").over(near) == 1).withColumn("with_p", F.min("t").over(near) == 0)
    return seen.groupBy(*by).agg(
        F.count_if((F.col("t") == 0) & F.col("with_t")).alias("tp"),
        F.count_if((F.col("t") == 0) & ~F.col("with_t")).alias("fp"),
        F.count_if((F.col("t") == 1) & ~F.col("with_p")).alias("fn"),
    )


def _pairs(tolerances: list[int]):
    """mapInArrow over onsets sorted by voice and frame; holds the onsets of one voice that can still be matched."""

    def run(batches):
        voice, waiting = None, []
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for track, pitch, frame, ident, t in zip(*(batch[c].to_pylist() for c in ("track", "pitch", "frame", "id", "t")), strict=True):
                if (track, pitch) != voice:
                    voice, waiting = (track, pitch), [(deque(), deque()) for _ in tolerances]
                for tolerance, sides in zip(tolerances, waiting, strict=True):
                    other = sides[1 - t]
                    while other and other[0][0] < frame - tolerance:
                        other.popleft()
                    if not other:
                        sides[t].append((frame, ident))
                        continue
                    at, partner = other.popleft()
                    target, predicted = (ident, partner) if t else (partner, ident)
                    row = (track, pitch, tolerance, target, predicted, at - frame if t else frame - at)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, MATCHES.types, strict=True)], schema=MATCHES)

    return run


MATCHES = pa.schema([("track", pa.int64()), ("pitch", pa.int32()), ("tolerance", pa.int32()), ("target_id", pa.int64()), ("predicted_id", pa.int64()), ("error", pa.int64())])


def match_onsets(target: DataFrame, predicted: DataFrame, tolerances: list[int]) -> DataFrame:
    """One-to-one matches of onsets (track, pitch, frame, id) within each tolerance.

    The earliest possible pairing in frame order, which has as many pairs as any. Onsets are dealt by voice and
    streamed in frame order; what a task holds is what lies within the tolerance of the current frame.
    """
    both = target.select(*VOICE, "frame", "id", F.lit(1).alias("t")).unionByName(predicted.select(*VOICE, "frame", "id", F.lit(0).alias("t")))
    dealt = both.repartition(*VOICE).sortWithinPartitions(*VOICE, "frame", "id")
    return dealt.mapInArrow(_pairs(tolerances), "track long, pitch int, tolerance int, target_id long, predicted_id long, error long")


def polyphony_frames(rows: DataFrame) -> DataFrame:
    """Per frame of a track: target and predicted polyphony and pitches in both."""
    return rows.groupBy("track", "frame").agg(F.sum("y").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("y") * F.col("p")).alias("n_both"))


def polyphony_summary(per_frame: DataFrame, frames: int) -> DataFrame:
    """Chord frames (2 or more true pitches): mean pitch recall and rate of complete frames; mean polyphony, per track."""
    chord = F.col("n_true") >= 2
    mean = lambda value: F.round(F.coalesce(F.avg(F.when(chord, value)), F.lit(0.0)), 6)
    return per_frame.groupBy("track").agg(
        F.count_if(chord).alias("chord_frames"),
        mean(F.col("n_both") / F.col("n_true")).alias("chord_pitch_recall"),
        mean((F.col("n_both") == F.col("n_true")).cast("double")).alias("chord_complete_rate"),
        F.round(F.sum("n_true") / frames, 6).alias("target_polyphony"),
        F.round(F.sum("n_pred") / frames, 6).alias("predicted_polyphony"),
    )


RADII = (2, 4, 8)


def polyphonic_metrics(activity: DataFrame, onsets: DataFrame, truth_onsets: DataFrame, predicted_onsets: DataFrame, frames: int) -> DataFrame:
    """Per track: exact activity and onset rates, onset rates within each of RADII, and the chord figures.

    activity and onsets: cells (track, pitch, frame, y, p) of both heads; the last two are the rolls of onsets.
    """

    def named(counts: DataFrame, name: str) -> DataFrame:
        return with_rates(counts).select("track", *(F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")))

    out = polyphony_summary(polyphony_frames(activity), frames).join(named(confusion(activity, "track"), "activity"), "track", "left").join(named(confusion(onsets, "track"), "onset"), "track", "left")
    for radius in RADII:
        out = out.join(named(tolerant_presence(truth_onsets, predicted_onsets, radius, "track"), f"onset_within_{radius}"), "track", "left")
    return out


SUBSETS = ("all", "low", "retrigger", "active_previous", "chord", "single")


def event_metrics(targets: DataFrame, predicted: DataFrame, matches: DataFrame, low_max: int, tolerances: list[int]) -> DataFrame:
    """A row for each of SUBSETS and each tolerance: targets, tp (those matched), recall and the matches' mean error; predicted, fp, precision and f1 for all and low events.

    targets: event_id, pitch, retrigger, active_previous, chord. predicted: event_id, pitch. matches: those of `match_onsets`.
    Events match within a pitch only, so low targets against low predictions are the matches at low pitches. The other subsets are of the
    targets: a prediction has no such flag, so what depends on predictions is null. Subsets without events or matches have their rows.
    """
    spark = targets.sparkSession
    low = F.when(F.col("pitch") <= low_max, "low")
    flags = [F.when(F.col(c), c) for c in ("retrigger", "active_previous")]
    of_targets = F.array_compact(F.array(F.lit("all"), low, *flags, F.when(F.col("chord"), "chord").otherwise("single")))
    wanted = targets.select("event_id", F.explode(of_targets).alias("subset"))
    n_wanted = wanted.groupBy("subset").agg(F.count("*").alias("targets"))
    n_given = predicted.select(F.explode(F.array_compact(F.array(F.lit("all"), low))).alias("subset")).groupBy("subset").agg(F.count("*").alias("predicted"))
    found = wanted.join(matches.select(F.col("target_id").alias("event_id"), "tolerance", "error"), "event_id")
    hits = found.groupBy("subset", "tolerance").agg(F.count("*").alias("tp"), F.round(F.avg(F.abs("error")), 6).alias("mean_abs_error"))
    grid = spark.createDataFrame([(s, t) for s in SUBSETS for t in tolerances], "subset string, tolerance int")
    none = F.lit(0).cast("long")
    rows = grid.join(hits, ["subset", "tolerance"], "left").join(n_wanted, "subset", "left").join(n_given, "subset", "left")
    predicted_ = F.when(F.col("subset").isin("all", "low"), F.coalesce("predicted", none))
    rows = rows.withColumns({"tp": F.coalesce("tp", none), "targets": F.coalesce("targets", none), "predicted": predicted_})
    return with_rates(rows.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("targets") - F.col("tp")))


def by_polyphony(rows: DataFrame, low_max: int) -> DataFrame:
    """Confusion by overlapping buckets: the frame's true polyphony (4+ in one), single, polyphonic, all, low pitches."""
    n = F.sum("y").over(W.partitionBy("track", "frame"))
    level = F.when(F.col("n") >= 4, "4+").otherwise(F.col("n").cast("string"))
    labels = F.array_compact(
        F.array(F.lit("all"), level, F.when(F.col("n") == 1, "single"), F.when(F.col("n") >= 2, "polyphonic"), F.when(F.col("pitch") <= low_max, "low"))
    )
    tagged = rows.withColumn("n", n).select("y", "p", F.explode(labels).alias("bucket"))
    return confusion(tagged, "bucket")
