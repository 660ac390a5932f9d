"""Stratified sampling, threshold calibration, model selection."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from framelark.operators.quantiles import quantiles
from framelark.operators.running import in_order, row_numbers, running_sums
from framelark.operators.sized import small
from framelark.written import written


def order_hash(*parts: Column) -> Column:
    """A hash that sorts rows in a fixed random order."""
    return F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)))


@F.arrow_udf(T.LongType())
def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else int.from_bytes(hashlib.blake2s(t.encode(), digest_size=4).digest(), "little") for t in texts.to_pylist()], pa.int64())


def stable_seed(text: Column, seed: int) -> Column:
    """A 32-bit seed for a text: its blake2s digest of four bytes, exclusive-or `seed`."""
    return _digest(text).bitwiseXOR(F.lit(seed))


def stratified(corpus: DataFrame, limit: int, seed: str = "s") -> DataFrame:
    """`limit` rows, dealt in turn over sources, within a source over groups, within a group in hash order.

    Rows that cannot be dealt early enough are dropped before anything is ordered
    as a whole: a row's turn in its source is at most `limit`.
    """
    in_group = W.partitionBy("source", "grp").orderBy(order_hash(F.lit(seed), F.col("source"), F.col("id")), "id")
    turn = corpus.withColumn("turn", F.row_number().over(in_group)).where(F.col("turn") <= limit)
    in_source = W.partitionBy("source").orderBy("turn", order_hash(F.lit(seed), F.col("source"), F.col("grp")), "grp")
    dealt = turn.withColumn("place", F.row_number().over(in_source)).where(F.col("place") <= limit)
    return dealt.orderBy("place", "source").limit(limit).select("source", "grp", "id", "place")


QUOTAS = {"chord_onset": 0.30, "single_onset": 0.20, "poly_sustain": 0.30, "single_sustain": 0.15, "silence": 0.05}


def frame_category(onsets: Column, active: Column) -> Column:
    return (
        F.when(onsets >= 2, "chord_onset").when(onsets == 1, "single_onset").when(active >= 2, "poly_sustain").when(active == 1, "single_sustain").otherwise("silence")
    )


def category_quotas(counts: DataFrame, total: int, quotas: dict[str, float] = QUOTAS) -> DataFrame:
    """category, available, wanted: each present category its share; the last one present takes what is left."""
    order = {c: i for i, c in enumerate(quotas)}
    rank = F.create_map(*(F.lit(x) for c, i in order.items() for x in (c, i)))
    share = F.create_map(*(F.lit(x) for c, s in quotas.items() for x in (c, s)))
    rows = counts.withColumn("rank", F.element_at(rank, F.col("category"))).withColumn("part", F.rint(F.element_at(share, F.col("category")) * total).cast("int"))
    by = W.orderBy("rank")  # one row for each category
    before = F.coalesce(F.sum("part").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("rank").over(by).isNull()
    left = F.greatest(F.lit(total) - before, F.lit(0))
    return rows.withColumn("wanted", F.when(last, left).otherwise(F.least("part", left)).cast("int")).select("category", "available", "wanted")


def balanced_sample(frames: DataFrame, total: int, seed: str = "b") -> DataFrame:
    """Frames (track, frame, category) by quota, in hash order; a short category is repeated to its quota."""
    counts = frames.groupBy("category").agg(F.count("*").alias("available"))
    quota = category_quotas(counts, total)
    ranked = frames.join(small(quota), "category")  # five rows
    by = W.partitionBy("category").orderBy(order_hash(F.lit(seed), F.col("track"), F.col("frame")), "track", "frame")
    # no category takes more than `total`: so tasks hand on no more than that of each
    place = ranked.withColumn("place", F.row_number().over(by)).where((F.col("place") <= total) & (F.col("place") <= F.col("wanted")))
    copies = F.floor((F.col("wanted") - F.col("place")) / F.col("available")) + 1
    return place.select("category", "track", "frame", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))


def evenly(frames: DataFrame, count: int) -> DataFrame:
    """`count` frames of each track, evenly spaced from first to last (positions cut to whole numbers)."""
    by = W.partitionBy("track")
    placed = frames.withColumn("i", F.row_number().over(by.orderBy("frame")) - 1).withColumn("n", F.count("*").over(by))
    picks = placed.select("track", "n").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"), "n")
    at = picks.select("track", "k", F.floor(F.col("k") * (F.col("n") - 1) / F.lit(max(count - 1, 1))).cast("int").alias("i"))
    return at.join(placed.select("track", "i", "frame"), ["track", "i"]).select("track", "k", "frame")


def threshold_curve(scores: DataFrame, *by: str) -> DataFrame:
    """by.., score, predicted, tp, target at every distinct score, counting score >= threshold.

    Equal scores are summed first, so the ordered window sees a row for each distinct score.
    """
    grouped = scores.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("truth").alias("t"))
    down = W.partitionBy(*by).orderBy(F.col("score").desc())
    whole = W.partitionBy(*by)
    return grouped.select(*by, "score", F.sum("n").over(down).alias("predicted"), F.sum("t").over(down).alias("tp"), F.sum("t").over(whole).alias("target"), F.max("score").over(whole).alias("top"))


def f1() -> Column:
    return 2.0 * F.col("tp") / F.greatest(F.col("predicted") + F.col("target"), F.lit(1))


def calibrate(scores: DataFrame, cap: float | Column, *by: str, floor: float | None = None, fall_back: bool = False) -> DataFrame:
    """Best F1 threshold with predicted <= cap * target (and >= floor * target if given); the higher one on ties.

    Without an allowed threshold the best of all counts if `fall_back`. If none scores above 0
    the result predicts nothing: top score + 1.
    """
    curve = threshold_curve(scores, *by).withColumn("f1", f1())
    allowed = F.col("predicted") <= cap * F.col("target")
    if floor is not None:
        allowed = allowed & (F.col("predicted") >= floor * F.col("target"))
    point = F.when(F.col("f1") > 0, F.struct("f1", "score", "tp", "predicted"))
    best = F.max(F.when(allowed, point))
    if fall_back:
        best = F.coalesce(best, F.when(F.count_if(allowed) == 0, F.max(point)))
    got = curve.groupBy(*by).agg(best.alias("b"), F.max("top").alias("top"), F.max("target").alias("target"))
    return got.select(
        *by,
        F.coalesce("b.score", F.col("top") + 1).alias("threshold"),
        F.coalesce("b.tp", F.lit(0)).alias("tp"),
        (F.coalesce("b.predicted", F.lit(0)) - F.coalesce("b.tp", F.lit(0))).alias("fp"),
        (F.col("target") - F.coalesce("b.tp", F.lit(0))).alias("fn"),
        F.round(F.coalesce("b.f1", F.lit(0.0)), 6).alias("f1"),
    )


def calibrate_on_grid(scores: DataFrame, points: int, low: float, high: float) -> DataFrame:
    """Per member the best F1 over a grid of score quantiles and 0, within low..high of the target count.

    Without an allowed point, the one whose count is nearest to the target.
    """
    qs = [i / (points - 1) for i in range(points)]
    found = quantiles(scores, tuple(qs), ("member",), "score").select("member", F.col("v").alias("threshold"))
    grid = found.unionByName(scores.select("member", F.lit(0.0).alias("threshold")).distinct()).distinct()  # some hundred rows
    curve = threshold_curve(scores, "member")
    at = small(grid).join(curve, "member").where("score >= threshold")
    # counts at a threshold are those of the lowest score at or above it
    points_ = at.groupBy("member", "threshold").agg(F.max("predicted").alias("predicted"), F.max("tp").alias("tp"), F.max("target").alias("target")).withColumn("f1", f1())
    allowed = F.col("predicted").between(low * F.col("target"), high * F.col("target"))
    best = F.max(F.when(allowed, F.struct("f1", "threshold")))
    near = F.max(F.struct((-F.abs(F.col("predicted") - F.col("target"))).alias("d"), "threshold", "f1"))
    got = points_.groupBy("member").agg(best.alias("b"), near.alias("n"))
    return got.select("member", F.round(F.coalesce("b.threshold", "n.threshold"), 6).alias("threshold"), F.round(F.coalesce("b.f1", "n.f1"), 6).alias("f1"))


def tolerant_cuts(truth: DataFrame, predicted: DataFrame, radius: int, points: list[float]) -> DataFrame:
    """cut, predicted, tp, fp, fn, f1 of events (track, pitch, frame; predicted ones with amp) at each quantile of amp, and at 0.

    Whether a prediction has a target near does not depend on the cut, and a target is missed above the largest amp near it. So both are
    found once, summed between cuts, and added up from the highest cut down.
    """
    amp = F.when(F.col("t") == 0, F.col("amp"))
    both = truth.select("track", "pitch", "frame", F.lit(1).alias("t"), F.lit(None).cast("double").alias("amp")).unionByName(predicted.select("track", "pitch", "frame", F.lit(0).alias("t"), "amp"))
    near = W.partitionBy("track", "pitch").orderBy("frame").rangeBetween(-radius, radius)
    seen = both.select("t", "amp", (F.max("t").over(near) == 1).alias("hit"), F.max(amp).over(near).alias("best"))
    counts = seen.groupBy("t", F.when(F.col("t") == 0, F.col("amp")).otherwise(F.col("best")).alias("amp")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    counts = written(counts)  # a row for each distinct value
    grid = quantiles(counts.where("t = 0").withColumn("all", F.lit(0)), tuple(points), ("all",), "amp", F.col("n")).select(F.col("v").alias("cut"))
    cuts = small(grid.unionByName(grid.sparkSession.range(1).select(F.lit(0.0).alias("cut"))).distinct())
    steps = counts.where("amp is not null").select("amp", F.when(F.col("t") == 0, F.col("n")).otherwise(0).alias("p"), F.when(F.col("t") == 0, F.col("hits")).otherwise(0).alias("tp"), F.when(F.col("t") == 1, F.col("n")).otherwise(0).alias("met"), F.lit(None).cast("double").alias("cut"))
    marks = cuts.select(F.col("cut").alias("amp"), F.lit(0).alias("p"), F.lit(0).alias("tp"), F.lit(0).alias("met"), "cut")
    whole = counts.agg(F.coalesce(F.sum(F.when(F.col("t") == 1, F.col("n"))), F.lit(0)).alias("target"))
    moved = steps.unionByName(marks).select("amp", "cut", *(F.col(c).alias(f"_{c}") for c in ("p", "tp", "met")))
    at = running_sums(moved, [F.col("amp").desc()], p=F.col("_p"), tp=F.col("_tp"), met=F.col("_met")).where("cut is not null").select("cut", "p", "tp", "met")
    rows = at.join(whole, F.lit(True))  # one row
    rows = rows.select("cut", F.col("p").alias("predicted"), "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("target") - F.col("met")).alias("fn"), "target")
    return rows.withColumn("f1", 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)))


def calibrate_tolerant(truth: DataFrame, predicted: DataFrame, radius: int, low: float, high: float, points: int = 160) -> DataFrame:
    """The cut with the best tolerant F1 among those with low..high times as many events as the targets (else among all); the higher on ties."""
    cuts = tolerant_cuts(truth, predicted, radius, [0.01 + (0.999 - 0.01) * i / (points - 1) for i in range(points)])
    allowed = F.col("predicted").between(low * F.col("target"), high * F.col("target"))
    row = F.struct("f1", "cut", "predicted", "tp", "fp", "fn")
    got = cuts.agg(F.coalesce(F.max(F.when(allowed, row)), F.max(row)).alias("b"))
    return got.select(F.round("b.cut", 6).alias("cut"), "b.predicted", "b.tp", "b.fp", "b.fn", F.round("b.f1", 6).alias("f1"))


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """Per run the epoch with the best (f1, precision, recall, threshold), the earliest on ties."""
    by = W.partitionBy("run").orderBy(*(F.col(c).desc() for c in ("f1", "precision", "recall", "threshold")), "epoch")
    return epochs.withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """Per run the first epoch at which `patience` epochs have passed without a strict improvement (or the last)."""
    by = W.partitionBy("run").orderBy("epoch")
    before = F.max("f1").over(by.rowsBetween(W.unboundedPreceding, -1))
    better = F.col("f1") > F.coalesce(before, F.lit(-1.0))
    since = epochs.withColumn("best_epoch", F.last(F.when(better, F.col("epoch")), ignorenulls=True).over(by))
    stop = F.coalesce(F.min(F.when(F.col("epoch") - F.col("best_epoch") >= patience, F.col("epoch"))), F.max("epoch"))
    return since.groupBy("run").agg(stop.alias("stop_epoch"), F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("best_epoch"))


ONSET_SHARES = (0.55, 0.35, 0.10)


def _number(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(order_hash(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def onset_draws(counts: list[int], rows: int) -> list[int]:
    """How many rows are drawn of each stratum, and last of all rows: an empty one's share goes to those after it, and from the silent ones' to all."""
    left, out = rows, []
    for k, (n, share) in enumerate(zip(counts, ONSET_SHARES, strict=True)):
        take = 0 if not n else left if k == len(ONSET_SHARES) - 1 else min(round(rows * share), left)
        out.append(take)
        left -= take
    return [*out, left if sum(counts) else 0]


def halved(sorted_array: Column, value: Column) -> Column:
    """How many entries of the sorted array are at most `value`, by halving."""

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        go, right = at["lo"] < at["hi"], F.get(sorted_array, middle) <= value
        return F.struct(F.when(go & right, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(go & ~right, middle).otherwise(at["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_array) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(sorted_array).alias("hi")), step, lambda at: at["lo"])


def onset_sample(frames: DataFrame, rows: int, seed: str = "o") -> DataFrame:
    """place, track, frame, stratum: `rows` frames for training onsets, drawn with replacement and shuffled.

    frames: track, frame, activity and onsets (numbers of pitches). 55 % have an onset, 35 % activity only and 10 % neither (stratum 0, 1, 2; 3: drawn of all).
    A draw is a rank in its stratum. Frames are dealt by ranges; from the counts of ranges and strata a rank's range and its place in that are
    known, so a stratum is ordered in no task and a frame is met by its place. Draws are made by counters, and no draw depends on another.
    """
    spark = frames.sparkSession
    stratum = F.when(F.col("onsets") > 0, 0).when(F.col("activity") > 0, 1).otherwise(2)
    dealt = in_order(frames.select("track", "frame", stratum.alias("stratum")), F.col("track"), F.col("frame"))
    both = dealt.select("_part", "track", "frame", F.explode(F.array("stratum", F.lit(3))).alias("stratum"))
    counted = both.groupBy("stratum", "_part").agg(F.count("*").alias("n"))
    listed = counted.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("_part", "n"))).alias("p"))  # four rows, an entry for each range
    sums = F.aggregate("p", F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["n"]))
    offsets = listed.select("stratum", F.transform("p", lambda x: x["_part"]).alias("parts"), sums.alias("ends")).toArrow()
    total = {r["stratum"]: r["ends"][-1] for r in offsets.to_pylist()}
    wanted = onset_draws([total.get(k, 0) for k in range(3)], rows)
    draws = spark.range(sum(wanted)).select(F.col("id").alias("draw"))
    ends = [sum(wanted[: k + 1]) for k in range(4)]
    of = F.when(F.col("draw") < ends[0], 0).when(F.col("draw") < ends[1], 1).when(F.col("draw") < ends[2], 2).otherwise(3)
    table = F.broadcast(spark.createDataFrame(offsets, "stratum int, parts array<int>, ends array<long>"))
    ranked = draws.select("draw", of.alias("stratum")).join(table, "stratum")
    ranked = ranked.withColumn("rank", F.floor(_number(F.lit(seed), F.col("draw")) * F.element_at("ends", -1)))
    at = halved(F.col("ends"), F.col("rank"))  # ends begin with 0
    placed = ranked.select("draw", "stratum", F.element_at("parts", at).alias("_part"), (F.col("rank") - F.get(F.col("ends"), at - 1)).alias("i"))
    numbered = both.withColumn("i", F.row_number().over(W.partitionBy("_part", "stratum").orderBy("track", "frame")).cast("long") - 1)
    # frames as written are so compact that Spark would take their table for small and send all its rows through the driver
    drawn = placed.join(numbered.hint("merge"), ["_part", "stratum", "i"]).select("draw", "track", "frame", "stratum")
    return row_numbers(drawn, [order_hash(F.lit(seed), F.lit("place"), F.col("draw")), F.col("draw")], "place").select("place", "track", "frame", "stratum")
