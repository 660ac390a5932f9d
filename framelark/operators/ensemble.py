"""Clause models and ensembles: relational inference, normalisation, fusion, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framelark.operators.selection import calibrate
from framelark.operators.quantiles import quantile_columns
from framelark.operators.sized import small

INT_MAX = 2**31 - 1


def firing(set_literals: DataFrame, clauses: DataFrame) -> DataFrame:
    """frame, clause of the clauses all of whose literals are set (an empty clause never fires).

    Relational division: the clause table is a model dimension; literals are joined
    on equality and counted.
    """
    sizes = clauses.groupBy("clause").agg(F.count("*").alias("size"))
    hits = set_literals.join(small(clauses), "literal").groupBy("frame", "clause").agg(F.count("*").alias("hits"))
    return hits.join(small(sizes), "clause").where("hits = size").select("frame", "clause")


def class_sums(fired: DataFrame, weights: DataFrame, frames: DataFrame, outputs: int) -> DataFrame:
    """frame, output, score: weights of the firing clauses, saturated to 32 bits; silent frames get 0."""
    total = fired.join(small(weights), "clause").groupBy("frame", "output").agg(F.sum("weight").alias("score"))
    grid = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))).alias("output"))
    return grid.join(total, ["frame", "output"], "left").select("frame", "output", F.greatest(F.least(F.coalesce("score", F.lit(0)), F.lit(INT_MAX)), F.lit(-INT_MAX - 1)).alias("score"))


def robust_scale(scores: DataFrame, *by: str) -> DataFrame:
    """by.., scale: 1.4826 * MAD, else IQR / 1.349, else median |x|, else 1 (each used if at least 1)."""
    mid = quantile_columns(scores, by, "score", low=0.25, m=0.5, high=0.75).join(quantile_columns(scores, by, F.abs("score"), a=0.5), list(by))
    mid = small(mid)  # a row for each group
    mad = quantile_columns(scores.join(mid.select(*by, "m"), list(by)), by, F.abs(F.col("score") - F.col("m")), mad=0.5).withColumn("mad", 1.4826 * F.col("mad"))
    iqr = (F.col("high") - F.col("low")) / 1.349
    scale = F.when(F.col("mad") >= 1, F.col("mad")).when(iqr >= 1, iqr).when(F.col("a") >= 1, F.col("a")).otherwise(1.0)
    return mid.join(mad, list(by)).select(*by, scale.alias("scale"))


def tail_scale(scores: DataFrame, *by: str) -> DataFrame:
    """by.., scale: the 95th percentile of |score|, at least 1."""
    return quantile_columns(scores, by, F.abs("score"), p95=0.95).select(*by, F.greatest("p95", F.lit(1.0)).alias("scale"))


def normalised(score: Column, threshold: Column, scale: Column) -> Column:
    """(score - threshold) / scale in single precision."""
    return ((score.cast("float") - threshold.cast("float")) / scale.cast("float")).cast("float")


def clipped(score: Column, centre: Column, scale: Column, limit: float = 4.0) -> Column:
    return F.greatest(F.least((score - centre) / scale, F.lit(limit)), F.lit(-limit))


def fuse(members: DataFrame, rule: str) -> DataFrame:
    """frame, pitch, fused over members' values `z`: mean (in member order), max, or mean of the top two."""
    if rule == "max":
        return members.groupBy("frame", "pitch").agg(F.max("z").alias("fused"))
    ordered = members.groupBy("frame", "pitch").agg(F.array_sort(F.collect_list(F.struct("member", "z"))).alias("s"))  # one entry for each member
    values = F.transform("s", lambda x: x["z"])
    if rule == "top2_mean":
        values = F.slice(F.sort_array(values, asc=False), 1, 2)
    total = F.aggregate(values, F.lit(0.0).cast("float"), lambda a, b: (a + b).cast("float"))
    return ordered.select("frame", "pitch", (total / F.size(values)).cast("float").alias("fused"))


#: fixed values: the rules that each head may choose from, in order, and its bound on predicted over target cells
RULES = {"activity": ("mean",), "onset": ("mean", "top2_mean", "max")}
CAPS = {"activity": 1.5, "onset": 4.0}


def fused_by_rule(members: DataFrame, heads: DataFrame) -> DataFrame:
    """head, rule, place, frame, pitch, score, truth: every head under each of its rules, from one grouping of the members.

    members: member, frame, pitch, z, truth; heads: member, head (a row for each member).
    """
    known = [r.member for r in heads.select("member").distinct().orderBy("member").collect()]  # a row for each member
    own = [F.max(F.when(F.col("member") == m, F.col("z"))).alias(f"z{k}") for k, m in enumerate(known)]  # sums that every task can begin
    cells = members.join(small(heads), "member").groupBy("head", "frame", "pitch").agg(*own, F.max("truth").alias("truth"))
    values = F.array_compact(F.array(*(F.col(f"z{k}") for k in range(len(known)))))  # in member order
    best = F.slice(F.sort_array(values, asc=False), 1, 2)
    mean = lambda x: (F.aggregate(x, F.lit(0.0).cast("float"), lambda a, b: (a + b).cast("float")) / F.size(x)).cast("float")
    fused = {"mean": mean(values), "top2_mean": mean(best), "max": F.array_max(values)}
    options = None
    for head, rules in RULES.items():
        row = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("place"), quantise(fused[r]).alias("score")) for k, r in enumerate(rules)))
        options = F.when(F.col("head") == head, row) if options is None else options.when(F.col("head") == head, row)
    return cells.select("head", "frame", "pitch", "truth", F.explode(options).alias("o")).select("head", "o.*", "frame", "pitch", "truth")


def fit(members: DataFrame, heads: DataFrame) -> DataFrame:
    """head, rule, threshold, f1: for each head the first of its rules whose calibrated F1 no later one beats."""
    cap = None
    for head, bound in CAPS.items():
        cap = F.when(F.col("head") == head, bound) if cap is None else cap.when(F.col("head") == head, bound)
    found = calibrate(fused_by_rule(members, heads), cap, "head", "rule", "place")
    best = found.groupBy("head").agg(F.max_by(F.struct("rule", "threshold", "f1"), F.struct("f1", -F.col("place"))).alias("b"))  # a few rows
    return best.select("head", "b.*")


def apply_fitted(members: DataFrame, heads: DataFrame, fitted: DataFrame) -> DataFrame:
    """head, frame, pitch, on: each head fused by its fitted rule and cut at its fitted threshold."""
    chosen = fused_by_rule(members, heads).join(small(fitted.select("head", "rule", "threshold")), ["head", "rule"])
    return chosen.select("head", "frame", "pitch", (F.col("score") >= F.col("threshold")).cast("int").alias("on"))


def quantise(fused: Column, steps: int = 1024) -> Column:
    """Nearest whole step, ties to even, within 32 bits less one."""
    return F.greatest(F.least(F.rint(fused.cast("double") * steps), F.lit(float(INT_MAX - 1))), F.lit(float(-INT_MAX - 1))).cast("int")


def diversity(scores: DataFrame) -> DataFrame:
    """member pairs: correlation and share of differing signs. The self-join is on (frame, pitch)."""
    a = scores.select("frame", "pitch", F.col("member").alias("m"), F.col("score").alias("x"))
    b = scores.select("frame", "pitch", F.col("member").alias("n"), F.col("score").alias("y"))
    pairs = a.join(b, ["frame", "pitch"]).where("m < n")
    differ = ((F.col("x") >= 0) != (F.col("y") >= 0)).cast("double")
    return pairs.groupBy("m", "n").agg(F.corr("x", "y").alias("correlation"), F.avg(differ).alias("sign_difference"))


def gain(whole: DataFrame, single: DataFrame) -> DataFrame:
    """over_mean, over_best: the best F1 of `whole` less the mean and the best F1 of `single`, in five decimals.

    F1s have six decimals and are worked with as decimals: sums of doubles differ with the order of the rows, which decides ties of the rounding.
    """
    f1 = F.col("f1").cast("decimal(10, 6)")
    one = single.agg(F.avg(f1).alias("m"), F.max(f1).alias("b"))
    both = whole.agg(F.max(f1).alias("e")).join(one, F.lit(True))  # one row each
    return both.select(*(F.round(F.col("e") - F.col(c), 5).cast("double").alias(name) for c, name in (("m", "over_mean"), ("b", "over_best"))))


def mask_of(x: Column, included) -> Column:
    """64 flags of an array in a bigint, the first in the lowest bit."""
    bits = F.transform(x, lambda v, i: F.when(included(v), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def sparse_literals(masks: DataFrame, features: int) -> DataFrame:
    """clause, feature, negated of the included literals, from masks (clause, own, negated)."""
    each = masks.select("clause", F.posexplode(F.array("own", "negated")).alias("side", "mask")).where("mask <> 0")
    each = each.select("clause", "side", "mask", F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"))
    return each.where("getbit(mask, feature) = 1").select("clause", "feature", (F.col("side") == 1).alias("negated"))


def member_configs(base: DataFrame, members: int, *keep: str) -> DataFrame:
    """Diverse member settings from (s, q, seed) rows: s grows and q shrinks with a pattern over members."""
    p = ((F.col("member") % 3) - 1).cast("double")
    return base.select("*", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member")).select(
        *keep, "member", F.round(F.col("s") * (1 + 0.25 * p), 6).alias("s"), F.round(F.col("q") * (1 - 0.2 * p), 6).alias("q"), (F.col("seed") + 9973 * F.col("member")).alias("seed")
    )


def pick(rules: DataFrame, *order: Column) -> DataFrame:
    """The first row by an order (a few rows)."""
    return rules.withColumn("_k", F.row_number().over(W.orderBy(*order))).where("_k = 1").drop("_k")
