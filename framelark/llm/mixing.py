"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's repetition rate is its target share of the mixture, times the size of
the mixture, over the source's size (both in characters). Each document draws a
uniform number from a hash of its id and a seed, and the Poisson distribution
with the rate as mean is inverted at it by a binary search in the source's table of
its distribution: that many copies of the document go
into the mixture. So the expected number of copies is exactly the rate, a rate
below 1 drops documents, and the same input always gives the same mixture.
The copies are then shuffled over the whole data by a second hash.

Weights default to the sources' sizes to the power `temperature`, which evens
out large and small sources; `weights` (source -> number) sets them outright,
and sources that it leaves out get weight 0.

Scale: sizes come from a grouped sum with map-side partial sums, so a source
holding most rows costs no more than another. The table of rates has a row for
each source; it is broadcast only if it is counted small, and otherwise joined
by shuffle. Nothing is grouped by source afterwards.

Edge cases: a null source is a source of its own. Null and empty texts have size
0; a source of size 0 gets rate 0, so it is left out. A document with a null id
is drawn by the hash of an empty id. Repeated rows draw alike and are replicated
alike. Copies are numbered from 0. An empty table gives an empty mixture. The columns of the
documents keep their names and values; added ones (rate, copy, order_key), where such a name is taken,
get underscores at their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelark.llm.common import fresh, small

TEMPERATURE = 0.7
SEED = "mix-1"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """`rates` (source, rate) with `cdf`: values of the distribution function at 0, 1, 2, ... up to where the tail is below 2**-53."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    each = rates.select("source", "rate", F.explode(F.when(F.col("rate") > 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))).alias("k"))
    so_far = Window.partitionBy("source", "rate").orderBy("k")
    log_p = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log(F.col("rate") / F.col("k")))).over(so_far)
    values = each.withColumn("p", F.exp(log_p)).withColumn("c", F.sum("p").over(so_far))
    return values.groupBy("source", "rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def below(cdf: Column, u: Column) -> Column:
    """How many values of the sorted array are at most u, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cdf) + F.lit(1))).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        left, right = at["lo"] >= at["hi"], F.get(cdf, middle) <= u
        lo = F.when(~left & right, middle + 1).otherwise(at["lo"])
        hi = F.when(~left & ~right, middle).otherwise(at["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi")), halve, lambda at: at["lo"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row for each source: its rate and the rate's distribution."""
    mass = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        weight = F.when(F.col("mass") > 0, F.pow("mass", F.lit(float(temperature)))).otherwise(0.0)
    else:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    weighted = mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(0.0))
    sums = weighted.agg(F.sum("mass").alias("m"), F.sum("weight").alias("w")).first()  # one row
    total, norm = sums.m or 0.0, sums.w or 0.0
    share = F.col("weight") / F.lit(norm) if norm > 0 else F.lit(0.0)
    rate = F.when(F.col("mass") > 0, F.col("share") * F.lit(size * total) / F.col("mass")).otherwise(0.0)
    return poisson_tables(weighted.withColumn("share", share).select("source", rate.alias("rate")))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Each document as often as its draw says, with columns `rate`, `copy` and `order_key`, shuffled globally."""
    # the caller's columns travel as one struct, so no name of theirs meets one used here
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("own"), F.col(source).alias("of"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"))
    drawn = own.join(small(rates), F.col("of").eqNullSafe(F.col("source")))
    copies = below(F.col("cdf"), uniform(seed, F.col("id")))
    each = drawn.select("own", "id", "rate", copies.alias("n")).where("n > 0").select("own", "id", "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("id"), F.col("copy").cast("string")))
    out = each.select("own", "rate", "copy", place.alias("place")).repartition("place").sortWithinPartitions("place")
    return out.select("own.*", *(F.col(c).alias(fresh(docs, name)) for c, name in (("rate", "rate"), ("copy", "copy"), ("place", "order_key"))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **kw) -> DataFrame:
    seed = kw.pop("seed", SEED)
    return replicate(docs, source_rates(docs, weights, **kw), seed=seed, source=kw.get("source", "source"))


ORACLE = """
WITH mass AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS mass FROM documents GROUP BY source),
weighted AS (SELECT source, mass, CASE WHEN mass > 0 THEN pow(mass, 0.7) ELSE 0 END AS weight FROM mass),
rates AS (
  SELECT source, CASE WHEN mass > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(mass) FROM weighted) / mass ELSE 0 END AS rate
  FROM weighted
),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM rates WHERE rate > 0),
cdf AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM ks),
draws AS (
  SELECT doc_id, text, source, lang, n_chars, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents
),
counts AS (
  SELECT d.*, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.c <= d.u) AS copies
  FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY ALL
),
exploded AS (SELECT *, unnest(range(0, copies)) AS copy FROM counts)
SELECT doc_id, text, source, lang, n_chars, round(rate, 6) AS rate, copy::INTEGER AS copy,
       md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS order_key
FROM exploded
"""
