"""Exact order statistics and quantiles of columns, with no task that holds a column.

A rank is searched for by narrowing its range: values within the range are counted in BUCKETS buckets (with partial
sums in each task), and the bucket that holds the rank, cut to its least and greatest value, is the next range. Each round's table has
a row for each column, rank and bucket; it ends when least and greatest are equal. All columns and ranks share
the rounds. Distinct values in a range fall by the number of buckets a round where values are spread evenly; a round always
takes something off, as least and greatest are in different buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.operators.sized import small
from framelark.written import written

BUCKETS = 1024


#: with so many rows at most, a group is small enough for one task
SMALL = 1 << 20


def order_statistics(values: DataFrame, ranks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, rank, v) for the ranks (from 0, below the count) wanted of each group of `values` (*by, v, n), n being how often v occurs."""
    spark, x = values.sparkSession, values
    ends = x.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = ranks.join(small(ends), list(by)).select(*by, "rank", F.col("rank").cast("long").alias("left"), "lo", "hi")
    schema, done = open_.schema, []
    rows = open_.toArrow()  # a row for each group and rank
    while True:
        table = spark.createDataFrame(rows, schema)
        done.append(table.where("lo = hi").select(*by, "rank", F.col("lo").alias("v")))
        going = table.where("lo < hi")
        if not going.limit(1).count():
            break
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        ranges = going.select(*by, "lo", "hi").distinct()
        inside = x.join(small(ranges), list(by)).where("v between lo and hi").groupBy(*by, "lo", "hi", part.alias("bucket"))
        counted = inside.agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        buckets = counted.groupBy(*by, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "least", "most"))).alias("b"))  # BUCKETS at most

        def step(acc: Column, b: Column) -> Column:
            here = acc["found"].isNull() & (acc["left"] < b["n"])
            return F.struct(
                F.when(acc["found"].isNull() & ~here, acc["left"] - b["n"]).otherwise(acc["left"]).alias("left"),
                F.when(here, F.struct(b["least"].alias("lo"), b["most"].alias("hi"))).otherwise(acc["found"]).alias("found"),
            )

        zero = F.struct(F.col("left").alias("left"), F.lit(None).cast("struct<lo:double,hi:double>").alias("found"))
        narrowed = going.join(buckets, [*by, "lo", "hi"]).select(*by, "rank", F.aggregate("b", zero, step).alias("r"))
        rows = narrowed.select(*by, "rank", F.col("r.left").alias("left"), F.col("r.found.lo").alias("lo"), F.col("r.found.hi").alias("hi")).toArrow()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def quantiles(values: DataFrame, points: tuple[float, ...], by: tuple[str, ...] = ("d",), value: str | Column = "v", times: Column | None = None, small_rows: int = SMALL) -> DataFrame:
    """(*by, q, v): quantile points[q] of each group, between the two values next to it as `percentile` has it; `times`: how often a row counts.

    Nulls are no values; a group without values has no row. Few rows are left to `percentile`, which gives the same.
    """
    held = value if isinstance(value, Column) else F.col(value)
    x = values.select(*by, held.cast("double").alias("v"), (F.lit(1) if times is None else times).cast("long").alias("n")).where("v is not null and n > 0")
    if x.limit(small_rows + 1).count() <= small_rows:
        got = x.groupBy(*by).agg(F.percentile("v", [*points], F.col("n")).alias("t"))
        return got.where("t is not null").select(*by, F.posexplode("t").alias("q", "v"))
    x = written(x)  # read once a round
    n = x.groupBy(*by).agg(F.sum("n").alias("n"))
    at = n.select(*by, F.posexplode(F.array(*(F.lit(float(p)) for p in points))).alias("q", "p"), "n").withColumn("at", F.col("p") * (F.col("n") - 1))
    wanted = at.select(*by, "q", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"))
    found = order_statistics(x, wanted.select(*by, F.explode(F.array("low", "high")).alias("rank")).distinct(), by)
    both = wanted.join(found.withColumnRenamed("rank", "low").withColumnRenamed("v", "a"), [*by, "low"]).join(found.withColumnRenamed("rank", "high").withColumnRenamed("v", "b"), [*by, "high"])
    over = F.col("at") - F.col("low")
    return both.select(*by, "q", F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + over * F.col("b")).alias("v"))


def quantile_columns(values: DataFrame, by: tuple[str, ...], value: str | Column, small_rows: int = SMALL, **points: float) -> DataFrame:
    """by.., and a column for each named quantile."""
    names = list(points)
    got = quantiles(values, tuple(points.values()), by, value, small_rows=small_rows)
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("q") == k, F.col("v"))).alias(name) for k, name in enumerate(names)))
