"""Running sums and row numbers over a whole table, with no task that sees it whole.

Rows are dealt by ranges of their order and written; each range sums by itself, the sums of the ranges (a row
for each) are added up, and each range adds what came before it. Equal rows of the order are in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framelark.operators.sized import small
from framelark.written import written


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with `_part`, the number of the range they are in."""
    return written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def before(dealt: DataFrame, **sums: Column) -> DataFrame:
    """_part and what all earlier ranges sum up to."""
    parts = dealt.groupBy("_part").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    return parts.select("_part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums))


def running_sums(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """`rows` with columns that sum the given ones over all rows up to their place; rows that are equal in the order count together."""
    dealt = in_order(rows, *order)
    so_far = W.partitionBy("_part").orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = dealt.select("*", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_in_{name}") for name, c in sums.items()))
    both = inside.join(small(before(dealt, **sums)), "_part")
    return both.select(*rows.columns, *((F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums))


def row_numbers(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` numbered from 0 in an order without ties."""
    dealt = in_order(rows, *order)
    inside = dealt.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    both = inside.join(small(before(dealt, rows=F.lit(1))), "_part")
    return both.select(*rows.columns, (F.col("_n") + F.col("_before_rows")).alias(name))
