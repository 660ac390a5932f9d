"""Frozen confirmation: a choice made on validation rows, confirmed once on test rows that no fit has seen.

Lineage is a table of rows (fit, id): which rows each fit, calibration or choice has read. Guards are rows too: none means that
the confirmation holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators.sized import small


def leaks(used: DataFrame, splits: DataFrame, held: str = "test") -> DataFrame:
    """fit, id, problem: what a fit has read (fit, id) and must not have, given splits (id, grp, split).

    That is rows of the held split, rows of a group that has rows in the held split (null groups are none), and rows that no split knows.
    """
    known = used.distinct().join(splits.select("id", "grp", "split"), "id", "left")
    groups = splits.where((F.col("split") == held) & F.col("grp").isNotNull()).select(F.col("grp").alias("_g")).distinct().withColumn("_held", F.lit(True))
    joined = known.join(small(groups), F.col("grp") == F.col("_g"), "left")
    problem = F.when(F.col("split").isNull(), "unknown row").when(F.col("split") == held, "held-out row").when(F.col("_held"), "group of a held-out row")
    return joined.select("fit", "id", problem.alias("problem")).where("problem is not null")


def frozen(validation: DataFrame, *order) -> DataFrame:
    """The candidate that is best on validation rows by `order`, with the digest of its parameters: one row (candidate, params, digest)."""
    best = validation.orderBy(*order, "candidate").limit(1)
    return best.select("candidate", "params", F.sha2(F.to_json("params"), 256).alias("digest"))


def confirmation_guards(choice: DataFrame, confirmed: DataFrame) -> DataFrame:
    """candidate, problem: test results (candidate, params, run) of another candidate than the frozen one, with other parameters, or of more than one run."""
    one = choice.select(F.col("candidate").alias("_c"), "digest")
    both = confirmed.withColumn("_d", F.sha2(F.to_json("params"), 256)).join(F.broadcast(one), F.lit(True))  # one row
    first = both.agg(F.min("run").alias("first"))
    both = both.join(F.broadcast(first), F.lit(True))
    problem = F.when(F.col("candidate") != F.col("_c"), "not the frozen candidate").when(F.col("_d") != F.col("digest"), "parameters changed").when(F.col("run") != F.col("first"), "confirmed more than once")
    return both.select("candidate", "run", problem.alias("problem")).where("problem is not null")
