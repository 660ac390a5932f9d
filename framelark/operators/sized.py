"""Small sides of joins, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a side of a join is broadcast only if it has at most this many rows
BROADCAST_ROWS = 20_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `df`, computed now, with a broadcast hint, if there are at most `limit`; else `df` as it is.

    What is fetched to find out is bounded by `limit`, and serves the join, so a small side that is costly to compute isn't computed twice.
    """
    got = df.limit(limit + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if got.num_rows <= limit else df
