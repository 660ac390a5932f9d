"""Time-window queries in their batch form (the streaming forms are in `framelark.streaming`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.plans.registry import query
from framelark.sources.adapters import table
from framelark.streaming import causal


@query(
    "s01_sliding_windows",
    """SELECT w AS hour, event_type, count(*) AS n, round(avg(value), 3) AS mean FROM
    (SELECT *, unnest(range(floor(epoch(ts) / 3600)::BIGINT - 7, floor(epoch(ts) / 3600)::BIGINT + 1)) AS w FROM events) GROUP BY ALL""",
)
def s01(spark, d):
    rows = causal.windowed_activity(table(spark, d, "events"), F.col("ts").cast("timestamp"))
    return rows.select((F.unix_timestamp("window.start") / 3600).cast("long").alias("hour"), "event_type", "n", F.round("mean", 3).alias("mean"))


@query(
    "s02_sessions",
    """SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM
    (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
      (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS)::INT, 1) AS b FROM events)) GROUP BY user_id, s""",
)
def s02(spark, d):
    rows = causal.sessions(table(spark, d, "events"), F.col("ts").cast("timestamp"))
    return rows.select("user_id", "n", F.round("total", 4).alias("total"))


@query("s03_tumbling_counts", "SELECT floor(epoch(ts) / 86400)::BIGINT AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def s03(spark, d):
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(day.alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select((F.unix_timestamp("w.start") / 86400).cast("long").alias("day"), "n", "users")
