"""Canonical note and feature tables derived from the general test tables.

Each adapter has a DataFrame form and, for the checks, the same table as a SQL
common table expression in `CTES`. One frame is one hour, a track is a user, and
pitches 40..44 stand for the five event types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 720
LOW, HIGH = 40, 44
TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, track, pitch, start, end, amp; the interval is [start, end), empty if start = end."""
    pitch = F.lit(HIGH)
    for i, t in enumerate(TYPES[:-1]):
        pitch = F.when(F.col("event_type") == t, LOW + i).otherwise(pitch)
    return (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            F.col("user_id").alias("track"),
            pitch.cast("int").alias("pitch"),
            F.expr("cast(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS INT)").alias("start"),
            F.pmod(_k(), F.lit(8)).alias("len"),
            F.least(F.col("value") / 500, F.lit(1.0)).alias("amp"),
        )
        .withColumn("end", F.least(F.col("start") + F.col("len"), F.lit(FRAMES)))
        .drop("len")
    )


def predicted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disturbed copy of `note_events`: some events are missing, others late."""
    late = F.col("start") + F.pmod("track", F.lit(3)).cast("int")
    return (
        note_events(spark, sf_dir)
        .where(F.pmod("event_id", F.lit(7)) != 0)
        .withColumn("end", F.least(late + (F.col("end") - F.col("start")), F.lit(FRAMES)))
        .withColumn("start", late)
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, x array<double>, label: embeddings as the frames of ten tracks."""
    return table(spark, sf_dir, "embeddings").select(
        F.pmod("vec_id", F.lit(10)).alias("track"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def scores(spark: SparkSession, sf_dir: str, members: int = 6) -> DataFrame:
    """member, frame, pitch, score, truth: member m scores pitch p by feature 10m + p."""
    x = table(spark, sf_dir, "embeddings")
    cell = F.explode(F.sequence(F.lit(0), F.lit(10 * members - 1))).alias("c")
    return x.select(F.col("vec_id").alias("frame"), "label", "embedding", cell).select(
        F.floor(F.col("c") / 10).cast("int").alias("member"),
        "frame",
        (F.col("c") % 10).cast("int").alias("pitch"),
        F.floor(F.element_at("embedding", F.col("c") + 1).cast("double") * 1000).cast("int").alias("score"),
        (F.col("label") == F.col("c") % 10).cast("int").alias("truth"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, grp, id, split: documents as a track manifest."""
    p = F.pmod("doc_id", F.lit(10))
    return table(spark, sf_dir, "documents").select(
        "source", F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.when(p < 8, "train").when(p == 8, "validation").otherwise("test").alias("split")
    )


CTES = {
    "ne": """ne AS (
  SELECT event_id, user_id AS track,
         CASE event_type WHEN 'click' THEN 40 WHEN 'error' THEN 41 WHEN 'purchase' THEN 42 WHEN 'signup' THEN 43 ELSE 44 END AS pitch,
         floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INT AS start,
         least(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INT + (props->>'$.k')::INT % 8, 720) AS "end",
         least(value / 500, 1.0) AS amp
  FROM events)""",
    "pe": """pe AS (
  SELECT event_id, track, pitch, (start + track % 3)::INT AS start, least(start + track % 3 + "end" - start, 720)::INT AS "end", amp
  FROM ne WHERE event_id % 7 <> 0)""",
    "act": """act AS (
  SELECT track, pitch, frame, max(amp) AS velocity
  FROM (SELECT track, pitch, amp, unnest(range(start, "end"))::INT AS frame FROM ne WHERE start < 720) GROUP BY ALL)""",
    "pact": """pact AS (
  SELECT track, pitch, frame FROM (SELECT track, pitch, unnest(range(start, "end"))::INT AS frame FROM pe WHERE start < 720) GROUP BY ALL)""",
    "cells": """cells AS (
  SELECT coalesce(a.track, p.track) AS track, coalesce(a.pitch, p.pitch) AS pitch, coalesce(a.frame, p.frame) AS frame,
         (a.track IS NOT NULL)::INT AS y, (p.track IS NOT NULL)::INT AS p
  FROM act a FULL JOIN pact p ON a.track = p.track AND a.pitch = p.pitch AND a.frame = p.frame)""",
    "feat": """feat AS (SELECT vec_id % 10 AS track, vec_id AS frame, embedding::DOUBLE[] AS x, label FROM embeddings)""",
    "longx": """longx AS (SELECT vec_id % 10 AS track, vec_id AS frame, label, unnest(range(0, 64))::INT AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)""",
    "sc": """sc AS (
  SELECT (c // 10)::INT AS member, frame, (c % 10)::INT AS pitch, floor(embedding[c + 1]::DOUBLE * 1000)::INT AS score, (label = c % 10)::INT AS truth
  FROM (SELECT vec_id AS frame, label, embedding, unnest(range(0, 60)) AS c FROM embeddings))""",
    "corp": """corp AS (
  SELECT source, lang AS grp, doc_id AS id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split
  FROM documents)""",
}


def with_ctes(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names) + "\n" + body
