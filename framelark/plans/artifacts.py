"""Queries that publish artifacts made of the tables, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framelark.operators import features as X
from framelark.operators import repack as R
from framelark.plans.features import THERMO, o051, thermometer_literals
from framelark.plans.registry import query
from framelark.sources import artifacts as A
from framelark.sources.adapters import scores, table, with_ctes
from framelark.sources.scores import read_score_file, write_score_file
from framelark.written import shared_folder

FAN = 64
HEAD = {"feature_count": 256, "note_count": 10, "midi_min": 40, "sample_rate": 22050, "hop_size": 256, "seed": 7}


def _path(spark) -> str:
    return f"{shared_folder(spark)}/artifact-{uuid.uuid4().hex}"


def _frames(spark, d, words=None):
    """row, features, activity, onset: a frame for each vector; its thermometer words, its label, and its label where that changes."""
    packed = X.pack(o051(spark, d)) if words is None else words
    features = packed.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))  # a frame's four words
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.coalesce(F.get(F.filter("w", lambda x: x["word"] == k), F.lit(0))["bits"], F.lit(0).cast("long")))
    one = F.expr("array(shiftleft(1L, label))")
    changed = F.coalesce(F.lag("label").over(W.partitionBy(F.pmod("vec_id", F.lit(10))).orderBy("vec_id")) != F.col("label"), F.lit(True))
    labels = table(spark, d, "embeddings").select("vec_id", one.alias("activity"), F.when(changed, one).otherwise(F.array(F.lit(0).cast("long"))).alias("onset"))
    none = F.array_repeat(F.lit(0).cast("long"), 4)
    return labels.join(features, F.col("vec_id") == F.col("frame"), "left").select(F.col("vec_id").alias("row"), F.coalesce(grid, none).alias("features"), "activity", "onset")


def _indices(spark, d):
    """place, row: every third frame with an onset."""
    return table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.floor(F.col("vec_id") / 3).alias("place"), F.col("vec_id").alias("row"))


FRAMES_SQL = THERMO + """,
wd AS (SELECT frame, literal // 64 AS word, bit_or(CASE WHEN literal % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (literal % 64) END)::BIGINT AS bits FROM en GROUP BY ALL),
fw AS (SELECT vec_id AS row, list_transform(range(0, 4), lambda k: coalesce((list_filter(w, lambda x: x.word = k)[1]).bits, 0)) AS words FROM embeddings LEFT JOIN (SELECT frame, list({'word': word, 'bits': bits}) AS w FROM wd GROUP BY frame) ON frame = vec_id),
lb AS (SELECT vec_id AS row, [1::BIGINT << label] AS activity, [CASE WHEN coalesce(lag(label) OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) <> label, true) THEN 1::BIGINT << label ELSE 0 END] AS onset FROM embeddings)"""
DIGESTS_SQL = FRAMES_SQL + """,
js AS (SELECT 'features' AS section, row AS n, '{"row":' || row || ',"words":[' || array_to_string(words, ',') || ']}' AS j FROM fw
       UNION ALL SELECT 'activity', row, '{"row":' || row || ',"words":[' || array_to_string(activity, ',') || ']}' FROM lb
       UNION ALL SELECT 'onset', row, '{"row":' || row || ',"words":[' || array_to_string(onset, ',') || ']}' FROM lb
       UNION ALL SELECT 'indices', vec_id // 3, '{"place":' || vec_id // 3 || ',"row":' || vec_id || '}' FROM embeddings WHERE vec_id % 3 = 0),
bl AS (SELECT section, n // 64 AS b, count(*) AS rows, sha256(string_agg(sha256(j), '' ORDER BY n)) AS h FROM js GROUP BY ALL),
gp AS (SELECT section, b // 64 AS g, sum(rows) AS rows, sha256(string_agg(h, '' ORDER BY b)) AS h FROM bl GROUP BY ALL)"""


def _sections(spark, manifest):
    rows = [(n, s["rows"], s["digest"], manifest["header"].get("version", 1)) for n, s in manifest["sections"].items()]
    return spark.createDataFrame(rows, "section string, rows long, digest string, version int")


def _publish(spark, d, head=None, frames=None):
    path = _path(spark)
    frames = _frames(spark, d) if frames is None else frames
    return path, A.publish_dataset(spark, path, frames, _indices(spark, d), head or HEAD, fan=FAN)


@query("o008_dataset_digests", with_ctes("longx", body=", " + DIGESTS_SQL + " SELECT section, sum(rows)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY g)) AS digest, 1 AS version FROM gp GROUP BY section"))
def o008(spark, d):
    """The sections of a published dataset, with the roots of their digest trees."""
    return _sections(spark, _publish(spark, d)[1])


@query("o009_dataset_read", with_ctes("longx", body=", " + FRAMES_SQL + " SELECT row, list_sum(list_transform(words, lambda w: bit_count(w)))::INT AS set_bits, activity[1] AS activity, onset[1] AS onset, row % 3 = 0 AS sampled FROM fw JOIN lb USING (row)"))
def o009(spark, d):
    """A published dataset read back, all digests verified."""
    frames, indices = A.read_dataset(spark, _publish(spark, d)[0])
    bits = F.aggregate(F.transform("features", lambda w: F.bit_count(w)), F.lit(0), lambda a, b: a + b)
    return frames.join(indices.select("row", F.lit(True).alias("s")), "row", "left").select("row", bits.alias("set_bits"), F.col("activity")[0].alias("activity"), F.col("onset")[0].alias("onset"), F.coalesce("s", F.lit(False)).alias("sampled"))


@query("o135_contract_upgrade", with_ctes("longx", body=", " + DIGESTS_SQL + " SELECT section, sum(rows)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY g)) AS digest, 3 AS version FROM gp GROUP BY section"))
def o135(spark, d):
    """A dataset with a header of the first version, brought to the latest one, and that once more: payloads keep their digests."""
    first, _ = _publish(spark, d)
    once, twice = _path(spark), _path(spark)
    A.upgrade(spark, first, once)
    return _sections(spark, A.upgrade(spark, once, twice))


@query("o137_repack", with_ctes("longx", body=", " + FRAMES_SQL + " SELECT row, list_sum(list_transform(words, lambda w: bit_count(w)))::INT AS set_bits, activity[1] AS activity, onset[1] AS onset FROM fw JOIN lb USING (row)"))
def o137(spark, d):
    """The features of one dataset with the labels of another one of the same frames."""
    frames = _frames(spark, d)
    other = frames.withColumn("features", F.transform("features", lambda w: F.bitwise_not(w)))
    a, b, target = _publish(spark, d, frames=frames)[0], _publish(spark, d, frames=other)[0], _path(spark)
    R.repack(spark, a, b, target)
    got, _ = A.read_dataset(spark, target)
    bits = F.aggregate(F.transform("features", lambda w: F.bit_count(w)), F.lit(0), lambda x, y: x + y)
    return got.select("row", bits.alias("set_bits"), F.col("activity")[0].alias("activity"), F.col("onset")[0].alias("onset"))


@query(
    "o072_merged_ranges",
    """WITH r AS (SELECT s AS source, s AS first, (SELECT count(*) // 3 FROM embeddings) - s AS last FROM (SELECT unnest(range(0, 3)) AS s)),
    q AS (SELECT *, sum(last - first) OVER (ORDER BY source) - (last - first) AS into_ FROM r)
    SELECT (vec_id // 3 - first + into_)::BIGINT AS row, source::INT AS source, vec_id // 3 AS source_row, label FROM embeddings JOIN q ON vec_id % 3 = source AND vec_id // 3 >= first AND vec_id // 3 < last""",
)
def o072_merged(spark, d):
    """Rows of three sources, each row range in its place, with where each row came from."""
    x = table(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(3)).cast("int").alias("source"), F.floor(F.col("vec_id") / 3).alias("row"), "label")
    n = x.groupBy().agg(F.floor(F.count("*") / 3).alias("n"))
    ranges = n.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("source"), "n").select("source", F.col("source").cast("long").alias("first"), (F.col("n") - F.col("source")).alias("last"))
    size = F.col("last") - F.col("first")
    ranges = ranges.withColumn("into", F.sum(size).over(W.orderBy("source")) - size)  # three rows
    return R.merged(x, ranges)


def _models(spark, d):
    """members, clauses, literals: ten models, one for each label, a clause for each of its vectors."""
    x = table(spark, d, "embeddings").withColumn("id", F.concat(F.lit("m"), F.col("label").cast("string")))
    head = F.when(F.col("label") < 5, "activity").otherwise("onset")
    members = x.select("label", "id").distinct().select(head.alias("head"), F.row_number().over(W.partitionBy(head).orderBy("label")) - 1, "id").toDF("head", "place", "id")  # a row for each model
    members = members.select("head", "place", "id", F.lit(4).alias("outputs"), F.lit(128).alias("literals"), F.lit("f").alias("fingerprint"))
    weights = F.transform(F.slice("embedding", 1, 4), lambda v: F.floor(v.cast("double") * 1000).cast("int"))
    clauses = x.select("id", F.col("vec_id").alias("clause"), weights.alias("weights"))
    literals = x.select("id", F.col("vec_id").alias("clause"), F.posexplode("embedding").alias("d", "v")).where(F.abs(F.col("v").cast("double")) >= 0.2)
    return members, clauses, literals.select("id", "clause", F.when(F.col("v") > 0, F.col("d")).otherwise(F.col("d") + 64).alias("literal"))


LITERALS_SQL = "lt AS (SELECT 'm' || label AS id, frame AS clause, CASE WHEN v > 0 THEN d ELSE d + 64 END AS literal FROM longx WHERE abs(v) >= 0.2)"


@query(
    "o011_bundle_rows",
    with_ctes("longx", body=", " + LITERALS_SQL + """, c AS (SELECT 'm' || label AS id, vec_id AS clause, (SELECT count(*) FROM lt WHERE lt.clause = vec_id) AS size, floor(embedding[1]::DOUBLE * 1000)::INT AS weight FROM embeddings)
    SELECT id, clause, weight, (sum(size) OVER (ORDER BY id, clause) - size)::BIGINT AS first, size FROM c"""),
)
def o011(spark, d):
    """The clauses of a published bundle: each one's range among the positions of all literals."""
    path = _path(spark)
    A.publish_bundle(spark, path, *_models(spark, d), {"midi_min": 40})
    return A.tables(spark, path, "bundle")["clauses"].select("id", "clause", F.col("weights")[0].alias("weight"), "first", "size")


@query("o011_bundle_read", with_ctes("longx", body=", " + LITERALS_SQL + " SELECT * FROM lt"))
def o011_read(spark, d):
    """The literals of a bundle, read back by their ranges."""
    path = _path(spark)
    A.publish_bundle(spark, path, *_models(spark, d), {"midi_min": 40})
    return A.read_bundle(spark, path)[2]


@query("o010_model_read", with_ctes("longx", body=", " + LITERALS_SQL + " SELECT clause, count(*) AS literals, min(literal) AS least, max(literal) AS most FROM lt WHERE id = 'm3' GROUP BY clause"))
def o010(spark, d):
    """One model, published and read back."""
    path = _path(spark)
    _, clauses, literals = _models(spark, d)
    A.publish_model(spark, path, clauses.where("id = 'm3'").drop("id"), literals.where("id = 'm3'").drop("id"), {"outputs": 4, "literals": 128})
    return A.tables(spark, path, "model")["literals"].groupBy("clause").agg(F.count("*").alias("literals"), F.min("literal").alias("least"), F.max("literal").alias("most"))


@query("o012_frontend_entries", with_ctes("longx", body=", " + THERMO + " SELECT 'plain' AS bank, literal AS out_col, lit.d AS raw_col, round(t.threshold, 9) AS threshold, 0 AS ulps FROM lit JOIN t ON t.d = lit.d AND t.q = lit.q"))
def o012(spark, d):
    """The thermometer entries of a frontend, published and read back."""
    path = _path(spark)
    entries = thermometer_literals(spark, d).select(F.lit("plain").alias("bank"), F.col("literal").alias("out_col"), F.col("d").alias("raw_col"), "threshold", F.lit(0).alias("ulps"))
    A.publish_frontend(spark, path, entries, {"columns": 64})
    return A.tables(spark, path, "frontend")["entries"].withColumn("threshold", F.round("threshold", 9))


@query("o013_thermometer_read", with_ctes("longx", body=", " + THERMO + " SELECT literal, lit.d, lit.q, round(t.threshold, 9) AS threshold FROM lit JOIN t ON t.d = lit.d AND t.q = lit.q"))
def o013(spark, d):
    path = _path(spark)
    A.publish_thermometer(spark, path, thermometer_literals(spark, d), {"levels": list(X.QUANTILES)})
    return A.tables(spark, path, "thermometer")["literals"].withColumn("threshold", F.round("threshold", 9))


@query("o006_score_file", with_ctes("sc", body=" SELECT frame, pitch + 40 AS pitch, score, (score >= 20)::INT AS pred FROM sc WHERE member = 0"))
def o006(spark, d):
    """A member's scores, written as a score file and read back."""
    path = _path(spark)
    rows = scores(spark, d).where("member = 0").select("frame", (F.col("pitch") + 40).alias("pitch"), "score", (F.col("score") >= 20).cast("int").alias("pred"))
    write_score_file(rows, path, "SCORES_V1", {"head": "activity", "outputs": 10, "midi_min": 40, "sample_rate": 22050, "hop_size": 256, "threshold": 20})
    return read_score_file(spark, path, "SCORES_V1")[1]
