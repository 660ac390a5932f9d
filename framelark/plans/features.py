"""Queries over feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framelark.functions import dsp
from framelark.operators import features as X
from framelark.operators import notes as N
from framelark.operators.sized import small
from framelark.plans.registry import query
from framelark.sources.adapters import FRAMES, features, note_events, table, with_ctes


@query("o024_midi_to_hz", with_ctes("ne", body="SELECT pitch, round(440 * pow(2.0, (pitch - 69) / 12.0), 6) AS hz, count(*) AS events FROM ne GROUP BY pitch"))
def o024(spark, d):
    return note_events(spark, d).groupBy("pitch").agg(F.count("*").alias("events")).select("pitch", F.round(dsp.midi_to_hz(F.col("pitch")), 6).alias("hz"), "events")


@query(
    "o027_fractional_bin",
    """SELECT vec_id, round(CASE WHEN lo + 1 > 64 THEN 0 ELSE e[lo + 1] * (1 - (pos - lo)) + coalesce(e[lo + 2], 0) * (pos - lo) END, 6) AS value
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (vec_id % 700) / 10.0::DOUBLE AS pos, floor((vec_id % 700) / 10.0::DOUBLE)::INT AS lo FROM embeddings)""",
)
def o027(spark, d):
    x = table(spark, d, "embeddings")
    return x.select("vec_id", F.round(dsp.sample_bin(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 700) / 10.0), 6).alias("value"))


@query(
    "o028_unit_db",
    with_ctes("longx", body="SELECT frame, round(sum(least(greatest((20 * log10(greatest(abs(v), 1e-7)) + 100) / 100, 0), 1)), 6) AS total FROM longx GROUP BY frame"),
)
def o028(spark, d):
    return X.to_long(features(spark, d)).groupBy("frame").agg(F.round(F.sum(dsp.unit_db(F.abs("v"))), 6).alias("total"))


@query(
    "o029_salience",
    with_ctes("longx", body="""SELECT frame, round(sum(least(greatest((20 * log10(greatest(v, 1e-7)) + 100) / 100, 0), 1) / sqrt(d + 1)) / (SELECT sum(1 / sqrt(h)) FROM range(1, 7) t(h)), 6) AS salience
      FROM longx WHERE d < 6 GROUP BY frame"""),
)
def o029(spark, d):
    return features(spark, d).select("frame", F.round(dsp.salience(F.slice("x", 1, 6), 6), 6).alias("salience"))


#: the fundamental of a frame, and its harmonics and their sides, from the magnitudes of its 64 bins
HARMONICS = """hm AS (SELECT vec_id AS frame, list_transform(embedding::DOUBLE[], lambda v: abs(v)) AS e, (2 + vec_id % 8)::DOUBLE AS f, unnest(range(1, 7))::INT AS h FROM embeddings),
sp AS (SELECT frame, h, e, f, unnest([0.0, -0.5, 0.5])::DOUBLE AS m FROM hm),
po AS (SELECT frame, h, m, e, f * pow(2.0::DOUBLE, m / 12) * h AS pos FROM sp),
un AS (SELECT frame, h, m, least(greatest((20 * log10(greatest(CASE WHEN floor(pos) + 1 > 64 THEN 0 ELSE e[floor(pos)::INT + 1] * (1 - (pos - floor(pos))) + coalesce(e[floor(pos)::INT + 2], 0) * (pos - floor(pos)) END, 1e-7)) + 100) / 100, 0), 1) AS u FROM po),
hs AS (SELECT frame, h, max(u) FILTER (WHERE m = 0) AS u, 0.5 * sum(u) FILTER (WHERE m <> 0) AS side, 1 / sqrt(h) / (SELECT sum(1 / sqrt(i)) FROM range(1, 7) t(i)) AS w FROM un GROUP BY frame, h)"""


def _bins(spark, d):
    x = table(spark, d, "embeddings")
    return x.select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("x"), (2 + F.pmod("vec_id", F.lit(8))).cast("double").alias("f"))


@query("o030_contrast_fundamental", f"WITH {HARMONICS} SELECT frame, round(least(greatest(sum(u * w) - max(side) FILTER (WHERE h = 1) + 0.5, 0), 1), 6) AS contrast FROM hs GROUP BY frame")
def o030_fundamental(spark, d):
    return _bins(spark, d).select("frame", F.round(dsp.local_contrast(F.col("x"), F.col("f"), 6, False), 6).alias("contrast"))


@query("o030_contrast_harmonic", f"WITH {HARMONICS} SELECT frame, round(least(greatest(sum(u * w) - sum(side * w) + 0.5, 0), 1), 6) AS contrast FROM hs GROUP BY frame")
def o030_harmonic(spark, d):
    return _bins(spark, d).select("frame", F.round(dsp.local_contrast(F.col("x"), F.col("f"), 6, True), 6).alias("contrast"))


@query("o031_local_profile", f"WITH {HARMONICS} SELECT frame, h, round(least(greatest(u - side + 0.5, 0), 1), 6) AS value FROM hs")
def o031(spark, d):
    profile = F.posexplode(dsp.local_profile(F.col("x"), F.col("f"), 6)).alias("h", "value")
    return _bins(spark, d).select("frame", profile).select("frame", (F.col("h") + 1).alias("h"), F.round("value", 6).alias("value"))


@query(
    "o033_positive_flux",
    with_ctes("longx", body="""SELECT track, frame, round(sum(least(greatest(v - p, 0), 1)), 6) AS flux FROM
      (SELECT track, frame, v, coalesce(lag(v) OVER (PARTITION BY track, d ORDER BY frame), 0) AS p FROM longx) GROUP BY ALL"""),
)
def o033(spark, d):
    return X.flux(features(spark, d)).select("track", "frame", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("flux"))


@query(
    "o034_fast_minus_slow",
    """WITH RECURSIVE x AS (SELECT vec_id % 10 AS track, vec_id AS frame, unnest(range(0, 64))::INT AS d, unnest(embedding)::DOUBLE AS v FROM embeddings),
    e AS (SELECT track, frame, d, v, v AS ema FROM x WHERE frame < 10
          UNION ALL SELECT x.track, x.frame, x.d, x.v, e.ema + 0.08 * (x.v - e.ema) FROM e JOIN x ON x.frame = e.frame + 10 AND x.d = e.d)
    SELECT track, frame, d, round(least(greatest(v - ema + 0.5, 0), 1), 6) AS value FROM e""",
)
def o034(spark, d):
    return X.smoothed(features(spark, d)).select("track", "frame", F.posexplode("x").alias("d", "value")).withColumn("value", F.round("value", 6))


@query(
    "o035_frame_globals",
    with_ctes("longx", body=""" SELECT frame, round(least(greatest((20 * log10(greatest(sqrt(sum(v * v) / 64), 1e-7)) + 100) / 100, 0), 1), 6) AS rms, round(least(40 * sum(greatest(abs(v) - p, 0)) / 64, 1), 6) AS flux,
      round(least(CASE WHEN sum(abs(v)) > 1e-9 THEN sum(d * abs(v)) / sum(abs(v)) ELSE 0 END / 63, 1), 6) AS centroid FROM
      (SELECT *, coalesce(abs(lag(v) OVER (PARTITION BY track, d ORDER BY frame)), 0) AS p FROM longx) GROUP BY frame"""),
)
def o035(spark, d):
    """Loudness in decibels, broadband flux and spectral centroid of each frame, all from 0 to 1."""
    before = F.coalesce(F.lag("m").over(W.partitionBy("track").orderBy("frame")), F.transform("m", lambda v: F.lit(0.0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    rows = features(spark, d).withColumn("m", F.transform("x", lambda v: F.abs(v))).withColumn("before", before)
    rise = total(F.zip_with("m", "before", lambda a, b: F.greatest(a - b, F.lit(0.0)))) / 64
    mass = total(F.col("m"))
    centre = F.when(mass > 1e-9, total(F.transform("m", lambda v, i: v * i)) / mass).otherwise(0.0) / 63
    loud = dsp.unit_db(F.sqrt(total(F.transform("m", lambda v: v * v)) / 64))
    return rows.select("frame", F.round(loud, 6).alias("rms"), F.round(dsp.clip(rise * 40, 0.0, 1.0), 6).alias("flux"), F.round(dsp.clip(centre, 0.0, 1.0), 6).alias("centroid"))


@query(
    "o038_harmonic_owners",
    """WITH p AS (SELECT 39 + l_quantity::INT AS pitch, count(*) AS cells FROM lineitem GROUP BY 1), h AS (SELECT unnest(range(2, 12))::INT AS h)
    SELECT a.pitch, b.pitch AS owner, h, a.cells, b.cells AS owner_cells FROM p a, p b, h WHERE abs(1200 * log2(pow(2.0, (a.pitch - b.pitch) / 12.0) / h)) <= 18""",
)
def o038(spark, d):
    """Owners among the pitches that occur (a pitch for each quantity), with how often both do."""
    cells = table(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("int") + 39).alias("pitch")).agg(F.count("*").alias("cells"))
    owned = X.owners(cells.select("pitch")).join(small(cells), "pitch")
    return owned.join(small(cells.select(F.col("pitch").alias("owner"), F.col("cells").alias("owner_cells"))), "owner")


@query(
    "o039_owner_residual",
    """WITH RECURSIVE p AS (SELECT unnest(range(0, 64))::INT AS pitch), h AS (SELECT unnest(range(2, 12))::INT AS h),
    l AS (SELECT a.pitch, b.pitch AS owner, h FROM p a, p b, h WHERE abs(1200 * log2(pow(2.0, (a.pitch - b.pitch) / 12.0) / h)) <= 18),
    c AS (SELECT vec_id % 10 AS track, vec_id AS frame, unnest(range(0, 64))::INT AS pitch, abs(unnest(embedding)::DOUBLE) AS amp FROM embeddings),
    s AS (SELECT c.track, c.frame, l.pitch, sum(c.amp / h * 1.05) AS e FROM c JOIN l ON l.owner = c.pitch GROUP BY ALL)
    SELECT c.track, c.frame, c.pitch, round(greatest(c.amp - coalesce(e, 0), 0), 6) AS residual FROM c LEFT JOIN s USING (track, frame, pitch)""",
)
def o039(spark, d):
    cells = X.to_long(features(spark, d)).select("track", "frame", F.col("d").alias("pitch"), F.abs("v").alias("amp"))
    links = X.owners(spark.range(64).select(F.col("id").cast("int").alias("pitch")))
    return X.owner_residual(cells, small(links)).withColumn("residual", F.round("residual", 6))


@query(
    "o040_tuning_mask",
    with_ctes("longx", body="""SELECT frame, d, round(greatest(least((abs(v) / greatest(coalesce(lag(abs(v)) OVER w, 0), coalesce(lead(abs(v)) OVER w, 0), 1e-9) - 1.02) / 0.18, 1), 0), 6) AS mask
      FROM longx WINDOW w AS (PARTITION BY frame ORDER BY d)"""),
)
def o040(spark, d):
    long = X.to_long(features(spark, d)).withColumn("v", F.abs("v"))
    return X.tuning_mask(long).select("frame", "d", F.round("mask", 6).alias("mask"))


@query(
    "o041_compression_blend",
    with_ctes("ne", body="SELECT event_id, round(0.72 * (1 - exp(-greatest(amp - 0.02, 0) / 0.3)) + 0.28 * (1 - exp(-greatest(amp - 0.1, 0) / 0.5)), 6) AS evidence FROM ne"),
)
def o041(spark, d):
    amp = F.col("amp")
    return note_events(spark, d).select("event_id", F.round(dsp.blend(dsp.compress(amp, 0.02, 0.3), dsp.compress(amp, 0.1, 0.5), 0.28), 6).alias("evidence"))


@query(
    "o044_input_gain",
    """SELECT track, round(greatest(least(0.5 / greatest(peak, 1e-12), pow(10, 1.2)), 1 / pow(10, 1.2)), 6) AS gain FROM
    (SELECT vec_id % 10 AS track, quantile_cont(abs(v), 0.99) AS peak FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1)""",
)
def o044(spark, d):
    return X.gain(X.to_long(features(spark, d)))


@query(
    "o045_velocity_map",
    with_ctes("ne", body="SELECT event_id, greatest(least(round_even(1 + 126 * sqrt(1 - exp(-greatest(amp - 0.01, 0) / 0.4)), 0), 127), 1)::INT AS velocity FROM ne"),
)
def o045(spark, d):
    return note_events(spark, d).select("event_id", dsp.velocity(F.col("amp"), 0.01, 0.4).alias("velocity"))


@query(
    "o047_lag_stack",
    """WITH x AS (SELECT vec_id % 10 AS track, vec_id AS frame, embedding::DOUBLE[] AS x FROM embeddings),
    l AS (SELECT track, frame, x, """ + ", ".join(f"lag(x, {k}) OVER w AS x{k}" for k in X.LAGS[1:]) + """ FROM x WINDOW w AS (PARTITION BY track ORDER BY frame))
    SELECT track, frame, len(c)::INT AS width, round(list_sum(c), 6) AS total, round(coalesce(c[65], 0), 6) AS probe FROM
    (SELECT track, frame, x || """ + " || ".join(f"coalesce(x{k}, list_transform(range(0, 64), lambda i: 0.0::DOUBLE))" for k in X.LAGS[1:]) + " AS c FROM l)",
)
def o047(spark, d):
    c = F.col("ctx")
    return X.lag_stack(features(spark, d), 64).select(
        "track", "frame", F.size(c).alias("width"), F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(c[64], 6).alias("probe")
    )


THERMO = """t AS (SELECT d, unnest([0, 1, 2, 3])::INT AS q, unnest(quantile_cont(v, [0.5, 0.7, 0.85, 0.95]))::FLOAT::DOUBLE AS threshold FROM longx GROUP BY d),
b AS (SELECT track, frame, longx.d, q, (v >= threshold)::INT AS bit FROM longx JOIN t USING (d)),
lit AS (SELECT (row_number() OVER (ORDER BY d, q) - 1)::INT AS literal, d, q FROM (SELECT d, q FROM b GROUP BY d, q HAVING max(bit) = 1 AND min(bit) = 0)),
en AS (SELECT track, frame, literal FROM b JOIN lit USING (d, q) WHERE bit = 1)"""


def _thermo(body: str) -> str:
    return with_ctes("longx", body=", " + THERMO + "\n" + body)


@query("o049_thermometer_fit", _thermo("SELECT d, q, round(threshold, 9) AS threshold FROM t"))
def o049(spark, d):
    return X.thermometer_fit(X.to_long(features(spark, d))).withColumn("threshold", F.round("threshold", 9))


def thermometer_literals(spark, d):
    long = X.to_long(features(spark, d))
    return X.varying_literals(long, X.thermometer_fit(long))


@query("o050_varying_literals", _thermo("SELECT literal, d, q FROM lit"))
def o050(spark, d):
    return thermometer_literals(spark, d).drop("threshold")


@query("o051_thermometer_encode", _thermo("SELECT track, frame, literal FROM en"))
def o051(spark, d):
    return X.encode_wide(features(spark, d), thermometer_literals(spark, d))


@query(
    "o053_train_only_fit",
    with_ctes("longx", body="""SELECT CASE WHEN frame % 10 < 8 THEN 'train' ELSE 'test' END AS split, l.d, sum((v >= t.threshold)::INT)::BIGINT AS set_bits FROM longx l JOIN
      (SELECT d, quantile_cont(v, 0.7)::FLOAT::DOUBLE AS threshold FROM longx WHERE frame % 10 < 8 GROUP BY d) t ON t.d = l.d GROUP BY 1, 2"""),
)
def o053(spark, d):
    long = X.to_long(features(spark, d)).withColumn("split", F.when(F.col("frame") % 10 < 8, "train").otherwise("test"))
    fit = X.thermometer_fit(long.where("split = 'train'"), (0.7,))
    return long.join(small(fit), "d").groupBy("split", "d").agg(F.sum((F.col("v") >= F.col("threshold")).cast("int")).alias("set_bits"))


@query("o054_pack_words", _thermo("SELECT track, frame, (literal // 64)::INT AS word, bit_or(CASE WHEN literal % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (literal % 64) END)::BIGINT AS bits FROM en GROUP BY ALL"))
def o054(spark, d):
    return X.pack(o051(spark, d))


@query("o054_unpack_words", _thermo("SELECT track, frame, literal FROM en"))
def o054_back(spark, d):
    return X.unpack(o054(spark, d))


@query(
    "o055_literal_encoding",
    _thermo("SELECT f.track, f.frame, f.literal + CASE WHEN en.literal IS NULL THEN 256 ELSE 0 END AS literal FROM (SELECT vec_id % 10 AS track, vec_id AS frame, unnest(range(0, 256))::INT AS literal FROM embeddings) f LEFT JOIN en USING (track, frame, literal)"),
)
def o055(spark, d):
    return X.with_negations(o051(spark, d), features(spark, d), 256)


@query("o090_literal_audit", _thermo("SELECT count(*) AS frames, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, median(n) AS median FROM (SELECT track, frame, count(*) AS n FROM en GROUP BY 1, 2)"))
def o090(spark, d):
    return X.literal_audit(o054(spark, d))


@query(
    "o109_coprime_permutation",
    """SELECT vec_id, ((vec_id * 17 + 5) % 64)::BIGINT AS place, gcd(vec_id % 64, 64) = 1 AS coprime FROM embeddings""",
)
def o109(spark, d):
    x = table(spark, d, "embeddings")
    return x.select("vec_id", F.pmod(F.col("vec_id") * 17 + 5, F.lit(64)).alias("place"), dsp.gcd_coprime(F.col("vec_id") % 64, 64).alias("coprime"))


@query("o043_downmix", "SELECT vec_id, round(0.5 * (embedding[1]::DOUBLE + embedding[2]::DOUBLE), 6) AS mono FROM embeddings")
def o043(spark, d):
    x = table(spark, d, "embeddings")
    return x.select("vec_id", F.round(0.5 * (F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double")), 6).alias("mono"))


@query("frame_activity_share", with_ctes("ne", "act", body="SELECT track, round(count(DISTINCT frame) / 720, 6) AS share FROM act GROUP BY track"))
def o048(spark, d):
    return N.rasterise(note_events(spark, d), FRAMES).groupBy("track").agg(F.round(F.count_distinct("frame") / FRAMES, 6).alias("share"))
