"""Queries of sampling, calibration and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.operators import notes as N
from framelark.operators import selection as S
from framelark.plans.registry import query
from framelark.sources.adapters import FRAMES, corpus, note_events, predicted_events, scores, table, with_ctes

H = "md5(concat_ws('/', {}))"


@query(
    "o096_stratified_selection",
    with_ctes("corp", body="""SELECT source, grp, id, place FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, md5(concat_ws('/', 's', source, grp)), grp)::INT AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY source, grp ORDER BY md5(concat_ws('/', 's', source, id::VARCHAR)), id) AS turn FROM corp WHERE split = 'train'))
      ORDER BY place, source LIMIT 100"""),
)
def o096(spark, d):
    return S.stratified(corpus(spark, d).where("split = 'train'"), 100)


@query("o089_source_counts", with_ctes("corp", body="SELECT source, split, count(*) AS n, count(DISTINCT grp) AS groups FROM corp GROUP BY ALL"))
def o089(spark, d):
    return corpus(spark, d).groupBy("source", "split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))


CATEGORY = """on_ AS (SELECT track, start AS frame, count(DISTINCT pitch) AS o FROM ne WHERE "end" > start AND start < 720 GROUP BY ALL),
ac AS (SELECT track, frame, count(*) AS a FROM act GROUP BY ALL),
fr AS (SELECT track, frame, coalesce(o, 0) AS o, coalesce(a, 0) AS a FROM (SELECT DISTINCT track, unnest(range(0, 720))::INT AS frame FROM (SELECT DISTINCT track FROM ne)) f
       LEFT JOIN on_ USING (track, frame) LEFT JOIN ac USING (track, frame)),
cat AS (SELECT track, frame, CASE WHEN o >= 2 THEN 'chord_onset' WHEN o = 1 THEN 'single_onset' WHEN a >= 2 THEN 'poly_sustain' WHEN a = 1 THEN 'single_sustain' ELSE 'silence' END AS category FROM fr),
q AS (SELECT category, available, (CASE WHEN lead(rk) OVER (ORDER BY rk) IS NULL THEN greatest(1000 - coalesce(b, 0), 0) ELSE least(part, greatest(1000 - coalesce(b, 0), 0)) END)::INT AS wanted FROM (
      SELECT *, sum(part) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (
        SELECT category, count(*) AS available, CASE category WHEN 'chord_onset' THEN 0 WHEN 'single_onset' THEN 1 WHEN 'poly_sustain' THEN 2 WHEN 'single_sustain' THEN 3 ELSE 4 END AS rk,
               CASE category WHEN 'chord_onset' THEN 300 WHEN 'single_onset' THEN 200 WHEN 'poly_sustain' THEN 300 WHEN 'single_sustain' THEN 150 ELSE 50 END AS part FROM cat GROUP BY category)))"""


def _categories(spark, d):
    ne = note_events(spark, d)
    onset = ne.where("`end` > start and start < 720").groupBy("track", F.col("start").alias("frame")).agg(F.count_distinct("pitch").alias("o"))
    active = N.rasterise(ne, FRAMES).groupBy("track", "frame").agg(F.count("*").alias("a"))
    grid = ne.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    both = grid.join(onset, ["track", "frame"], "left").join(active, ["track", "frame"], "left")
    return both.select("track", "frame", S.frame_category(F.coalesce("o", F.lit(0)), F.coalesce("a", F.lit(0))).alias("category"))


@query("o098_category_quotas", with_ctes("ne", "act", body="," + CATEGORY + " SELECT category, available, wanted FROM q"))
def o098_quotas(spark, d):
    return S.category_quotas(_categories(spark, d).groupBy("category").agg(F.count("*").alias("available")), 1000)


@query(
    "o098_balanced_sample",
    with_ctes("ne", "act", body="," + CATEGORY + """ SELECT category, track, frame, unnest(range(1, (wanted - place) // available + 2))::INT AS copy FROM (
      SELECT cat.*, available, wanted, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('/', 'b', track::VARCHAR, frame::VARCHAR)), track, frame) AS place
      FROM cat JOIN q USING (category)) WHERE place <= wanted"""),
)
def o098(spark, d):
    return S.balanced_sample(_categories(spark, d), 1000)


@query(
    "o099_even_sample",
    with_ctes("ne", "act", body="""SELECT p.track, k::INT AS k, frame FROM (SELECT track, n, unnest(range(0, 20)) AS k FROM (SELECT track, count(DISTINCT frame) AS n FROM act GROUP BY 1)) p
      JOIN (SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT track, frame FROM act)) a ON a.track = p.track AND a.i = floor(p.k * (p.n - 1) / 19)"""),
)
def o099(spark, d):
    return S.evenly(N.rasterise(note_events(spark, d), FRAMES).select("track", "frame").distinct(), 20)


@query(
    "amplitude_kind_quota",
    with_ctes("ne", body="""SELECT kind, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(concat_ws('/', 'o', event_id::VARCHAR)), event_id) AS place FROM (
        SELECT event_id, CASE WHEN amp >= 0.3 THEN 'strong' WHEN amp >= 0.05 THEN 'weak' ELSE 'noise' END AS kind FROM ne)) WHERE place <= CASE kind WHEN 'strong' THEN 550 WHEN 'weak' THEN 350 ELSE 100 END GROUP BY kind"""),
)
def o100(spark, d):
    kind = F.when(F.col("amp") >= 0.3, "strong").when(F.col("amp") >= 0.05, "weak").otherwise("noise")
    quota = F.when(F.col("kind") == "strong", 550).when(F.col("kind") == "weak", 350).otherwise(100)
    rows = note_events(spark, d).select("event_id", kind.alias("kind"))
    by = S.W.partitionBy("kind").orderBy(S.order_hash(F.lit("o"), F.col("event_id")), "event_id")
    return rows.withColumn("place", F.row_number().over(by)).where((F.col("place") <= 550) & (F.col("place") <= quota)).groupBy("kind").agg(F.count("*").alias("n"))


CURVE = """cu AS (SELECT member, score, sum(n) OVER w AS predicted, sum(t) OVER w AS tp, sum(t) OVER (PARTITION BY member) AS target, max(score) OVER (PARTITION BY member) AS top
  FROM (SELECT member, score, count(*) AS n, sum(truth) AS t FROM sc GROUP BY 1, 2) WINDOW w AS (PARTITION BY member ORDER BY score DESC)),
fc AS (SELECT *, 2.0::DOUBLE * tp / greatest(predicted + target, 1) AS f1 FROM cu)"""
CAL = """SELECT g.member, coalesce(b.score, g.top + 1)::INT AS threshold, coalesce(b.tp, 0)::BIGINT AS tp, (coalesce(b.predicted, 0) - coalesce(b.tp, 0))::BIGINT AS fp,
  (g.target - coalesce(b.tp, 0))::BIGINT AS fn, round(coalesce(b.f1, 0), 6) AS f1
FROM (SELECT member, max(top) AS top, max(target) AS target FROM fc GROUP BY 1) g LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY f1 DESC, score DESC) AS k FROM fc WHERE f1 > 0 AND {}) WHERE k = 1) b USING (member)"""


@query("o101_threshold_calibration", with_ctes("sc", body="," + CURVE + CAL.format("predicted <= 1.5 * target")))
def o101(spark, d):
    return S.calibrate(scores(spark, d), 1.5, "member")


FREE = CAL.format("(predicted <= 4.0 * target AND predicted >= 0.5 * target OR NOT EXISTS (SELECT 1 FROM fc f WHERE f.member = fc.member AND f.predicted <= 4.0 * f.target AND f.predicted >= 0.5 * f.target))")


@query("o102_bounded_calibration", with_ctes("sc", body="," + CURVE + FREE))
def o102(spark, d):
    return S.calibrate(scores(spark, d), 4.0, "member", floor=0.5, fall_back=True)


@query(
    "o103_grid_calibration",
    with_ctes("sc", body="," + CURVE + """, gr AS (SELECT DISTINCT member, unnest(list_append(quantile_cont(score, list_transform(range(0, 100), lambda i: i / 99.0::DOUBLE)), 0.0)) AS threshold FROM sc GROUP BY member),
      pt AS (SELECT member, threshold, predicted, tp, target, 2.0::DOUBLE * tp / greatest(predicted + target, 1) AS f1 FROM
        (SELECT gr.member, threshold, max(predicted) AS predicted, max(tp) AS tp, max(target) AS target FROM gr JOIN cu ON cu.member = gr.member AND cu.score >= threshold GROUP BY 1, 2))
      SELECT g.member, round(coalesce(b.threshold, n.threshold), 6) AS threshold, round(coalesce(b.f1, n.f1), 6) AS f1 FROM (SELECT DISTINCT member FROM pt) g
      LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY f1 DESC, threshold DESC) AS k FROM pt WHERE predicted BETWEEN 0.5 * target AND 1.25 * target) WHERE k = 1) b USING (member)
      LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY abs(predicted - target), threshold DESC) AS k FROM pt) WHERE k = 1) n USING (member)"""),
)
def o103(spark, d):
    return S.calibrate_on_grid(scores(spark, d), 100, 0.5, 1.25)


@query(
    "o104_tolerant_calibration",
    with_ctes("ne", "pe", body=""", g AS (SELECT DISTINCT unnest(list_append(quantile_cont(amp, list_transform(range(0, 160), lambda i: 0.01::DOUBLE + (0.999::DOUBLE - 0.01::DOUBLE) * i / 159)), 0.0)) AS cut FROM pe),
      h AS (SELECT amp, EXISTS (SELECT 1 FROM ne t WHERE t.track = p.track AND t.pitch = p.pitch AND abs(t.start - p.start) <= 2) AS hit FROM pe p),
      m AS (SELECT (SELECT max(amp) FROM pe p WHERE t.track = p.track AND t.pitch = p.pitch AND abs(t.start - p.start) <= 2) AS best FROM ne t),
      c AS (SELECT cut, (SELECT count(*) FROM h WHERE amp >= cut) AS predicted, (SELECT count(*) FROM h WHERE amp >= cut AND hit) AS tp, (SELECT count(*) FROM m WHERE best IS NULL OR best < cut) AS fn, (SELECT count(*) FROM ne) AS target FROM g),
      f AS (SELECT *, predicted - tp AS fp, 2 * tp / greatest(tp + predicted + fn, 1) AS f1, predicted BETWEEN 0.5 * target AND 4.0 * target AS ok FROM c)
      SELECT round(cut, 6) AS cut, predicted, tp, fp, fn, round(f1, 6) AS f1 FROM f ORDER BY ok DESC, f1 DESC, cut DESC LIMIT 1"""),
)
def o104(spark, d):
    """The best of 160 quantiles of the predicted amplitudes, and 0, by tolerant F1 within the bounds."""
    truth, predicted = (e.select("track", "pitch", F.col("start").alias("frame"), "amp") for e in (note_events(spark, d), predicted_events(spark, d)))
    return S.calibrate_tolerant(truth, predicted, 2, 0.5, 4.0)


EPOCHS = """ep AS (SELECT label AS run, (vec_id // 10)::BIGINT AS epoch, round(abs(embedding[1]::DOUBLE), 2) AS f1, round(abs(embedding[2]::DOUBLE), 2) AS precision,
  round(abs(embedding[3]::DOUBLE), 2) AS recall, floor(embedding[4]::DOUBLE * 100)::INT AS threshold FROM embeddings)"""


def _epochs(spark, d):
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select(
        F.col("label").alias("run"), F.floor(F.col("vec_id") / 10).alias("epoch"), F.round(F.abs(e[0].cast("double")), 2).alias("f1"),
        F.round(F.abs(e[1].cast("double")), 2).alias("precision"), F.round(F.abs(e[2].cast("double")), 2).alias("recall"), F.floor(e[3].cast("double") * 100).cast("int").alias("threshold"),
    )
    return rows.groupBy("run", "epoch").agg(*(F.max(c).alias(c) for c in ("f1", "precision", "recall", "threshold")))


EP = "WITH " + EPOCHS + ", e AS (SELECT run, epoch, max(f1) AS f1, max(precision) AS precision, max(recall) AS recall, max(threshold) AS threshold FROM ep GROUP BY 1, 2) "


@query("o105_best_checkpoint", EP + "SELECT run, epoch, f1, precision, recall, threshold FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC, epoch) AS k FROM e) WHERE k = 1")
def o105(spark, d):
    return S.best_checkpoint(_epochs(spark, d))


@query(
    "o106_early_stopping",
    EP + """, s AS (SELECT *, CASE WHEN f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN epoch END AS b FROM e),
    l AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch) AS lb FROM s)
    SELECT l.run, coalesce(min(epoch) FILTER (WHERE epoch - lb >= 5), max(epoch)) AS stop_epoch, any_value(m.epoch) AS best_epoch
    FROM l JOIN (SELECT run, epoch FROM (SELECT run, epoch, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS k FROM e) WHERE k = 1) m ON m.run = l.run GROUP BY l.run""".replace("max(epoch)) AS", "max(l.epoch)) AS").replace("min(epoch) FILTER (WHERE epoch - lb", "min(l.epoch) FILTER (WHERE l.epoch - lb"),
)
def o106(spark, d):
    return S.early_stop(_epochs(spark, d), 5)


@query("o107_candidate_selection", with_ctes("sc", body="," + CURVE + """, c AS (SELECT cap, member, max(f1) AS f1 FROM fc, (SELECT unnest([1.25, 1.5, 4.0]) AS cap) WHERE predicted <= cap * target GROUP BY ALL)
  SELECT cap::DOUBLE AS cap, arg_max(member, (f1, -member)) AS member, round(max(f1), 6) AS f1 FROM c GROUP BY cap"""))
def o107(spark, d):
    curve = S.threshold_curve(scores(spark, d), "member").withColumn("f1", S.f1())
    caps = curve.withColumn("cap", F.explode(F.array(*(F.lit(c) for c in (1.25, 1.5, 4.0))))).where(F.col("predicted") <= F.col("cap") * F.col("target"))
    best = caps.groupBy("cap", "member").agg(F.max("f1").alias("f1"))
    return best.groupBy("cap").agg(F.max_by("member", F.struct("f1", -F.col("member"))).alias("member"), F.round(F.max("f1"), 6).alias("f1"))


@query("o108_epoch_shuffle", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('/', 'e1', vec_id::VARCHAR)), vec_id)::INT AS place, label FROM embeddings")
def o108(spark, d):
    by = S.W.partitionBy("label").orderBy(S.order_hash(F.lit("e1"), F.col("vec_id")), "vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.row_number().over(by).alias("place"), "label")


@query("label_length_calibration", """WITH sc AS (SELECT 0 AS member, n_chars::INT AS score, quality AS truth FROM labels JOIN documents USING (doc_id)), """ + CURVE + CAL.format("predicted <= 1.5 * target"))
def o088(spark, d):
    """Which length tells good documents apart, on labelled documents."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.calibrate(rows.select(F.lit(0).alias("member"), F.col("n_chars").cast("int").alias("score"), F.col("quality").alias("truth")), 1.5, "member")




#: frames with how many pitches sound and begin in them
LABELLED = """tk AS (SELECT DISTINCT track FROM ne),
  al AS (SELECT track, unnest(range(0, 720))::INT AS frame FROM tk),
  ac AS (SELECT track, frame, count(*) AS activity FROM act GROUP BY 1, 2),
  onl AS (SELECT track, frame, count(DISTINCT pitch) AS onsets FROM (SELECT track, pitch, unnest(range(start, least(start + 2, 720)))::INT AS frame FROM ne WHERE "end" > start AND start < 720) GROUP BY 1, 2),
  st AS (SELECT track, frame, CASE WHEN coalesce(onsets, 0) > 0 THEN 0 WHEN coalesce(activity, 0) > 0 THEN 1 ELSE 2 END AS stratum FROM al LEFT JOIN ac USING (track, frame) LEFT JOIN onl USING (track, frame)),
  nr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY track, frame) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS n FROM st),
  rw AS (SELECT count(*) // 4 AS rows FROM st),
  dr AS (SELECT draw, CASE WHEN draw < round_even(rows * 0.55::DOUBLE, 0) THEN 0 WHEN draw < round_even(rows * 0.55::DOUBLE, 0) + round_even(rows * 0.35::DOUBLE, 0) THEN 1 ELSE 2 END AS stratum FROM (SELECT rows, unnest(range(0, rows)) AS draw FROM rw)),
  pk AS (SELECT draw, dr.stratum, track, frame FROM dr JOIN (SELECT stratum, max(n) AS n FROM nr GROUP BY 1) c USING (stratum)
    JOIN nr ON nr.stratum = dr.stratum AND nr.i = floor(('0x' || md5('o/' || draw)[1:13])::BIGINT / 4503599627370496.0::DOUBLE * c.n)::BIGINT)"""


@query("o100_onset_sample", with_ctes("ne", "act", body=", " + LABELLED + " SELECT (row_number() OVER (ORDER BY md5('o/place/' || draw), draw) - 1)::BIGINT AS place, track, frame, stratum FROM pk"))
def o100(spark, d):
    """A quarter as many draws as there are frames."""
    ne = note_events(spark, d)
    grid = ne.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    activity = N.rasterise(ne, FRAMES).groupBy("track", "frame").agg(F.count("*").alias("activity"))
    onsets = N.onset_labels(ne, FRAMES).groupBy("track", "frame").agg(F.count("*").alias("onsets"))
    # all grow with the events, and more than Spark's guess from the file's size
    labelled = grid.join(activity.hint("merge"), ["track", "frame"], "left").join(onsets.hint("merge"), ["track", "frame"], "left").fillna(0, ["activity", "onsets"])
    return S.onset_sample(labelled, grid.count() // 4)
