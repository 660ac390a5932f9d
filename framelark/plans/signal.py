"""Queries over signals built from the embeddings: a track's vectors, one after the other, are its samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.functions import dsp
from framelark.operators import blocks as B
from framelark.operators import frontend as A
from framelark.operators import features as X
from framelark.operators import signal as G
from framelark.operators import tracker
from framelark.plans.registry import query
from framelark.sources.adapters import features, table

AUDIO = """WITH a AS (SELECT vec_id % 10 AS track, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS k FROM embeddings),
s AS (SELECT track, v, row_number() OVER (PARTITION BY track ORDER BY vec_id, k) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM a)"""


def signal(spark, d):
    """track, block, samples: ten signals in blocks of 256 vectors (ids without a gap); a row is bounded, however long a signal is."""
    x = table(spark, d, "embeddings")
    number = F.floor(F.col("vec_id") / 10)
    own = x.select(F.pmod("vec_id", F.lit(10)).alias("track"), F.floor(number * 64 / B.SPAN).alias("block"), number.alias("number"), "embedding")
    rows = own.groupBy("track", "block").agg(F.array_sort(F.collect_list(F.struct("number", "embedding"))).alias("v"))
    return rows.select("track", "block", F.flatten(F.transform("v", lambda r: r["embedding"])).alias("samples"))


@query(
    "o025_causal_framing",
    AUDIO + """, f AS (SELECT DISTINCT track, unnest(range(0, ((n + 255) // 256)::BIGINT)) AS frame FROM s)
    SELECT f.track, f.frame, round(sum(v * v), 5) AS energy FROM f JOIN s ON s.track = f.track AND i <= f.frame * 256 AND i > f.frame * 256 - 2048 GROUP BY ALL""",
)
def o025(spark, d):
    return G.framed(B.with_halo(signal(spark, d), G.FFT - 1)).select("track", "frame", F.round(G.energy(F.transform("x", lambda v: v.cast("double"))), 5).alias("energy"))


@query("o026_spectral_peaks")
def o026(spark, d):
    mag = G.spectra(B.with_halo(signal(spark, d), G.FFT - 1))
    top = F.array_max("magnitude")
    return mag.select("track", "frame", (F.array_position("magnitude", top) - 1).alias("bin"), F.round(top, 6).alias("peak"), F.round(G.energy(F.col("magnitude")), 6).alias("energy"))


def _resampled_sql(rate: int, up: int, down: int) -> str:
    """The filter's kernels from their formula, and the sum of products for each output."""
    return AUDIO + f""", ph AS (SELECT unnest(range(0, {up}))::INT AS phase), tp AS (SELECT unnest(range(0, 257))::INT AS tap),
    io AS (SELECT tap, list_sum(list_transform(range(0, 60), lambda k: exp(2 * (k * ln(greatest(8.6 * sqrt(1 - pow((tap - 128) / 128.0::DOUBLE, 2)) / 2, 1e-300)) - lgamma(k + 1))))) AS w FROM tp),
    kn AS (SELECT phase, tap, w * CASE WHEN t = 0 THEN 2 * c ELSE sin(2 * pi() * c * t) / (pi() * t) END AS h
           FROM (SELECT phase, tap, w, 128 - phase / {up}.0::DOUBLE - tap AS t, 10512.5 / {rate}::DOUBLE AS c FROM ph, io)),
    kz AS (SELECT phase, tap, h / sum(h) OVER (PARTITION BY phase) AS h FROM kn),
    o AS (SELECT track, unnest(range(0, ((max(n) * {up} + {down - 1}) // {down})::BIGINT)) AS m FROM s GROUP BY track),
    y AS (SELECT o.track, o.m, sum(kz.h * s.v) AS y FROM o JOIN kz ON kz.phase = (o.m * {down}) % {up} JOIN s ON s.track = o.track AND s.i = (o.m * {down}) // {up} - kz.tap GROUP BY ALL)
    SELECT track, m // 16384 AS block, count(*) AS n, round(sum(y * y), 2) AS energy FROM y GROUP BY ALL"""


def _resampled(spark, d, rate):
    y = B.resample(signal(spark, d), rate)
    return y.select("track", "block", F.size("samples").cast("long").alias("n"), F.round(G.energy(F.transform("samples", lambda v: v.cast("double"))), 2).alias("energy"))


@query("o042_causal_resampling", _resampled_sql(44_100, 1, 2))
def o042(spark, d):
    return _resampled(spark, d, 44_100)


@query("o042_resampling_147_320", _resampled_sql(48_000, 147, 320))
def o042_rational(spark, d):
    return _resampled(spark, d, 48_000)


@query("o037_acoustic_evidence")
def o037(spark, d):
    """Evidence for every pitch and frame of the signals."""
    x = A.evidence(B.with_halo(signal(spark, d), A.DualResolution().halo))
    columns = ("activity", "onset", "attack", "fundamental")
    each = x.select("track", "frame", F.posexplode(F.arrays_zip(*columns)).alias("k", "e"))
    return each.select("track", "frame", (F.col("k") + A.LOW).alias("pitch"), *(F.round(F.col("e")[c].cast("double"), 6).alias(c) for c in columns))


@query("o031_pitch_profile")
def o031_all(spark, d):
    """Each harmonic's own contrast, and the contrast of each pitch, for all pitches and frames of the signals."""
    f = A.PitchFeatures(every_harmonic=True, profile=True)
    n = len(f.pitches)
    x = B.features(B.with_halo(signal(spark, d), f.halo), f).select("track", "frame", "x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
    profile = F.transform(F.sequence(F.lit(0), F.lit(f.harmonics - 1)), lambda h: F.round(F.get(F.col("x"), (h + len(A.GROUPS)) * n + F.col("p")).cast("double"), 6))
    return x.select("track", "frame", (F.col("p") + f.low).alias("pitch"), F.round(F.get("x", 2 * n + F.col("p")).cast("double"), 6).alias("contrast"), profile.alias("profile"))


@query("o136_causal_dataset")
def o136(spark, d):
    """Literals of the signals, as words, with thresholds at the quantiles of their own features."""
    f = A.PitchFeatures()
    cut = B.with_halo(signal(spark, d), f.halo)
    return A.literals(cut, A.fit_thermometer(B.features(cut, f), A.CONTEXT), f)


@query("o064_note_tracking")
def o064(spark, d):
    """The thirds of a vector as the activity, onset and attack of 21 pitches."""
    x = features(spark, d)
    part = lambda lo: F.transform(F.slice("x", lo, 21), lambda v: F.abs(v))
    evidence = x.select("track", "frame", part(1).alias("activity"), part(22).alias("onset"), part(43).alias("attack"))
    return tracker.track(evidence, 40)


@query("o117_clause_training")
def o117(spark, d):
    rows = table(spark, d, "embeddings")
    bits = F.array_compact(F.transform("embedding", lambda v, i: F.when(v >= 0, i)))
    members = [{"member": m, "clauses": 10, "threshold": 5, "s": 3.0 + m, "epochs": 2, "seed": 42 + 9973 * m} for m in range(3)]
    return G.train_clauses(rows.select((F.col("label") == 3).cast("int").alias("y"), bits.alias("literals"), "vec_id"), members, 64)


@query("o118_counter_random")
def o118(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return rows.select("vec_id", F.round(G.uniform64(F.lit(7).cast("long"), F.col("vec_id"), F.col("label").cast("long")), 12).alias("u"))


@query(
    "o036_feature_dimension",
    """WITH x AS (SELECT vec_id % 10 AS track, vec_id AS frame, unnest(range(0, 64))::INT AS d, unnest(embedding)::DOUBLE AS v FROM embeddings),
    k AS (SELECT unnest([0, 1, 2, 4, 8, 16, 32])::INT AS delay, unnest(range(0, 7))::INT AS slot),
    r AS (SELECT *, row_number() OVER (PARTITION BY track, d ORDER BY frame DESC) AS left_over FROM x)
    SELECT (slot * 64 + d)::INT AS idx, 'x' || d || ':delay_' || delay AS name, d, delay, round(coalesce(sum(v) FILTER (WHERE left_over > delay), 0) / (SELECT count(*) FROM embeddings), 6) AS mean
    FROM r, k GROUP BY slot, d, delay""",
)
def o036(spark, d):
    """Names and order of the lag-stacked columns, with each column's mean over all frames."""
    stacked = X.lag_stack(features(spark, d), 64).select(F.posexplode("ctx").alias("idx", "v"))
    means = stacked.groupBy("idx").agg(F.round(F.avg("v"), 6).alias("mean"))
    column, delay = (F.col("idx") % 64).cast("int"), F.element_at(F.array(*map(F.lit, X.LAGS)), F.floor(F.col("idx") / 64).cast("int") + 1)
    return means.select("idx", F.concat(F.lit("x"), column, F.lit(":delay_"), delay).alias("name"), column.alias("d"), delay.alias("delay"), "mean")


@query("o032_subharmonic_margin", "SELECT vec_id, round(least(greatest(embedding[20]::DOUBLE - least(greatest((20 * log10(greatest(abs(embedding[10]::DOUBLE), 1e-7)) + 100) / 100, 0), 1) + 0.5, 0), 1), 6) AS margin FROM embeddings")
def o032(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(dsp.centred(e[19] - dsp.unit_db(F.abs(e[9]))), 6).alias("margin"))


@query("o046_confidence_blend", "SELECT vec_id, round(0.4 * embedding[1]::DOUBLE + 0.6 * embedding[2]::DOUBLE, 6) AS blend FROM embeddings")
def o046(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(dsp.blend(e[0], e[1], 0.6), 6).alias("blend"))
