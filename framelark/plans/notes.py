"""Queries over note events, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.operators import metrics as M
from framelark.operators import notes as N
from framelark.operators.sized import small
from framelark.plans.registry import query
from framelark.sources.adapters import FRAMES, HIGH, LOW, note_events, predicted_events, with_ctes

RATES = """tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc"""
CONF = """count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE p = 1) AS predicted, count(*) FILTER (WHERE y = 1) AS target"""
RATED = """, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12), 6) AS f1"""

#: the note-state decoder on a dense grid, step by step
DENSE = """
lim AS (SELECT DISTINCT track, pitch FROM {src}),
grid AS (SELECT track, pitch, unnest(range(0, 720))::INT AS frame FROM lim),
g AS (SELECT grid.track, grid.pitch, grid.frame, (s.track IS NOT NULL)::INT AS a
      FROM grid LEFT JOIN {src} s ON s.track = grid.track AND s.pitch = grid.pitch AND s.frame = grid.frame),
e AS (SELECT *, CASE WHEN min(a) OVER w2 = 1 AND count(*) OVER w2 = 2 THEN 1
                     WHEN max(a) OVER w4 = 0 AND count(*) OVER w4 = 4 THEN 0 END AS edge
      FROM g WINDOW w2 AS (PARTITION BY track, pitch ORDER BY frame ROWS 1 PRECEDING), w4 AS (PARTITION BY track, pitch ORDER BY frame ROWS 3 PRECEDING)),
st AS (SELECT track, pitch, frame, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY track, pitch ORDER BY frame), 0) AS s FROM e),
{name} AS (SELECT track, pitch, frame FROM st WHERE s = 1)"""


@query("o056_rasterise", with_ctes("ne", "act", body="SELECT track, pitch, frame, velocity FROM act"))
def o056(spark, d):
    return N.rasterise(note_events(spark, d), FRAMES)


@query(
    "o056_onset_labels",
    with_ctes("ne", body="""SELECT DISTINCT track, pitch, frame FROM
      (SELECT track, pitch, unnest(range(start + 2, least(start + 5, 720)))::INT AS frame FROM ne WHERE "end" > start AND start < 720)"""),
)
def o056_onsets(spark, d):
    return N.onset_labels(note_events(spark, d), FRAMES, delay=2, width=3)


@query(
    "o058_event_flags",
    with_ctes("ne", body="""SELECT event_id, track, pitch, start, coalesce(pm >= start, false) AS active_previous,
      coalesce(pm >= start, false) OR coalesce(start - pe < 3, false) AS retrigger
    FROM (SELECT *, max("end") OVER (PARTITION BY track, pitch ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm,
                 max("end") OVER (PARTITION BY track, pitch ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
          FROM ne WHERE start < 720 AND "end" > start)"""),
)
def o058(spark, d):
    return N.event_flags(note_events(spark, d), FRAMES).select("event_id", "track", "pitch", "start", "active_previous", "retrigger")


@query(
    "o059_chord_flag",
    with_ctes("ne", body="""SELECT event_id, EXISTS (SELECT 1 FROM ne b WHERE b.track = a.track AND b.pitch <> a.pitch AND abs(b.start - a.start) <= 1) AS chord FROM ne a"""),
)
def o059(spark, d):
    return N.chord_flag(note_events(spark, d), 1).select("event_id", "chord")


@query(
    "o060_rising_edges",
    with_ctes("ne", "act", body="""SELECT track, pitch, frame FROM act a
      WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.track = a.track AND b.pitch = a.pitch AND b.frame = a.frame - 1)"""),
)
def o060(spark, d):
    return N.rising_edges(N.rasterise(note_events(spark, d), FRAMES))


@query("o061_note_state", with_ctes("ne", "act", body="SELECT * FROM notes").replace("SELECT * FROM notes", "," + DENSE.format(src="act", name="notes") + "\nSELECT track, pitch, frame FROM notes"))
def o061(spark, d):
    notes = N.note_state_of_runs(N.covered(note_events(spark, d), FRAMES), FRAMES)
    return N.spread(notes, F.col("on"), F.col("off"), "track", "pitch")


@query(
    "o062_retriggers",
    with_ctes("ne", body="""SELECT 1""").replace("WITH ", "WITH RECURSIVE ").replace("SELECT 1", """,
  c AS (SELECT DISTINCT track, pitch, start AS frame FROM ne WHERE "end" > start),
  k AS (SELECT track, pitch, min(frame) AS frame FROM c GROUP BY ALL
        UNION ALL
        SELECT k.track, k.pitch, (SELECT min(c.frame) FROM c WHERE c.track = k.track AND c.pitch = k.pitch AND c.frame >= k.frame + 6) AS frame
        FROM k WHERE EXISTS (SELECT 1 FROM c WHERE c.track = k.track AND c.pitch = k.pitch AND c.frame >= k.frame + 6))
  SELECT track, pitch, frame FROM k"""),
)
def o062(spark, d):
    onsets = note_events(spark, d).where('`end` > start').select("track", "pitch", F.col("start").alias("frame"))
    return N.spaced(onsets, 6)


@query(
    "o063_intervals",
    with_ctes("ne", "act", body="""SELECT track, pitch, min(frame) AS start, max(frame) + 1 AS "end"
      FROM (SELECT track, pitch, frame, frame - row_number() OVER (PARTITION BY track, pitch ORDER BY frame) AS g FROM act) GROUP BY track, pitch, g"""),
)
def o063(spark, d):
    return N.runs(N.rasterise(note_events(spark, d), FRAMES))


MIDI = """m AS (
  SELECT track, pitch, event_id, unnest([greatest("end", start + 1)::BIGINT * 960, start::BIGINT * 960]) AS tick, unnest([0, 1]) AS "on",
         unnest([0, greatest(least(round_even(amp * 127, 0), 127), 1)::INT]) AS velocity FROM ne),
mm AS (SELECT *, (row_number() OVER o)::INT AS seq, tick - coalesce(lag(tick) OVER o, 0) AS delta FROM m WINDOW o AS (PARTITION BY track ORDER BY tick, "on", pitch, event_id))"""


def _midi(body: str) -> str:
    return with_ctes("ne", body=body).replace("FROM events)", "FROM events),\n" + MIDI, 1)


@query("o015_midi_events", _midi('SELECT track, pitch, event_id, tick, "on", velocity, seq, delta FROM mm'))
def o015(spark, d):
    return N.midi_events(note_events(spark, d))


@query("o017_running_polyphony", _midi('SELECT track, seq, tick, sum(CASE WHEN "on" = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY track ORDER BY seq)::BIGINT AS polyphony FROM mm'))
def o017(spark, d):
    return N.running_polyphony(N.midi_events(note_events(spark, d))).select("track", "seq", "tick", "polyphony")


@query(
    "o066_lifecycle_audit",
    _midi("""SELECT track, sum((low < 0)::INT)::BIGINT AS orphan_voices, sum(("left" <> 0)::INT)::BIGINT AS dangling_voices, sum("left")::BIGINT AS balance,
      max(high)::BIGINT AS max_voice_depth, min(pitch) AS min_pitch, max(pitch) AS max_pitch
    FROM (SELECT track, pitch, min(dep) AS low, max(dep) AS high, sum(s) AS "left"
          FROM (SELECT track, pitch, CASE WHEN "on" = 1 THEN 1 ELSE -1 END AS s, sum(CASE WHEN "on" = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY track, pitch ORDER BY seq) AS dep FROM mm)
          GROUP BY track, pitch) GROUP BY track"""),
)
def o066(spark, d):
    return N.lifecycle_audit(N.midi_events(note_events(spark, d)))


@query(
    "o067_complexity_profile",
    with_ctes("ne", "act", body="""SELECT e.track, e.events, round(e.events * 100 / 720, 6) AS event_rate, round(coalesce(cells, 0) / 720, 6) AS mean_polyphony,
      coalesce(mx, 0) AS max_polyphony, round(coalesce(two, 0) / 720, 6) AS share_two, round(coalesce(four, 0) / 720, 6) AS share_four
    FROM (SELECT track, count(*) AS events FROM ne GROUP BY 1) e LEFT JOIN
      (SELECT track, sum(n) AS cells, max(n) AS mx, count(*) FILTER (WHERE n >= 2) AS two, count(*) FILTER (WHERE n >= 4) AS four
       FROM (SELECT track, frame, count(*) AS n FROM act GROUP BY 1, 2) GROUP BY 1) p USING (track)"""),
)
def o067(spark, d):
    ne = note_events(spark, d)
    return N.complexity_profile(ne, N.rasterise(ne, FRAMES), FRAMES)


def _sides(spark, d):
    """The runs that sound in truth and as predicted."""
    return N.covered(note_events(spark, d), FRAMES), N.covered(predicted_events(spark, d), FRAMES)


def _cells(spark, d):
    return M.cells(N.rasterise(note_events(spark, d), FRAMES), N.rasterise(predicted_events(spark, d), FRAMES))


@query("o079_confusion", with_ctes("ne", "pe", "act", "pact", "cells", body=f"SELECT pitch, {CONF} FROM cells GROUP BY pitch"))
def o079(spark, d):
    return M.interval_confusion(*_sides(spark, d), "pitch")


@query("o080_rates", with_ctes("ne", "pe", "act", "pact", "cells", body=f"SELECT * {RATED} FROM (SELECT track, {CONF} FROM cells GROUP BY track)"))
def o080(spark, d):
    return M.with_rates(M.interval_confusion(*_sides(spark, d), "track"))


@query(
    "o081_f_beta",
    with_ctes("ne", "pe", "act", "pact", "cells", body=f"""SELECT track, round(1.25 * pr * rc / greatest(0.25 * pr + rc, 1e-12), 6) AS f_half, round(5 * pr * rc / greatest(4 * pr + rc, 1e-12), 6) AS f_two
      FROM (SELECT track, {RATES} FROM (SELECT track, {CONF} FROM cells GROUP BY track))"""),
)
def o081(spark, d):
    return M.interval_confusion(*_sides(spark, d), "track").select("track", F.round(M.f_beta(0.5), 6).alias("f_half"), F.round(M.f_beta(2.0), 6).alias("f_two"))


@query(
    "o077_tolerant_presence",
    with_ctes("ne", "pe", body="""SELECT a.pitch, tp, fp, fn FROM
      (SELECT pitch, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM
        (SELECT p.pitch, EXISTS (SELECT 1 FROM ne t WHERE t.track = p.track AND t.pitch = p.pitch AND abs(t.start - p.start) <= 2) AS hit FROM pe p) GROUP BY 1) a
      JOIN (SELECT pitch, count(*) FILTER (WHERE NOT hit) AS fn FROM
        (SELECT t.pitch, EXISTS (SELECT 1 FROM pe p WHERE t.track = p.track AND t.pitch = p.pitch AND abs(t.start - p.start) <= 2) AS hit FROM ne t) GROUP BY 1) b USING (pitch)"""),
)
def o077(spark, d):
    onset = lambda e: e.select("track", "pitch", F.col("start").alias("frame"))
    return M.tolerant_presence(onset(note_events(spark, d)), onset(predicted_events(spark, d)), 2, "pitch")


NOTES = "," + DENSE.format(src="act", name="notes") + """,
  iv AS (SELECT track, pitch, min(frame) AS "on", max(frame) + 1 AS off FROM (SELECT *, frame - row_number() OVER (PARTITION BY track, pitch ORDER BY frame) AS g FROM notes) GROUP BY track, pitch, g),
  ol AS (SELECT DISTINCT track, pitch, frame FROM (SELECT track, pitch, unnest(range(start + 2, least(start + 5, 720)))::INT AS frame FROM ne WHERE "end" > start AND start < 720)),
  ri AS (SELECT o.* FROM ol o WHERE NOT EXISTS (SELECT 1 FROM ol b WHERE b.track = o.track AND b.pitch = o.pitch AND b.frame = o.frame - 1)),
  cd AS (SELECT iv.*, ri.frame FROM iv JOIN ri ON ri.track = iv.track AND ri.pitch = iv.pitch AND ri.frame > "on" AND ri.frame < off),
  k AS (SELECT track, pitch, "on", off, "on" AS frame FROM iv
        UNION ALL
        SELECT k.track, k.pitch, k."on", k.off, (SELECT min(c.frame) FROM cd c WHERE c.track = k.track AND c.pitch = k.pitch AND c."on" = k."on" AND c.frame >= k.frame + 6) AS frame
        FROM k WHERE EXISTS (SELECT 1 FROM cd c WHERE c.track = k.track AND c.pitch = k.pitch AND c."on" = k."on" AND c.frame >= k.frame + 6))"""


def _note_ons(spark, d):
    ne = note_events(spark, d)
    return N.note_ons(N.note_state(N.rasterise(ne, FRAMES), FRAMES), N.onset_labels(ne, FRAMES, delay=2, width=3), 6)


@query("o062_note_ons", with_ctes("ne", "act", body="@").replace("WITH ", "WITH RECURSIVE ", 1).replace("@", NOTES + ' SELECT track, pitch, frame::INT AS frame, frame > "on" AS retrigger FROM k'))
def o062_note_ons(spark, d):
    return _note_ons(spark, d).select("track", "pitch", "frame", "retrigger")


#: notes in the rolls of all events: runs of activity, cut at rising onsets
SEGMENTS = """,
  rn AS (SELECT track, pitch, min(frame) AS start, max(frame) + 1 AS "end" FROM (SELECT *, frame - row_number() OVER (PARTITION BY track, pitch ORDER BY frame) AS g FROM act) GROUP BY track, pitch, g),
  oo AS (SELECT DISTINCT track, pitch, frame FROM (SELECT track, pitch, unnest(range(start, least(start + 2, 720)))::INT AS frame FROM ne WHERE "end" > start AND start < 720)),
  ro AS (SELECT * FROM oo o WHERE NOT EXISTS (SELECT 1 FROM oo b WHERE b.track = o.track AND b.pitch = o.pitch AND b.frame = o.frame - 1)),
  cu AS (SELECT track, pitch, start AS run, "end", start AS frame FROM rn UNION ALL SELECT rn.track, rn.pitch, rn.start, rn."end", ro.frame FROM rn JOIN ro ON ro.track = rn.track AND ro.pitch = rn.pitch AND ro.frame > rn.start AND ro.frame < rn."end"),
  sg AS (SELECT track, pitch, frame AS start, coalesce(lead(frame) OVER (PARTITION BY track, pitch, run ORDER BY frame), "end") AS "end" FROM cu)"""


@query(
    "o014_midi_of_notes",
    with_ctes("ne", "act", body="@").replace("WITH ", "WITH RECURSIVE ", 1).replace("@", NOTES + SEGMENTS + """,
  sn AS (SELECT track, pitch, frame AS start, coalesce(lead(frame) OVER (PARTITION BY track, pitch, "on" ORDER BY frame), off) AS "end" FROM k),
  nt AS (SELECT track, pitch, start, "end", 'raw' AS roll FROM sg UNION ALL SELECT track, pitch, start, "end", 'stable' AS roll FROM sn),
  ms AS (SELECT track, pitch, unnest([round_even("end" * (256 / 22050::DOUBLE) * 960, 0)::BIGINT, round_even(start * (256 / 22050::DOUBLE) * 960, 0)::BIGINT]) AS tick, unnest([0, 1]) AS "on", unnest([0, 80]) AS velocity, roll FROM nt)
  SELECT track, pitch, tick, "on", velocity, (row_number() OVER (PARTITION BY track ORDER BY roll, tick, "on", pitch))::INT AS seq,
    tick - coalesce(lag(tick) OVER (PARTITION BY track, roll ORDER BY tick, "on", pitch), 0) AS delta, roll FROM ms"""),
)
def o014(spark, d):
    """The MIDI messages of all events, raw (every sounding frame) and stable (the notes that the note state makes of them)."""
    ne = note_events(spark, d)
    raw = N.segments(N.rasterise(ne, FRAMES), N.onset_labels(ne, FRAMES))
    return N.midi_of_rolls({"raw": raw, "stable": N.sounded(_note_ons(spark, d))})


@query(
    "o057_classified_events",
    with_ctes("ne", body=""", k AS (SELECT * FROM ne WHERE start < 720 AND "end" > start)
      SELECT event_id, track, pitch, start, "end",
        coalesce((SELECT max(b."end") >= k.start FROM k b WHERE b.track = k.track AND b.pitch = k.pitch AND b.start < k.start), false) AS active_previous,
        coalesce((SELECT max(b."end") >= k.start FROM k b WHERE b.track = k.track AND b.pitch = k.pitch AND b.start < k.start), false)
          OR coalesce((SELECT k.start - max(b."end") < 3 FROM k b WHERE b.track = k.track AND b.pitch = k.pitch AND (b.start, b."end", b.event_id) < (k.start, k."end", k.event_id)), false) AS retrigger,
        EXISTS (SELECT 1 FROM k b WHERE b.track = k.track AND b.pitch <> k.pitch AND b.start = k.start) AS chord FROM k"""),
)
def o057(spark, d):
    """The events of an evaluation with their classes; unsound rows fail it."""
    ne = note_events(spark, d)
    bad = N.evaluation_violations(ne, LOW, HIGH)
    sound = ne.join(small(bad.groupBy().agg(F.count("*").alias("bad"))), F.lit(True)).withColumn("ok", F.when(F.col("bad") == 0, True).otherwise(F.raise_error(F.lit("events of the evaluation are not sound")).cast("boolean"))).where("ok")
    return N.classified_events(sound, FRAMES).select("event_id", "track", "pitch", "start", "end", "active_previous", "retrigger", "chord")


#: one-to-one matches: two pointers go through the onsets of a voice, in order of frame and id
MATCHES = """,
  vt AS (SELECT track, pitch, list({'f': start, 'id': event_id} ORDER BY start, event_id) AS t FROM ne WHERE "end" > start GROUP BY ALL),
  vp AS (SELECT track, pitch, list({'f': start, 'id': event_id} ORDER BY start, event_id) AS p FROM pe WHERE "end" > start GROUP BY ALL),
  st AS (SELECT vt.track, vt.pitch, tol, t, p, 1 AS i, 1 AS j, false AS hit, 0::BIGINT AS target_id, 0::BIGINT AS predicted_id, 0::BIGINT AS error FROM vt JOIN vp ON vt.track = vp.track AND vt.pitch = vp.pitch, (SELECT unnest([0, 1, 2, 4])::INT AS tol)
    UNION ALL
    SELECT track, pitch, tol, t, p, CASE WHEN p[j].f < t[i].f - tol THEN i ELSE i + 1 END, CASE WHEN p[j].f > t[i].f + tol THEN j ELSE j + 1 END,
      abs(p[j].f - t[i].f) <= tol, t[i].id, p[j].id, p[j].f - t[i].f FROM st WHERE i <= len(t) AND j <= len(p)),
  mt AS (SELECT track, pitch, tol AS tolerance, target_id, predicted_id, error FROM st WHERE hit)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("o076_onset_matching", _recursive(with_ctes("ne", "pe", body="@").replace("@", MATCHES + " SELECT * FROM mt")))
def o076(spark, d):
    onset = lambda e: e.where("`end` > start").select("track", "pitch", F.col("start").alias("frame"), F.col("event_id").alias("id"))
    return M.match_onsets(onset(note_events(spark, d)), onset(predicted_events(spark, d)), [0, 1, 2, 4])


TOLERANCES = [0, 1, 2, 4]


@query(
    "o085_event_metrics",
    _recursive(with_ctes("ne", "pe", body="@")).replace("@", MATCHES + """,
  k AS (SELECT * FROM ne WHERE start < 720 AND "end" > start),
  fl AS (SELECT event_id, pitch,
        coalesce((SELECT max(b."end") >= k.start FROM k b WHERE b.track = k.track AND b.pitch = k.pitch AND b.start < k.start), false) AS active_previous,
        coalesce((SELECT k.start - max(b."end") < 3 FROM k b WHERE b.track = k.track AND b.pitch = k.pitch AND (b.start, b."end", b.event_id) < (k.start, k."end", k.event_id)), false) AS near,
        EXISTS (SELECT 1 FROM k b WHERE b.track = k.track AND b.pitch <> k.pitch AND b.start = k.start) AS chord FROM k),
  su AS (SELECT event_id, unnest(list_filter(['all', CASE WHEN pitch <= 41 THEN 'low' END, CASE WHEN active_previous OR near THEN 'retrigger' END, CASE WHEN active_previous THEN 'active_previous' END, CASE WHEN chord THEN 'chord' ELSE 'single' END], lambda x: x IS NOT NULL)) AS subset FROM fl),
  gr AS (SELECT subset, tolerance FROM (SELECT unnest(['all', 'low', 'retrigger', 'active_previous', 'chord', 'single']) AS subset), (SELECT unnest([0, 1, 2, 4])::INT AS tolerance)),
  ct AS (SELECT gr.subset, gr.tolerance, (SELECT count(*) FROM su WHERE su.subset = gr.subset) AS targets,
      (SELECT count(*) FROM su JOIN mt ON mt.target_id = su.event_id AND mt.tolerance = gr.tolerance WHERE su.subset = gr.subset) AS tp,
      (SELECT round(avg(abs(error)), 6) FROM su JOIN mt ON mt.target_id = su.event_id AND mt.tolerance = gr.tolerance WHERE su.subset = gr.subset) AS mean_abs_error,
      CASE gr.subset WHEN 'all' THEN (SELECT count(*) FROM pe WHERE "end" > start) WHEN 'low' THEN (SELECT count(*) FROM pe WHERE "end" > start AND pitch <= 41) END AS predicted FROM gr),
  rt AS (SELECT *, predicted - tp AS fp, targets - tp AS fn, CASE WHEN predicted IS NOT NULL THEN tp / greatest(predicted, 1) END AS pr, tp / greatest(targets, 1) AS re FROM ct)
  SELECT subset, tolerance, tp, mean_abs_error, targets, predicted, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr IS NOT NULL THEN 2 * pr * re / greatest(pr + re, 1e-12) END, 6) AS f1 FROM rt"""),
)
def o085(spark, d):
    """Per tolerance: counts and rates of all and of low events, recall of flagged subsets."""
    flagged = N.classified_events(note_events(spark, d), FRAMES)
    predicted = predicted_events(spark, d).where("`end` > start").select("event_id", "pitch")
    return M.event_metrics(flagged, predicted, o076(spark, d), 41, TOLERANCES)


ROLLS = """,
  ot AS (SELECT DISTINCT track, pitch, frame FROM (SELECT track, pitch, unnest(range(start, least(start + 2, 720)))::INT AS frame FROM ne WHERE "end" > start AND start < 720)),
  op AS (SELECT DISTINCT track, pitch, frame FROM (SELECT track, pitch, unnest(range(start, least(start + 2, 720)))::INT AS frame FROM pe WHERE "end" > start AND start < 720)),
  oc AS (SELECT coalesce(a.track, p.track) AS track, (a.track IS NOT NULL)::INT AS y, (p.track IS NOT NULL)::INT AS p FROM ot a FULL JOIN op p ON a.track = p.track AND a.pitch = p.pitch AND a.frame = p.frame)"""
_RATE = """round(tp / greatest(tp + fp, 1), 6) AS {0}_precision, round(tp / greatest(tp + fn, 1), 6) AS {0}_recall,
  round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12), 6) AS {0}_f1"""
_NEAR = """(SELECT track, {1} FROM (SELECT track, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT track, (hit)::INT AS tp, (NOT hit)::INT AS fp, 0 AS fn FROM (SELECT p.track, EXISTS (SELECT 1 FROM ot t WHERE t.track = p.track AND t.pitch = p.pitch AND abs(t.frame - p.frame) <= {0}) AS hit FROM op p)
    UNION ALL SELECT track, 0, 0, (NOT hit)::INT FROM (SELECT t.track, EXISTS (SELECT 1 FROM op p WHERE t.track = p.track AND t.pitch = p.pitch AND abs(t.frame - p.frame) <= {0}) AS hit FROM ot t)) GROUP BY track))"""


@query(
    "o083_polyphonic_metrics",
    with_ctes("ne", "pe", "act", "pact", "cells", body=ROLLS + f"""
    SELECT * FROM (SELECT track, count(*) FILTER (WHERE t >= 2) AS chord_frames,
      round(coalesce(avg(b / t) FILTER (WHERE t >= 2), 0), 6) AS chord_pitch_recall,
      round(coalesce(avg((b = t)::INT) FILTER (WHERE t >= 2), 0), 6) AS chord_complete_rate,
      round(sum(t) / 720, 6) AS target_polyphony, round(sum(q) / 720, 6) AS predicted_polyphony
    FROM (SELECT track, frame, sum(y) AS t, sum(p) AS q, sum(y * p) AS b FROM cells GROUP BY 1, 2) GROUP BY track)
    LEFT JOIN (SELECT track, {_RATE.format("activity")} FROM (SELECT track, {CONF} FROM cells GROUP BY track)) USING (track)
    LEFT JOIN (SELECT track, {_RATE.format("onset")} FROM (SELECT track, {CONF} FROM oc GROUP BY track)) USING (track)
    """ + " ".join(f"LEFT JOIN {_NEAR.format(r, _RATE.format(f'onset_within_{r}'))} USING (track)" for r in M.RADII)),
)
def o083(spark, d):
    truth, predicted = (N.onset_labels(e, FRAMES, delay=0, width=2) for e in (note_events(spark, d), predicted_events(spark, d)))
    return M.polyphonic_metrics(_cells(spark, d), M.cells(truth, predicted), truth, predicted, FRAMES)


@query(
    "o084_by_polyphony",
    with_ctes("ne", "pe", "act", "pact", "cells", body=f"""SELECT bucket, {CONF} FROM (
      SELECT y, p, unnest(list_filter(['all', CASE WHEN n >= 4 THEN '4+' ELSE n::VARCHAR END, CASE WHEN n = 1 THEN 'single' END, CASE WHEN n >= 2 THEN 'polyphonic' END,
        CASE WHEN pitch <= 41 THEN 'low' END], lambda x: x IS NOT NULL)) AS bucket
      FROM (SELECT *, sum(y) OVER (PARTITION BY track, frame)::INT AS n FROM cells)) GROUP BY bucket"""),
)
def o084(spark, d):
    return M.by_polyphony(_cells(spark, d), 41)


@query(
    "o086_micro_rollup",
    with_ctes("ne", "pe", "act", "pact", "cells", body=f"SELECT * {RATED} FROM (SELECT track % 5 AS source, track, {CONF} FROM cells GROUP BY ROLLUP (track % 5, track))"),
)
def o086(spark, d):
    per = M.interval_confusion(*_sides(spark, d), "track").withColumn("source", F.pmod("track", F.lit(5)))  # summed once, then rolled up
    sums = per.rollup("source", "track").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "predicted", "target")))
    return M.with_rates(sums)


@query(
    "o087_macro_micro",
    with_ctes("ne", "pe", "act", "pact", "cells", body=f"""SELECT source, round(avg(f1), 6) AS macro_f1,
      round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 6) AS micro_f1, count(*) AS tracks
    FROM (SELECT *, 2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12) AS f1
      FROM (SELECT track % 5 AS source, track, {CONF} FROM cells GROUP BY ALL)) GROUP BY source"""),
)
def o087(spark, d):
    per = M.interval_confusion(*_sides(spark, d), "track").withColumn("source", F.pmod("track", F.lit(5))).withColumn("f1", M.f_beta())
    micro = 2 * F.sum("tp") / F.greatest(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(1))
    return per.groupBy("source").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(micro, 6).alias("micro_f1"), F.count("*").alias("tracks"))


@query(
    "note_state_f1",
    with_ctes("ne", "act", body="@").replace("@", "," + DENSE.format(src="act", name="notes") + f"""
  SELECT * {RATED} FROM (SELECT pitch, {CONF} FROM (
    SELECT coalesce(a.pitch, n.pitch) AS pitch, (a.track IS NOT NULL)::INT AS y, (n.track IS NOT NULL)::INT AS p
    FROM act a FULL JOIN notes n ON a.track = n.track AND a.pitch = n.pitch AND a.frame = n.frame) GROUP BY pitch)"""),
)
def note_state_f1(spark, d):
    """Per pitch: how well the causal note-state decoder reproduces the activity it is fed."""
    sounding = N.covered(note_events(spark, d), FRAMES)
    state = N.note_state_of_runs(sounding, FRAMES).select("track", "pitch", F.col("on").alias("start"), F.col("off").alias("end"))
    return M.with_rates(M.interval_confusion(sounding, state, "pitch"))


LABELS = """lb AS (SELECT event_id, track AS ref, start * 0.25::DOUBLE AS s, "end" * 0.25::DOUBLE AS e, pitch, least(greatest(round_even(amp * 150, 0), 1), 127)::INT AS v, CASE WHEN event_id % 8 <= 5 THEN event_id % 8 ELSE 0 END AS channel FROM ne WHERE "end" > start),
  le AS (SELECT ref, unnest([s, e]) AS seconds, unnest([1, 0]) AS "on", channel, pitch, unnest([v, 0]) AS velocity FROM lb)"""
TEMPO = """tm AS (SELECT event_id, track AS ref, start % 7 AS delta, CASE WHEN pitch = 41 THEN 400000 + 1000 * (event_id % 300) END AS tempo, pitch, amp FROM ne),
  ts AS (SELECT *, sum((delta * before)::BIGINT) OVER (PARTITION BY ref ORDER BY event_id)::DOUBLE / 480e6::DOUBLE AS seconds FROM (SELECT *, coalesce(last_value(tempo IGNORE NULLS) OVER (PARTITION BY ref ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 500000) AS before FROM tm)),
  te AS (SELECT ref, seconds, (pitch < 44 AND round_even(amp * 127, 0) > 0)::INT AS "on", 0 AS channel, pitch, CASE WHEN pitch < 44 THEN round_even(amp * 127, 0)::INT ELSE 0 END AS velocity FROM ts WHERE tempo IS NULL)"""
ABSOLUTE = """ab AS (SELECT ref, greatest(round_even(seconds * 960, 0), 0)::BIGINT AS tick, "on", channel, pitch, velocity FROM {0} WHERE pitch BETWEEN 40 AND 43)
  SELECT ref, tick, "on", channel, pitch, velocity, row_number() OVER o::INT AS seq, tick - coalesce(lag(tick) OVER o, 0) AS delta FROM ab WINDOW o AS (PARTITION BY ref ORDER BY tick, "on", channel, pitch, velocity)"""


def _labels(spark, d):
    ne = note_events(spark, d)
    return N.label_events(ne.select(F.col("track").alias("ref"), (F.col("start") * 0.25).alias("start"), (F.col("end") * 0.25).alias("end"), F.col("pitch").alias("midi"), (F.col("amp") * 150).alias("velocity"), F.pmod("event_id", F.lit(8)).alias("string")))


def _tempo(spark, d):
    ne = note_events(spark, d)
    tempo = F.when(F.col("pitch") == 41, 400_000 + 1000 * F.pmod("event_id", F.lit(300)))
    rows = ne.select(F.col("track").alias("ref"), F.col("event_id").alias("seq"), F.pmod("start", F.lit(7)).alias("delta"), tempo.alias("tempo"), F.when(tempo.isNull(), (F.col("pitch") < 44).cast("int")).alias("on"), F.lit(0).alias("channel"), "pitch", F.rint(F.col("amp") * 127).cast("int").alias("velocity"))
    return N.tempo_events(rows, 480)


@query("o018_absolute_midi", with_ctes("ne", body=", " + TEMPO + ", " + ABSOLUTE.format("te")))
def o018(spark, d):
    return N.absolute_messages(_tempo(spark, d), 40, 43)


@query("o019_label_messages", with_ctes("ne", body=", " + LABELS + ", " + ABSOLUTE.format("le")))
def o019(spark, d):
    return N.absolute_messages(_labels(spark, d), 40, 43)


@query(
    "o020_reference_router",
    with_ctes("ne", body=", " + LABELS + ", " + TEMPO + """ SELECT ref, kind, count(*) AS messages, round(max(seconds), 6) AS last FROM (
      SELECT ref, 'labels-tsv' AS kind, seconds FROM le WHERE ref % 3 = 0 UNION ALL SELECT ref, 'absolute-midi', seconds FROM te WHERE ref % 3 = 1) GROUP BY 1, 2"""),
)
def o020(spark, d):
    """References by kind: labels for every third track, MIDI with a tempo map for the next; the last kind has no source."""
    plan = note_events(spark, d).select(F.col("track").alias("ref")).distinct()
    plan = plan.withColumn("kind", F.when(F.pmod("ref", F.lit(3)) == 0, "labels-tsv").when(F.pmod("ref", F.lit(3)) == 1, "absolute-midi").otherwise("events-tsv"))
    rows = N.routed(plan, {"labels-tsv": _labels(spark, d), "absolute-midi": _tempo(spark, d)})
    return rows.groupBy("ref", "kind").agg(F.count("*").alias("messages"), F.round(F.max("seconds"), 6).alias("last"))


@query("o065_all_notes_off", _midi('SELECT track, pitch, 345600::BIGINT AS tick, 0 AS "on", 0 AS velocity FROM mm WHERE tick <= 345600 GROUP BY track, pitch HAVING arg_max("on", seq) = 1'))
def o065(spark, d):
    return N.all_notes_off(N.midi_events(note_events(spark, d)), 360 * 960)
