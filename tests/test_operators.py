"""Operators on literal fixtures, file round trips and streaming twins."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import ensemble as E
from framelark.operators import features as X
from framelark.operators import metrics as M
from framelark.operators import notes as N
from framelark.operators import selection as S
from framelark.sources import files
from framelark.streaming import causal


def roll(spark, frames, pitch=40):
    return spark.createDataFrame([(0, pitch, f) for f in frames], "track long, pitch int, frame int")


def state(spark, frames, total, a, b):
    notes = N.note_state(roll(spark, frames), total, a, b).orderBy("on").collect()
    return [(r.on, r.off) for r in notes]


def test_note_state_fixtures(spark):
    assert state(spark, [0, 3, 4, 5, 6, 9, 10, 11], 14, 2, 3) == [(4, 14)]
    assert state(spark, [0, 1, 2, 3], 10, 1, 3) == [(0, 6)]


def test_note_state_against_a_frame_by_frame_decoder(spark):
    rnd, rows, want = random.Random(3), [], set()
    for track in range(60):
        sounding, on, off = False, 0, 0
        for f in range(40):
            a = rnd.random() < 0.45
            rows += [(track, 40, f)] if a else []
            on, off = (on + 1, 0) if a else (0, off + 1)
            if not sounding and on >= 2:
                sounding = True
            elif sounding and off >= 4:
                sounding = False
            if sounding:
                want.add((track, f))
    table = spark.createDataFrame(rows, "track long, pitch int, frame int")
    got = N.spread(N.note_state(table, 40, 2, 4), F.col("on"), F.col("off"), "track", "pitch").collect()
    assert {(r.track, r.frame) for r in got} == want


def test_spacing(spark):
    got = N.spaced(roll(spark, [0, 2, 3, 5, 6, 7, 12]), 3).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 3, 6, 12]


def test_onset_matching(spark):
    rnd = random.Random(1)
    a = [(0, 40, rnd.randrange(60), i) for i in range(20)]
    b = [(0, 40, rnd.randrange(60), i) for i in range(25)]
    schema = "track long, pitch int, frame int, id long"
    got = M.match_onsets(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), [0, 2]).collect()

    def best(tolerance):  # augmenting paths
        owner = {}

        def take(x, seen):
            for j, y in enumerate(b):
                if j not in seen and abs(y[2] - a[x][2]) <= tolerance:
                    seen.add(j)
                    if j not in owner or take(owner[j], seen):
                        owner[j] = x
                        return True
            return False

        return sum(take(x, set()) for x in range(len(a)))

    for t in (0, 2):
        mine = [r for r in got if r.tolerance == t]
        assert len(mine) == best(t) == len({r.target_id for r in mine}) == len({r.predicted_id for r in mine})


def test_calibration_fixtures(spark):
    scores = [(0, s, int(i in (0, 2, 5))) for i, s in enumerate([5, 4, 3, 2, 1, 4, 0, -1])]
    got = S.calibrate(spark.createDataFrame(scores, "member int, score int, truth int"), 1.5, "member").first()
    assert (got.threshold, got.tp, got.fp, got.fn) == (3, 3, 1, 0)
    flat = S.calibrate(spark.createDataFrame([(0, 7, 0)] * 4, "member int, score int, truth int"), 4.0, "member").first()
    assert (flat.threshold, flat.tp) == (8, 0)


def test_fusion_fixture(spark):
    rows = [(m, 0, p, float(z)) for m, zs in enumerate([[2, -2], [-1, 3], [-2, -1]]) for p, z in enumerate(zs)]
    table = spark.createDataFrame(rows, "member int, frame int, pitch int, z float")
    pick = lambda rule: [r.fused for r in E.fuse(table, rule).orderBy("pitch").collect()]
    assert pick("max") == [2, 3] and pick("top2_mean") == [0.5, 1.0]


def test_packing_round_trip(spark):
    bits = spark.createDataFrame([(0, 0, k) for k in (0, 1, 62, 63, 64, 127)], "track long, frame long, literal int")
    assert sorted(r.literal for r in X.unpack(X.pack(bits)).collect()) == [0, 1, 62, 63, 64, 127]


def test_ulps(spark):
    a = np.float32(1.5)
    b = np.nextafter(a, np.float32(2))
    row = spark.createDataFrame([(float(a), float(b))], "a float, b float")
    assert row.select(X.ulp_equal(F.col("a"), F.col("b"), F.lit(1))).first()[0]
    assert not row.select(X.ulp_equal(F.col("a"), F.col("b"), F.lit(0))).first()[0]


def wav(path, rate, samples):
    body = b"".join(struct.pack("<hh", int(s * 32767), 0) for s in samples)
    path.write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", len(body)) + body)


def test_wav_and_resampling(spark, tmp_path):
    t = np.arange(4410) / 44100
    wav(tmp_path / "a.wav", 44100, 0.5 * np.sin(2 * np.pi * 440 * t))
    raw = files.read_wav(spark, str(tmp_path / "a.wav")).first()
    assert raw.sample_rate == 44100 and len(raw.samples) == 4410
    low = files.read_wav(spark, str(tmp_path / "a.wav"), 22050).first()
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(2205) / 22050)
    assert len(low.samples) == 2205 and np.abs(np.array(low.samples) - want)[100:-100].max() < 2e-3


def test_posteriors(spark, tmp_path):
    x = np.arange(3 * 440, dtype=np.uint32).astype(np.uint8)
    (tmp_path / "p.bin").write_bytes(bytes(256) + x.tobytes())
    rows = files.read_posteriors(spark, str(tmp_path / "p.bin")).orderBy("frame").collect()
    assert len(rows) == 3 and rows[1].notes[0] == pytest.approx(x[440] / 255) and len(rows[2].contours) == 264


def test_midi_round_trip(spark, tmp_path):
    events = spark.createDataFrame([(1, 0, 52, 96, 288, 0.5), (2, 0, 52, 288, 480, 1.0)], "event_id long, track long, pitch int, start int, end int, amp double")
    content = files.midi_files(N.midi_events(events, rate=1)).first().content
    (tmp_path / "t.mid").write_bytes(bytes(content))
    got = files.read_midi(spark, str(tmp_path / "t.mid")).orderBy("tick", "on").collect()
    assert [(r.tick, r.on, r.velocity) for r in got] == [(96, 1, 64), (288, 0, 0), (288, 1, 127), (480, 0, 0)]
    assert got[0].seconds == pytest.approx(0.1)


def test_score_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f, p, f * 10 - p) for f in range(4) for p in (40, 41)], "frame int, pitch int, score int")
    files.write_scores(rows.coalesce(1), str(tmp_path / "s"), [40, 41])
    back = files.read_scores(spark, str(tmp_path / "s"), [40, 41])
    assert back.exceptAll(rows).count() == 0 and files.score_violations(back).count() == 0
    assert files.score_violations(back.where("frame <> 1")).count() == 2


def run_stream(spark, tmp_path, name, rows, schema, build, cuts):
    src = tmp_path / name
    for k, part in enumerate(cuts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").json(str(src / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src / "*"))
    out = []
    query = build(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(out)


def test_streamed_notes_do_not_depend_on_batches(spark, tmp_path):
    frames = [0, 3, 4, 5, 6, 12, 13, 20]
    rows = [(0, 40, f) for f in frames]
    one = run_stream(spark, tmp_path, "one", rows, "track long, pitch int, frame int", lambda s: causal.note_messages(s, 2, 3), [range(8)])
    two = run_stream(spark, tmp_path, "two", rows, "track long, pitch int, frame int", lambda s: causal.note_messages(s, 2, 3), [range(3), range(3, 6), range(6, 8)])
    assert one == two == [(0, 40, 4, 1), (0, 40, 9, 0), (0, 40, 13, 1), (0, 40, 16, 0)]


def test_note_ons_and_midi_fixture(spark):
    both = spark.createDataFrame([(0, p, f) for p in (0, 1) for f in range(12)], "track long, pitch int, frame int")
    onsets = spark.createDataFrame([(0, 0, f) for f in (3, 4, 5, 8)] + [(0, 1, 4)], "track long, pitch int, frame int")
    ons = N.note_ons(N.note_state(both, 12, 1, 2), onsets, 3)
    assert {(r.pitch, r.frame, r.retrigger) for r in ons.collect()} == {(0, 0, False), (0, 3, True), (0, 8, True), (1, 0, False), (1, 4, True)}
    midi = N.midi_of_predictions(both, onsets, 1.0).orderBy("seq").collect()
    assert [(r.on, r.velocity) for r in midi if r.tick == 3 * 960] == [(0, 0), (1, 80)] and sum(1 if r.on else -1 for r in midi) == 0
    assert max(r.tick for r in midi) == 12 * 960 and sum(r.delta for r in midi) == 12 * 960
    assert {r.tick // 960 for r in midi if r.on and r.pitch == 0} == {0, 3, 8}


def test_midi_of_predictions_against_a_frame_by_frame_writer(spark):
    rnd, act, ons, want = random.Random(5), [], [], set()
    seconds = 256 / 22050
    for track in range(40):
        active, before, a = False, False, False
        for f in range(50):
            a, o = rnd.random() < 0.7, rnd.random() < 0.4
            act += [(track, 40, f)] if a else []
            ons += [(track, 40, f)] if o else []
            tick, rising, before = round(f * seconds * 960), o and not before, o
            if active and (not a or rising):
                want.add((track, tick, 0))
                active = False
            if a and not active:
                want.add((track, tick, 1))
                active = True
        if active:
            want.add((track, round(50 * seconds * 960), 0))
    schema = "track long, pitch int, frame int"
    got = N.midi_of_predictions(spark.createDataFrame(act, schema), spark.createDataFrame(ons, schema)).collect()
    assert {(r.track, r.tick, r.on) for r in got} == want and len(got) == len(want)
    bad = [(1, 40, 0, 4), (2, 39, 0, 4), (3, 40, -1, 4), (4, 40, 5, 4), (5, None, 1, 2)]
    problems = N.evaluation_violations(spark.createDataFrame(bad, "event_id long, pitch int, start int, end int"), 40, 44).collect()
    assert {r.event_id for r in problems} == {2, 3, 4, 5}


def test_note_ons_against_a_frame_by_frame_decoder(spark):
    rnd, act, ons, want = random.Random(7), [], [], set()
    for track in range(50):
        active, on, off, wait, before = False, 0, 0, 0, False
        for f in range(60):
            a, o = rnd.random() < 0.7, rnd.random() < 0.4
            act += [(track, 40, f)] if a else []
            ons += [(track, 40, f)] if o else []
            wait, rising, before = max(wait - 1, 0), o and not before, o
            if active:
                off = 0 if a else off + 1
                if off >= 4:
                    active, off, on = False, 0, 0
                if active and rising and not wait:
                    want.add((track, f, True))
                    wait = 5
            else:
                on = on + 1 if a else 0
                if on >= 2:
                    active, on, off, wait = True, 0, 0, 5
                    want.add((track, f, False))
    schema = "track long, pitch int, frame int"
    got = N.note_ons(N.note_state(spark.createDataFrame(act, schema), 60, 2, 4), spark.createDataFrame(ons, schema), 5)
    assert {(r.track, r.frame, r.retrigger) for r in got.collect()} == want


def test_bounded_calibration_fixture(spark):
    def run(scores, truth, cap):
        rows = [(0, s, int((i, j) in truth)) for i, row in enumerate(scores) for j, s in enumerate(row)]
        return S.calibrate(spark.createDataFrame(rows, "member int, score int, truth int"), cap, "member", floor=0.5, fall_back=True).first()

    a = run([[5, 4], [3, 2], [1, 4], [0, -1]], {(0, 0), (1, 0), (2, 1)}, 1.5)
    assert (a.threshold, a.tp, a.fp, a.fn, a.f1) == (3, 3, 1, 0, round(6 / 7, 6))
    b = run([[5, 4], [3, 2], [1, 8], [0, -1]], {(2, 1)}, 4.0)
    assert (b.threshold, b.tp, b.fp, b.f1) == (8, 1, 0, 1.0)
    c = run([[7, 7], [7, 7]], set(), 1.5)
    assert (c.threshold, c.tp, c.fp) == (8, 0, 0)
    d = run([[9, 9], [9, 9]], {(0, 0)}, 1.5)  # no allowed threshold: the best of all
    assert (d.threshold, d.tp, d.fp) == (9, 1, 3)


def test_event_metrics_against_brute_force(spark):
    rnd = random.Random(11)
    targets = [(i, 0, rnd.choice([40, 41, 45]), rnd.randrange(80), rnd.random() < 0.3, rnd.random() < 0.3, rnd.random() < 0.5) for i in range(60)]
    given = [(i, 0, rnd.choice([40, 41, 45]), rnd.randrange(80)) for i in range(70)]
    t = spark.createDataFrame(targets, "event_id long, track long, pitch int, frame int, retrigger boolean, active_previous boolean, chord boolean")
    p = spark.createDataFrame(given, "event_id long, track long, pitch int, frame int")
    onset = lambda x: x.select("track", "pitch", "frame", F.col("event_id").alias("id"))
    rows = M.event_metrics(t, p, M.match_onsets(onset(t), onset(p), [0, 2]), 41, [0, 2]).collect()
    got = {(r.subset, r.tolerance): r for r in rows}
    assert len(rows) == len(got) == 12
    for tolerance in (0, 2):
        error = {}
        for pitch in (40, 41, 45):
            a = sorted((x[3], x[0]) for x in targets if x[2] == pitch)
            b = sorted((x[3], x[0]) for x in given if x[2] == pitch)
            i = j = 0
            while i < len(a) and j < len(b):
                if abs(a[i][0] - b[j][0]) <= tolerance:
                    error[a[i][1]] = abs(a[i][0] - b[j][0])
                    i, j = i + 1, j + 1
                elif b[j][0] < a[i][0]:
                    j += 1
                else:
                    i += 1
        subsets = {"all": lambda x: True, "low": lambda x: x[2] <= 41, "retrigger": lambda x: x[4], "active_previous": lambda x: x[5], "chord": lambda x: x[6], "single": lambda x: not x[6]}
        for name, inside in subsets.items():
            wanted = {x[0] for x in targets if inside(x)}
            tp = len(wanted & error.keys())
            n = {"all": 70, "low": sum(x[2] <= 41 for x in given)}.get(name)
            rate = round(tp / n, 6) if n else None
            f1 = round(2 * (tp / n) * (tp / len(wanted)) / (tp / n + tp / len(wanted)), 6) if n else None
            r = got[name, tolerance]
            assert (r.targets, r.tp, r.fn, r.predicted, r.fp) == (len(wanted), tp, len(wanted) - tp, n, n and n - tp)
            assert (r.recall, r.precision, r.f1) == (round(tp / len(wanted), 6), rate, f1)
            assert r.mean_abs_error == (round(sum(error[k] for k in wanted & error.keys()) / tp, 6) if tp else None)
    empty = M.event_metrics(t.limit(0), p.limit(0), M.match_onsets(onset(t.limit(0)), onset(p), [0]), 41, [0]).collect()
    assert len(empty) == 6 and all(r.tp == r.targets == 0 and r.recall == 0 for r in empty)


def test_smoothing_does_not_depend_on_blocks(spark):
    rnd = np.random.default_rng(3)
    x = rnd.random((2, 50, 3))
    rows = [(t, 7 * f, x[t, f].tolist()) for t in range(2) for f in range(50)]
    wide = spark.createDataFrame(rows, "track long, frame long, x array<double>")
    for span in (4096, 30):
        got = {(r.track, r.frame): r.x for r in X.smoothed(wide, 0.08, span).collect()}
        for t in range(2):
            ema = x[t, 0].copy()
            for f in range(50):
                ema += 0.08 * (x[t, f] - ema)
                assert got[t, 7 * f] == pytest.approx(np.clip(x[t, f] - ema + 0.5, 0, 1))


def test_streamed_lags_do_not_depend_on_batches(spark, tmp_path):
    rows = [(0, f, [float(f), 1.0]) for f in range(1, 9)]
    schema = "track long, frame long, x array<double>"
    one = run_stream(spark, tmp_path, "lag1", rows, schema, lambda s: causal.lagged(s, (0, 1, 3), 2), [range(8)])
    two = run_stream(spark, tmp_path, "lag2", rows, schema, lambda s: causal.lagged(s, (0, 1, 3), 2), [range(3), range(3, 4), range(4, 8)])
    value = lambda f: [float(f), 1.0] if f >= 1 else [0.0, 0.0]
    assert [tuple(map(str, r)) for r in one] == [tuple(map(str, r)) for r in two]
    assert {r[1]: list(r[2]) for r in one} == {f: value(f) + value(f - 1) + value(f - 3) for f in range(1, 9)}


def test_stable_seed(spark):
    import hashlib

    texts = ["", "a/1", "é", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.stable_seed(F.col("t"), 42).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: None if t is None else int.from_bytes(hashlib.blake2s(t.encode(), digest_size=4).digest(), "little") ^ 42 for t in texts}


def test_a_plan_of_an_unknown_kind_is_named(spark):
    plan = spark.createDataFrame([(1, "labels-tsv"), (2, "other"), (3, None)], "ref long, kind string")
    assert {r.ref for r in N.unsupported(plan, {"labels-tsv": None}).collect()} == {2, 3}


def test_intervals_count_as_cells(spark):
    rnd = random.Random(8)
    schema = "event_id long, track long, pitch int, start int, end int, amp double"
    events = lambda n: spark.createDataFrame([(i, rnd.randrange(3), 40 + rnd.randrange(2), s := rnd.randrange(70), s + rnd.randrange(9), 0.5) for i in range(n)], schema)
    a, b = events(90), events(80)
    one, two = N.rasterise(a, 64), N.rasterise(b, 64)
    assert N.covered(a, 64).select("track", "pitch", "start", "end").exceptAll(N.runs(one).select("track", "pitch", "start", "end")).count() == 0
    for by in (["pitch"], ["track", "pitch"], []):
        want = [tuple(r) for r in M.confusion(M.cells(one, two), *by).collect()]
        assert sorted(tuple(r) for r in M.interval_confusion(N.covered(a, 64), N.covered(b, 64), *by).collect()) == sorted(want)
    assert M.interval_confusion(N.covered(a.limit(0), 64), N.covered(b, 64), "pitch").where("tp > 0 or fn > 0").count() == 0


def test_ensemble_gain_does_not_depend_on_the_order_of_rows(spark):
    values = {5: 0.127869, 1: 0.118495, 4: 0.133333, 0: 0.128721, 3: 0.104839, 2: 0.111411}  # in doubles their mean is 0.120778 or the next one, by order; the gain is 0.013635
    whole = spark.createDataFrame([("mean", 0.134413), ("max", 0.1)], "member string, f1 double")
    for order in (list(values), sorted(values), [3, 0, 4, 1, 5, 2]):
        single = spark.createDataFrame([(k, values[k]) for k in order], "member int, f1 double").coalesce(1)
        assert [tuple(r) for r in E.gain(whole, single).collect()] == [(0.01364, 0.00108)]
    assert [tuple(r) for r in E.gain(single, whole).collect()] == [(0.01613, -0.00108)]
