import numpy as np

from framelark.operators.tracker import Settings, stretches, track, track_notes


def evidence(frames=40, pitches=3):
    return np.zeros((frames, pitches)), np.zeros((frames, pitches)), np.zeros((frames, pitches))


def test_a_note_needs_an_attack():
    a, o, k = evidence()
    a[5:20, 1] = 0.8
    assert track_notes(a, o, k, Settings()) == []
    k[5, 1] = 0.05
    got = track_notes(a, o, k, Settings())
    assert [(f, p, on) for f, p, on, _ in got] == [(6, 1, 1), (23, 1, 0)] and got[0][3] > 60


def test_retrigger_needs_rest_and_a_rising_onset():
    a, o, k = evidence()
    a[5:30, 0] = 0.8
    k[5, 0] = k[9, 0] = k[15, 0] = 0.05
    o[9, 0] = o[15, 0] = 0.9
    got = [(f, on) for f, p, on, _ in track_notes(a, o, k, Settings())]
    assert got == [(6, 1), (15, 0), (15, 1), (33, 0)]


def test_velocity_grows_with_the_attack(spark):
    rows = []
    for t, e in enumerate((0.005, 0.02, 0.1)):
        a, o, k = evidence(10, 2)
        a[2:, 0] = 0.9
        k[2, 0] = e
        rows += [(t, f, a[f].tolist(), o[f].tolist(), k[f].tolist()) for f in range(10)]
    table = spark.createDataFrame(rows, "track long, frame long, activity array<double>, onset array<double>, attack array<double>")
    got = track(table, 40).where("`on` = 1").orderBy("track").collect()
    assert [r.pitch for r in got] == [40] * 3 and got[0].velocity < got[1].velocity < got[2].velocity


def test_stretches_give_the_messages_of_the_whole_track(spark):
    rnd = np.random.default_rng(9)
    rows, want = [], []
    for t in range(4):
        frames, loud = 900, np.zeros(900, bool)
        for at in rnd.integers(0, 880, 14):
            loud[at : at + rnd.integers(2, 25)] = True
        a, o, k = (rnd.random((frames, 4)) * loud[:, None] * scale for scale in (0.9, 0.9, 0.02))
        k += rnd.random(k.shape) * 0.0019  # never nothing, always below the floors
        rows += [(t, (1 + 9 * (t % 2)) * f + 100, a[f].tolist(), o[f].tolist(), k[f].tolist()) for f in range(frames)]
        want += [(t, (1 + 9 * (t % 2)) * f + 100, 40 + p, on, v) for f, p, on, v in track_notes(a, o, k, Settings())]
    table = spark.createDataFrame(rows, "track long, frame long, activity array<double>, onset array<double>, attack array<double>").repartition(5)
    parts = stretches(table, Settings()).orderBy("track", "first").collect()
    assert len(parts) > 12 and all(a.track != b.track or a.last == b.first for a, b in zip(parts, parts[1:]))
    assert sorted(tuple(r) for r in track(table, 40).collect()) == sorted(want) and len(want) > 40
