"""Some registered queries against their SQL forms on the smallest tables."""

import math
import os

import pytest

from framelark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["note_state_f1", "o058_event_flags", "o062_retriggers", "o086_micro_rollup", "o054_pack_words", "o096_stratified_selection", "o101_threshold_calibration", "o115_class_sums", "o133_fingerprint", "s02_sessions"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = base.execute(registry.ORACLES[name])
    columns = [c[0] for c in rel.description]
    want = [tuple(map(plain, r)) for r in rel.fetchall()]
    got = registry.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == sorted(want, key=repr)


def test_every_sql_form_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_midi_of_notes_has_every_event(spark):
    from framelark.sources.adapters import FRAMES, note_events

    tick = lambda frame: round(frame * (256 / 22050) * 960)
    open_, notes = {}, {}
    for r in registry.QUERIES["o014_midi_of_notes"](spark, SF).orderBy("track", "seq").collect():
        voice = (r.track, r.pitch)
        if r.on:
            open_[voice] = r.tick
        else:
            notes.setdefault(voice, []).append((open_.pop(voice), r.tick))
    assert not open_
    events = note_events(spark, SF).where(f"`end` > start and start < {FRAMES}").collect()
    cells = lambda lo, hi: set(range(lo, hi))
    sounding = {v: set().union(*(cells(*n) for n in ns)) for v, ns in notes.items()}
    assert events and all(cells(tick(e.start), tick(e.end)) <= sounding.get((e.track, e.pitch), set()) for e in events)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_midi_of_notes_has_the_decoded_notes(spark):
    """Attack 2, release 4, refractory 6: voices decoded frame by frame, then written."""
    from framelark.operators import notes as N
    from framelark.sources.adapters import FRAMES, note_events

    ne = note_events(spark, SF)
    sounds = {(r.track, r.pitch, r.frame) for r in N.rasterise(ne, FRAMES).collect()}
    onsets = {(r.track, r.pitch, r.frame) for r in N.onset_labels(ne, FRAMES, delay=2, width=3).collect()}
    tick = lambda frame: round(frame * (256 / 22050) * 960)
    want = {}
    for track, pitch in {v[:2] for v in sounds}:
        out, active, on, off, wait = want.setdefault(track, []), False, 0, 0, 0
        for f in range(FRAMES):
            sounding, rising, wait = (track, pitch, f) in sounds, (track, pitch, f) in onsets and (track, pitch, f - 1) not in onsets, max(wait - 1, 0)
            if active:
                off = 0 if sounding else off + 1
                if off == 4:
                    active, on = False, 0
                    out.append((tick(f), 0, pitch))
                elif rising and not wait:
                    wait = 6
                    out += [(tick(f), 0, pitch), (tick(f), 1, pitch)]
            else:
                on = on + 1 if sounding else 0
                if on == 2:
                    active, off, wait = True, 0, 6
                    out.append((tick(f), 1, pitch))
        out += [(tick(FRAMES), 0, pitch)] * active
    rows = registry.QUERIES["o014_midi_of_notes"](spark, SF).orderBy("track", "seq").collect()
    raw, got = {}, {}
    for r in rows:
        (got if r.roll == "stable" else raw).setdefault(r.track, []).append(r)
    assert len(want) == len(got) and all(sorted(m) == [(r.tick, r.on, r.pitch) for r in got[t]] for t, m in want.items())
    assert {r.velocity for r in rows if r.on} == {80} and {r.velocity for r in rows if not r.on} == {0}
    for files in (raw, got):  # a file's deltas add up to its ticks
        assert all(sum(r.delta for r in m[: i + 1]) == m[i].tick for m in files.values() for i in range(len(m)))
    assert all([r.seq for r in raw[t] + got[t]] == list(range(1, len(raw[t]) + len(got[t]) + 1)) for t in got)
    test_query_equals_sql(spark, "o014_midi_of_notes")
