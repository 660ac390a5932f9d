"""Block-wise frontends against frame-by-frame computations in one pass."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import blocks, frontend, tracker
from framelark.operators.frontend import DualResolution, PitchFeatures, Thermometer
from framelark.sources.wav_blocks import read_wav_blocks

RATE = 22_050


def tone(pitch, seconds, amplitude=0.25, harmonics=1):
    t = np.arange(round(seconds * RATE)) / RATE
    return sum(amplitude / h * np.sin(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) * h * t) for h in range(1, harmonics + 1))


def chunks(spark, signals, span=blocks.SPAN):
    rows = [(t, b, [float(v) for v in x[b * span : (b + 1) * span]]) for t, x in signals.items() for b in range(-(-len(x) // span))]
    return spark.createDataFrame(rows, "track string, block long, samples array<float>").repartition(5)


def frames_one_by_one(x, size):
    for end in range(1, len(x) + 1, 256):
        frame = np.zeros(size)
        part = x[max(0, end - size) : end]
        frame[size - len(part) :] = part
        yield frame


def at_bin(m, f, size):
    p = f * size / RATE
    if p > size // 2:
        return 0.0
    k = int(p)
    return m[k] * (1 - (p - k)) + m[min(k + 1, size // 2)] * (p - k)


def magnitude(frame):
    w = np.hanning(len(frame))
    return np.abs(np.fft.rfft(frame * w)) / (w.sum() / 2)


def unit_db(v):
    return min(max((20 * np.log10(max(v, 1e-7)) + 100) / 100, 0), 1)


def clip(v):
    return min(max(v, 0.0), 1.0)


def pitch_features(x, every=False, extra=False):
    """All features of all frames, by plain loops."""
    hz = [440 * 2 ** ((p - 69) / 12) for p in range(40, 89)]
    w = np.array([1 / np.sqrt(h) for h in range(1, 7)])
    w /= w.sum()
    out, before, slow, slow_c, before_c, before_m = [], np.zeros(49), np.zeros(49), np.full(49, 0.5), np.full(49, 0.5), np.zeros(1025)
    for frame in frames_one_by_one(x, 2048):
        m = magnitude(frame)
        loud = np.array([[unit_db(at_bin(m, f * h, 2048)) for h in range(1, 7)] for f in hz])
        side = np.array([[0.5 * (unit_db(at_bin(m, f * h * 2 ** (-0.5 / 12), 2048)) + unit_db(at_bin(m, f * h * 2 ** (0.5 / 12), 2048))) for h in range(1, 7)] for f in hz])
        sal = loud @ w
        con = np.array([clip(v) for v in sal - (side @ w if every else side[:, 0]) + 0.5])
        margin = [clip(s - unit_db(at_bin(m, f / 2, 2048)) + 0.5) for s, f in zip(sal, hz)]
        slow = slow + 0.08 * (sal - slow)
        slow_c = slow_c + 0.08 * (con - slow_c)
        row = [*loud[:, 0], *sal, *con, *margin, *np.clip(sal - before, 0, 1), *np.clip(sal - slow + 0.5, 0, 1)]
        if extra:
            row += [clip(loud[p, h] - side[p, h] + 0.5) for h in range(6) for p in range(49)]
            row += [*np.clip(con - before_c, 0, 1), *np.clip(con - slow_c + 0.5, 0, 1)]
        rise = np.maximum(m - before_m, 0).mean() * 40
        centre = (m @ np.fft.rfftfreq(2048, 1 / RATE)) / m.sum() / (RATE / 2) if m.sum() > 1e-9 else 0
        out.append(row + [unit_db(np.sqrt((frame**2).mean())), clip(rise), clip(centre)])
        before, before_c, before_m = sal, con, m
    return np.array(out)


@pytest.fixture(scope="module")
def signals():
    rnd = np.random.default_rng(1)
    long = np.concatenate([tone(45, 0.7, harmonics=4), np.zeros(3000), tone(52, 0.9) + tone(57, 0.9), rnd.normal(0, 0.01, 20_000)])
    return {"long": long.astype(np.float32), "short": tone(60, 0.05).astype(np.float32), "one": np.float32([0.5]), "whole": rnd.normal(0, 0.1, 2 * blocks.SPAN).astype(np.float32)}


def collected(df, *columns):
    got = {}
    for r in df.collect():
        got.setdefault(r.track, []).append((r.frame, *(r[c] for c in columns)))
    return {t: [np.array([row[k + 1] for row in sorted(rows, key=lambda r: r[0])]) for k in range(len(columns))] for t, rows in got.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_pitch_features_equal_one_pass(spark, signals, extra):
    f = PitchFeatures(every_harmonic=extra, profile=extra, contrast_attack=extra)
    some = {t: x[: blocks.SPAN + 9000] for t, x in signals.items()}
    got = collected(blocks.features(blocks.with_halo(chunks(spark, some), f.halo), f), "x")
    assert len(f.names()) == (297 + 6 * 49 + 98 if extra else 297) and len(set(f.names())) == len(f.names())
    for t, x in some.items():
        want = pitch_features(x.astype(float), extra, extra)
        assert got[t][0].shape == want.shape and np.abs(got[t][0] - want).max() < 2e-4, t


def test_lags_reach_over_blocks(spark, signals):
    f = PitchFeatures()
    cut = blocks.with_halo(chunks(spark, signals), f.halo)
    plain, lagged = collected(blocks.features(cut, f), "x"), collected(blocks.features(cut, f, frontend.CONTEXT), "x")
    for t, (x,) in plain.items():
        for k, lag in enumerate(frontend.CONTEXT):
            part = lagged[t][0][:, k * 297 : (k + 1) * 297]
            assert np.array_equal(part[lag:], x[: max(len(x) - lag, 0)]) and not part[:lag].any()


def dual_evidence(x):
    hz = [440 * 2 ** ((p - 69) / 12) for p in range(40, 89)]
    w = np.array([1 / h for h in range(1, 12)])
    w /= w.sum()
    slow, out = np.zeros(49), []
    for frame in frames_one_by_one(x, 4096):
        rest, mask, pitch = {}, None, {}
        for name, size in (("long", 4096), ("short", 512)):
            m = magnitude(frame[-size:])
            amp = np.array([[at_bin(m, f * h, size) for h in range(1, 12)] for f in hz])
            left = amp.copy()
            for p in range(49):
                for h in range(1, 12):
                    for o in range(p):
                        ratio = hz[p] * h / hz[o]
                        k = round(ratio)
                        if 2 <= k <= 11 and abs(1200 * np.log2(ratio / k)) <= 18:
                            left[p, h - 1] -= min(amp[o, k - 1], amp[o, 0] / k * 1.05)
            rest[name] = np.maximum(left, 0)
            if mask is None:
                f0 = np.concatenate([[0], amp[:, 0], [0]])
                mask = np.clip((f0[1:-1] / np.maximum(np.maximum(f0[:-2], f0[2:]), 1e-8) - 1.02) / 0.18, 0, 1)
            rest[name][:, 0] *= mask
            u = 1 - np.exp(-np.maximum(rest[name] - 0.0015, 0) / (0.1 - 0.0015))
            pitch[name] = 0.72 * u[:, 0] + 0.28 * (u @ w)
        struck = 0.78 * rest["short"][:, 0] + 0.22 * (rest["short"] @ w)
        attack = np.maximum(struck - slow, 0)
        slow = slow + 0.08 * (struck - slow)
        out.append((np.clip(0.78 * pitch["long"] + 0.22 * pitch["short"], 0, 1), 1 - np.exp(-np.maximum(attack - 0.0015, 0) / 0.035), attack, rest["long"][:, 0]))
    return [np.array(c) for c in zip(*out)]


def test_evidence_equals_one_pass(spark):
    x = np.concatenate([np.zeros(700), tone(45, 0.4, harmonics=3), tone(52, 0.5)]).astype(np.float32)
    f = DualResolution()
    got = collected(frontend.evidence(blocks.with_halo(chunks(spark, {"a": x}), f.halo)), "activity", "onset", "attack", "fundamental")["a"]
    for a, b in zip(got, dual_evidence(x.astype(float)), strict=True):
        assert a.shape == b.shape and np.abs(a - b).max() < 2e-3


def test_chords_and_overtones_are_tracked(spark):
    quiet = np.zeros(2000)
    sounds = {"tone": tone(45, 0.7), "chord": sum(tone(p, 0.75, 0.2) for p in (45, 52, 57)), "overtones": tone(45, 0.75, 0.28, 8)}
    f = DualResolution()
    cut = blocks.with_halo(chunks(spark, {t: np.concatenate([quiet, x, np.zeros(9000)]).astype(np.float32) for t, x in sounds.items()}), f.halo)
    x = frontend.evidence(cut)
    number = F.when(F.col("track") == "tone", 1).when(F.col("track") == "chord", 2).otherwise(3).cast("long")
    played = {}
    for r in tracker.track(x.withColumn("track", number), 40).where("`on` = 1").collect():
        played.setdefault(r.track, []).append(r.pitch)
    assert played[1] == [45] and sorted(set(played[2])) == [45, 52, 57] and played[3] == [45]


def wav(x, rate=RATE, channels=1, kind="<i2"):
    data = np.zeros((len(x), channels), kind)
    data[:, 0] = np.rint(x * 32767) if kind == "<i2" else x
    body = data.tobytes()
    code, bits = (1, 16) if kind == "<i2" else (3, 32)
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_literals_do_not_depend_on_splits(spark, tmp_path):
    rnd = np.random.default_rng(3)
    x = np.concatenate([tone(45, 0.9, harmonics=3), tone(60, 1.0), rnd.normal(0, 0.05, 30_000)])
    (tmp_path / "a.wav").write_bytes(wav(x, channels=2))
    (tmp_path / "b.wav").write_bytes(wav(x[:5000], kind="<f4"))
    (tmp_path / "none.wav").write_bytes(wav(x[:0]))
    f = PitchFeatures()
    n = 297 * len(frontend.CONTEXT)
    thermometer = Thermometer(np.tile(np.array([[0.123456, 0.31, 0.5123, 0.77]]), (n, 1)), rnd.random(n * 4) < 0.9)
    results = []
    for split in (1 << 30, 100_000, 33_333, 2_000):
        cut = read_wav_blocks(spark, str(tmp_path), halo=f.halo, split=split)
        got = collected(frontend.literals(cut, thermometer), "words")
        results.append((cut.rdd.getNumPartitions(), got))
    assert [r[0] for r in results][0] == 3 and results[-1][0] > 40
    for _, got in results[1:]:
        assert got.keys() == results[0][1].keys() == {"a.wav", "b.wav"} and all(np.array_equal(got[t][0], results[0][1][t][0]) for t in got)
    # the one-pass result
    read = np.rint(x * 32767).astype(np.int16) / 32768
    whole = pitch_features(read[: blocks.SPAN + 3000])
    lagged = np.concatenate([np.concatenate([np.zeros((k, 297)), whole])[: len(whole)] for k in frontend.CONTEXT], axis=1)
    words = results[0][1]["a.wav"][0]
    bits = np.unpackbits(words[: len(whole)].view(np.uint8), axis=1, bitorder="little")[:, : thermometer.kept.sum()]
    want = (lagged[:, :, None] >= thermometer.thresholds).reshape(len(whole), -1)[:, thermometer.kept]
    assert (bits != want).mean() < 1e-3 and len(words) == -(-len(x) // 256)


@pytest.mark.parametrize("rate", [44_100, 48_000])
def test_resampling(spark, tmp_path, rate):
    r = blocks.Resampler(rate)
    assert (r.up, r.down) == ((1, 2) if rate == 44_100 else (147, 320))
    t = np.arange(60_000) / rate
    for hz, low, high in ((1_000, 0.999, 1.001), (10_000, 0.999, 1.001), (12_000, 0, 2e-5)):
        y = r.run(np.sin(2 * np.pi * hz * t).astype(np.float32), 0, 0, r.outputs(len(t)))
        assert len(y) == -(-60_000 * 22_050 // rate)
        k = np.arange(2_000, 20_000)
        basis = np.stack([np.sin(2 * np.pi * hz * k / 22_050), np.cos(2 * np.pi * hz * k / 22_050)], axis=1)
        gain = np.hypot(*np.linalg.lstsq(basis, y[k], rcond=None)[0])
        assert low <= gain <= high, (hz, gain)
    x = np.random.default_rng(2).normal(0, 0.1, 70_000).astype(np.float32)
    x[100], x[40_000] = np.nan, np.inf
    whole = r.run(x, 0, 0, r.outputs(len(x)))
    got = {(s.track, s.block): s.samples for s in blocks.resample(chunks(spark, {"x": x, "y": x[:1]}), rate).collect()}
    mine = np.concatenate([got["x", b] for b in range(-(-len(whole) // blocks.SPAN))])
    assert np.array_equal(mine, whole) and len(got["y", 0]) == 1
    (tmp_path / "x.wav").write_bytes(wav(x, rate, kind="<f4"))
    for split in (10_000, 1 << 30):
        rows = read_wav_blocks(spark, str(tmp_path / "x.wav"), target=22_050, halo=300, split=split).orderBy("block").collect()
        assert np.array_equal(np.concatenate([q.samples for q in rows]), whole)
        assert all(np.array_equal(q.halo, whole[max(q.block * blocks.SPAN - 300, 0) : q.block * blocks.SPAN]) for q in rows)


def test_broken_files_are_named(spark, tmp_path):
    for k, data in enumerate((b"", b"RIFFxxxxWAVE", b"nonsense" * 9, wav(np.zeros(9))[:40])):
        (tmp_path / f"bad{k}.wav").write_bytes(data)
        with pytest.raises(Exception, match=f"bad{k}.wav"):
            read_wav_blocks(spark, str(tmp_path / f"bad{k}.wav")).collect()
