"""File sources and sinks: WAV, posteriorgrams, event and score tables, Standard MIDI Files.

Binary formats are read with Spark's binaryFile source and decoded by an Arrow
map, one file at a time; text formats use Spark's own readers with fixed schemas.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

AUDIO = "path string, sample_rate int, samples array<float>"
POSTERIOR = "path string, frame int, notes array<float>, onsets array<float>, contours array<float>"
EVENTS = "start_sec double, end_sec double, pitch int, amplitude double, start_frame int, end_frame int, bends_thirds_of_semitone string"
MANIFEST = "split string, source string, id string, input string, output_rel string, `group` string"


def resample(x: np.ndarray, rate: int, target: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling to ceil(n * target / rate) samples (zero phase)."""
    if rate == target or not len(x):
        return x.astype(np.float32)
    g = np.gcd(rate, target)
    up, down = target // g, rate // g
    cut = min(1.0, up / down)
    half = int(np.ceil(taps / cut))
    n = -(-len(x) * up // down)
    out = np.empty(n)
    offsets = np.arange(-half, half + 1)
    padded = np.pad(x.astype(np.float64), half + 1)
    for phase in range(min(up, n)):
        at = np.arange(phase, n, up) * down
        base, part = at // up, (at[0] % up) / up
        t = (offsets - part) * cut
        kernel = np.sinc(t) * np.where(np.abs(t) < taps, np.cos(np.pi * np.clip(t / taps, -1, 1) / 2) ** 2, 0.0)
        kernel /= kernel.sum()
        out[phase::up] = padded[base[:, None] + offsets + half + 1] @ kernel
    return out.astype(np.float32)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and first channel in -1..1 of a RIFF file with 8/16/24/32-bit integer or 32-bit float samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or body is None:
        raise ValueError("a WAVE file lacks its format or its data")
    kind, channels, rate, _, _, bits = fmt
    if kind == 3 and bits == 32:
        x = np.frombuffer(body[: len(body) // 4 * 4], "<f4").astype(np.float32)
    elif bits == 16:
        x = np.frombuffer(body[: len(body) // 2 * 2], "<i2") / np.float32(32768)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 32:
        x = (np.frombuffer(body[: len(body) // 4 * 4], "<i4") / 2147483648.0).astype(np.float32)
    elif bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8).astype(np.float32) / 8388608
    else:
        raise ValueError(f"unsupported WAVE samples: format {kind}, {bits} bits")
    return rate, x[: len(x) // channels * channels].reshape(-1, channels)[:, 0].astype(np.float32)


def read_wav(spark: SparkSession, path: str, target_rate: int | None = None) -> DataFrame:
    """path, sample_rate, samples of the first channel."""

    def decode(frames):
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rate, x = decode_wav(bytes(data))
                if target_rate:
                    rate, x = target_rate, resample(x, rate, target_rate)
                rows.append((name, rate, x))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, AUDIO)


HEADER, NOTES, CONTOURS = 256, 88, 264


def read_posteriors(spark: SparkSession, path: str) -> DataFrame:
    """Frames of 88 note, 88 onset and 264 contour levels (0..255) behind a 256-byte header, as 0..1."""

    def decode(frames):
        width = 2 * NOTES + CONTOURS
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                body = np.frombuffer(bytes(data), np.uint8)[HEADER:]
                if len(body) % width:
                    raise ValueError(f"{name}: the body is not a whole number of frames")
                x = (body.reshape(-1, width) / np.float32(255)).astype(np.float32)
                yield pd.DataFrame({"path": name, "frame": np.arange(len(x), dtype=np.int32), "notes": list(x[:, :NOTES]), "onsets": list(x[:, NOTES : 2 * NOTES]), "contours": list(x[:, 2 * NOTES :])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, POSTERIOR)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event table (tab separated, header checked against the schema)."""
    return spark.read.csv(path, sep="\t", header=True, schema=EVENTS, enforceSchema=False, mode="FAILFAST")


def event_violations(events: DataFrame) -> DataFrame:
    """Rows that are not 0 <= start <= end."""
    ok = (F.col("start_frame") >= 0) & (F.col("start_frame") <= F.col("end_frame"))
    return events.where(~F.coalesce(ok, F.lit(False)))


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=MANIFEST, enforceSchema=False, mode="FAILFAST")
    return rows.where(F.col("split") == split) if split else rows


def write_scores(scores: DataFrame, path: str, pitches: list[int]) -> None:
    """frame, pitch, score rows as a tab-separated table with a column for each pitch."""
    wide = scores.groupBy("frame").pivot("pitch", pitches).agg(F.first("score")).orderBy("frame")
    wide.select("frame", *(F.col(str(p)).alias(f"score_{p}") for p in pitches)).write.csv(path, sep="\t", header=True)


def read_scores(spark: SparkSession, path: str, pitches: list[int]) -> DataFrame:
    """frame, pitch, score from such a table."""
    schema = "frame int, " + ", ".join(f"score_{p} int" for p in pitches)
    wide = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False, mode="FAILFAST", comment="#")
    return wide.unpivot("frame", [f"score_{p}" for p in pitches], "name", "score").select("frame", F.substring_index("name", "_", -1).cast("int").alias("pitch"), "score")


def score_violations(scores: DataFrame) -> DataFrame:
    """Frames that do not follow each other from 0."""
    order = W.orderBy("frame")  # a row for each frame of one file
    return scores.select("frame").distinct().withColumn("expected", F.row_number().over(order) - 1).where("frame <> expected")


def _varint(n: int) -> bytes:
    out = bytes([n & 0x7F])
    while n := n >> 7:
        out = bytes([n & 0x7F | 0x80]) + out
    return out


def midi_bytes(messages: list[tuple[int, int, int, int]], ppq: int = 480, tempo: int = 500_000) -> bytes:
    """A format-0 Standard MIDI File of (delta, on, pitch, velocity) messages."""
    body = b"\x00\xff\x51\x03" + tempo.to_bytes(3, "big")
    for delta, on, pitch, velocity in messages:
        body += _varint(delta) + bytes([0x90 if on else 0x80, pitch, velocity])
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ppq) + b"MTrk" + struct.pack(">I", len(body)) + body


def midi_files(midi: DataFrame) -> DataFrame:
    """track, content: one file for each track from `notes.midi_events` rows (a track is one group)."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("seq")
        return pd.DataFrame({"track": [rows["track"].iloc[0]], "content": [midi_bytes(list(zip(rows["delta"], rows["on"], rows["pitch"], rows["velocity"], strict=True)))]})

    return midi.groupBy("track").applyInPandas(build, "track long, content binary")


def parse_midi(data: bytes) -> list[tuple[int, float, int, int, int, int]]:
    """(tick, seconds, on, pitch, velocity, channel) of the note messages, with tempo changes, tracks merged by tick."""
    if data[:4] != b"MThd":
        raise ValueError("not a Standard MIDI File")
    _, tracks, ppq = struct.unpack_from(">HHH", data, 8)
    at, events = 14, []
    for _ in range(tracks):
        size = struct.unpack_from(">I", data, at + 4)[0]
        i, end, tick, status = at + 8, at + 8 + size, 0, 0
        while i < end:
            delta = 0
            while True:
                delta = delta << 7 | data[i] & 0x7F
                i += 1
                if not data[i - 1] & 0x80:
                    break
            tick += delta
            if data[i] & 0x80:
                status = data[i]
                i += 1
            if status in (0xFF, 0xF0, 0xF7):
                meta = data[i] if status == 0xFF else None
                i += status == 0xFF
                n = 0
                while True:
                    n = n << 7 | data[i] & 0x7F
                    i += 1
                    if not data[i - 1] & 0x80:
                        break
                if meta == 0x51:
                    events.append((tick, 0, int.from_bytes(data[i : i + n], "big"), None))
                i += n
            else:
                width = 1 if status >> 4 in (0xC, 0xD) else 2
                if status >> 4 in (8, 9):
                    on = int(status >> 4 == 9 and data[i + 1] > 0)
                    events.append((tick, 1 + on, data[i], (data[i + 1], status & 15)))
                i += width
        at = end
    out, seconds, last, tempo = [], 0.0, 0, 500_000
    for tick, kind, value, more in sorted(events, key=lambda e: (e[0], e[1])):  # tempo, then offs, then ons
        seconds += (tick - last) * tempo / 1e6 / ppq
        last = tick
        if kind == 0:
            tempo = value
        else:
            out.append((tick, seconds, kind - 1, value, *more))
    return out


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """path, tick, seconds, on, pitch, velocity, channel of all note messages."""

    def decode(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = parse_midi(bytes(data))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["path", "tick", "seconds", "on", "pitch", "velocity", "channel"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, tick long, seconds double, `on` int, pitch int, velocity int, channel int")
