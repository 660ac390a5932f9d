"""Structured Streaming twins of the causal operators.

State is kept for each (track, pitch) or track; results do not depend on how
the input is cut into micro-batches. Frames of a key must arrive in order; a frame
at or before the last one seen is late and is dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W


def note_messages(active: DataFrame, on_after: int = 2, off_after: int = 4) -> DataFrame:
    """Note-on and note-off messages of the hysteresis decoder over a stream of sounding cells (track, pitch, frame).

    Silent frames are not sent: a gap is known when the next sounding frame of the voice arrives.
    """
    schema = "track long, pitch int, frame int, on int"
    state_schema = "last int, run int, sounding int"

    def step(key, frames, state):
        last, run, sounding = state.get if state.exists else (-1, 0, 0)
        out = []
        rows = pd.concat(list(frames))["frame"]
        for f in sorted(rows):
            if f <= last:
                continue
            gap = f - last - 1 if last >= 0 else 0
            if sounding and gap >= off_after:
                out.append((last + off_after, 0))
                sounding = 0
            run = run + 1 if gap == 0 and last >= 0 else 1
            if not sounding and run >= on_after:
                out.append((f, 1))
                sounding = 1
            last = int(f)
        state.update((last, run, sounding))
        yield pd.DataFrame({"track": key[0], "pitch": key[1], "frame": [f for f, _ in out], "on": [o for _, o in out]}).astype({"track": "int64", "pitch": "int32", "frame": "int32", "on": "int32"})

    return active.groupBy("track", "pitch").applyInPandasWithState(step, schema, state_schema, "append", "NoTimeout")


def lagged(features: DataFrame, lags: tuple[int, ...], width: int) -> DataFrame:
    """track, frame, ctx: concatenated lags of a stream of vectors (track, frame, x); zeros before a track's begin."""
    keep = max(lags)
    schema, state_schema = "track long, frame long, ctx array<double>", "last long, ring array<double>"

    def step(key, frames, state):
        last, ring = state.get if state.exists else (-1, [0.0] * (keep * width))
        ring = list(ring)
        out = []
        for row in pd.concat(list(frames)).sort_values("frame").itertuples():
            if row.frame <= last:
                continue
            ring = [*ring, *map(float, row.x)]
            n = len(ring)
            ctx: list[float] = []
            for k in lags:
                ctx += ring[n - (k + 1) * width : n - k * width]
            out.append((key[0], row.frame, ctx))
            ring, last = ring[width:], int(row.frame)
        state.update((last, ring))
        yield pd.DataFrame(out, columns=["track", "frame", "ctx"])

    return features.groupBy("track").applyInPandasWithState(step, schema, state_schema, "append", "NoTimeout")


def running_confusion(cells: DataFrame, *by: str) -> DataFrame:
    """Confusion counts that grow with a stream of (y, p) cells; partial sums merge across batches."""
    y, p = F.col("y") == 1, F.col("p") == 1
    return cells.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))


def windowed_activity(events: DataFrame, ts: Column, size: str = "8 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value for each sliding window and type; rows later than `late` are dropped."""
    timed = events.withColumn("_ts", ts).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, ts: Column, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed after `gap` without an event."""
    timed = events.withColumn("_ts", ts).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def silent_voices(messages: DataFrame, silence_ms: int, until_ms: Column) -> DataFrame:
    """track, pitch, at_ms: note-offs for voices that sound and hear nothing for `silence_ms`, at the time they are due; those due after `until_ms` are open.

    messages: track, pitch, at_ms, on. The batch form of `end_silent_voices`.
    """
    order = W.partitionBy("track", "pitch").orderBy("at_ms", "on")
    due = F.col("at_ms") + silence_ms
    after = F.lead("at_ms").over(order)
    left = messages.withColumn("due", due).withColumn("after", after).where("`on` = 1 and (after is null or after > due)")
    return left.where(F.col("due") <= until_ms).select("track", "pitch", F.col("due").alias("at_ms"))


class SilentVoice(StatefulProcessor):
    """A voice's messages are taken in order of time once the watermark has passed them, so batches and arrival don't matter."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, on int")
        self.voice = handle.getValueState("voice", "at_ms long, on int")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for at, on in zip(frame["at_ms"].tolist(), frame["on"].tolist(), strict=True):
                self.waiting.appendValue((int(at), int(on)))
                self.handle.registerTimer(int(at))
                if on:
                    self.handle.registerTimer(int(at) + self.silence)
        yield pd.DataFrame({"track": [], "pitch": [], "at_ms": []}).astype({"track": "int64", "pitch": "int32", "at_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        at, on = self.voice.get() if self.voice.exists() else (0, 0)
        due = []
        for then, what in ready:
            if on and then > at + self.silence:
                due.append(at + self.silence)
            at, on = then, what
        if on and now >= at + self.silence:
            due.append(at + self.silence)
            on = 0
        self.voice.update((at, on))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        yield pd.DataFrame({"track": [key[0]] * len(due), "pitch": [key[1]] * len(due), "at_ms": due}).astype({"track": "int64", "pitch": "int32", "at_ms": "int64"})

    def close(self) -> None:
        pass


def end_silent_voices(messages: DataFrame, ts: Column, silence_ms: int, late: str = "2 seconds") -> DataFrame:
    """track, pitch, at_ms: a stream of note-offs for voices that sound and hear nothing for `silence_ms`; no message has to come for one.

    messages: track, pitch, on, and their time `ts`; later ones than `late` are dropped. A voice's state is its last message and those that the
    watermark has not reached. Needs the state store that has timers (spark.sql.streaming.stateStore.providerClass: RocksDBStateStoreProvider).
    """
    timed = messages.withColumn("_ts", ts).withWatermark("_ts", late).withColumn("at_ms", F.unix_millis("_ts"))
    return timed.groupBy("track", "pitch").transformWithStateInPandas(SilentVoice(silence_ms), "track long, pitch int, at_ms long", "append", "eventTime")
