"""Polyphonic note tracking from acoustic evidence.

Which pitch sounds is decided by activity and onset evidence; that a note begins, and
how loud, only by attack energy. Within a stretch of a track each frame updates all pitches at once as arrays.

A track is cut where it has been quiet for long: after QUIET frames in a row in which no pitch reaches any threshold, all notes
have ended and all memories are empty, so what follows is decided as from a track's begin. Stretches are tracked in tasks of their own, with the
same messages as the track as a whole; a track without such a pause is one stretch.

Memories: the largest recent attack of a pitch (ATTACK frames) and of the track
(GLOBAL frames), the last rising onset of a pitch (ATTACK frames).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Settings:
    activity_on: float = 0.30
    activity_off: float = 0.16
    onset_on: float = 0.32
    onset_again: float = 0.42  # while the note sounds
    attack_frames: int = 2
    release_frames: int = 4
    refractory: int = 6
    attack_memory: int = 12
    global_memory: int = 3
    floor_new: float = 0.0020
    floor_again: float = 0.0025
    floor_global: float = 0.015
    global_mix: float = 0.5
    velocity_floor: float = 0.0015
    velocity_top: float = 0.16

    @property
    def settled(self) -> int:
        """Quiet frames after which no note sounds and no memory of an attack, an onset or a note is left."""
        return self.release_frames + max(self.attack_memory, self.global_memory, self.refractory) + 2


class _Fading:
    """The largest value of the last frames; it is forgotten once it is older than `keep`."""

    def __init__(self, shape, keep: int, strict: bool):
        self.value, self.age, self.keep, self.strict = np.zeros(shape), np.zeros(shape, int), keep, strict

    def see(self, x: np.ndarray) -> None:
        new = x > self.value if self.strict else x >= self.value
        self.age = np.where(new, 0, self.age + 1)
        self.value = np.where(new, x, np.where(self.age > self.keep, 0.0, self.value))

    def clear(self, where: np.ndarray) -> None:
        self.value, self.age = np.where(where, 0.0, self.value), np.where(where, 0, self.age)


def velocity(energy: np.ndarray, s: Settings) -> np.ndarray:
    unit = 1 - np.exp(-np.maximum(energy - s.velocity_floor, 0) / (s.velocity_top - s.velocity_floor))
    return np.clip(np.rint(1 + 126 * np.sqrt(unit)), 1, 127).astype(int)


def track_notes(activity: np.ndarray, onset: np.ndarray, attack: np.ndarray, s: Settings) -> list[tuple[int, int, int, int]]:
    """(frame, pitch index, on, velocity) messages in order, from [frames, pitches] evidence."""
    pitches = activity.shape[1]
    local, overall = _Fading(pitches, s.attack_memory, True), _Fading((), s.global_memory, False)
    sounding, above = np.zeros(pitches, bool), np.zeros(pitches, bool)
    since_onset = np.full(pitches, 10**6)
    run, quiet, rest = np.zeros(pitches, int), np.zeros(pitches, int), np.zeros(pitches, int)
    out: list[tuple[int, int, int, int]] = []
    for f in range(len(activity)):
        overall.see(attack[f].max(initial=0.0))
        local.see(attack[f])
        struck = bool(overall.age <= s.global_memory and overall.value >= s.floor_global)
        was, above = above, onset[f] >= np.where(sounding, s.onset_again, s.onset_on)
        rising = above & ~was
        since_onset = np.where(rising, 0, since_onset + 1)
        rest = np.maximum(rest - 1, 0)
        fresh = local.age <= s.attack_memory

        run = np.where(sounding, run, np.where(activity[f] >= s.activity_on, np.minimum(run + 1, s.attack_frames), 0))
        begin = ~sounding & (run >= s.attack_frames) & (((since_onset <= s.attack_memory) & struck) | (fresh & (local.value >= s.floor_new)))
        again = sounding & rising & (rest == 0) & ((fresh & (local.value >= s.floor_again)) | struck)
        low = sounding & ~again & (activity[f] < s.activity_off)
        quiet = np.where(low, quiet + 1, np.where(sounding, 0, quiet))
        end = low & (quiet >= s.release_frames)

        loud = velocity(np.maximum(local.value, s.global_mix * overall.value), s)
        for p in np.flatnonzero(begin | again | end).tolist():
            if not begin[p]:
                out.append((f, p, 0, 0))
            if not end[p]:
                out.append((f, p, 1, int(loud[p])))
        hit = begin | again
        local.clear(hit)
        since_onset = np.where(hit | end, 10**6, since_onset)
        rest = np.where(hit, s.refractory, np.where(end, 0, rest))
        run, quiet = np.where(hit | end, 0, run), np.where(hit | end, 0, quiet)
        sounding = (sounding | begin) & ~end
    return out


def stretches(evidence: DataFrame, s: Settings) -> DataFrame:
    """track, first, last: half-open ranges of frames that can be tracked by themselves.

    Works on a flag for each frame. A stretch begins with the last `settled` + 1 frames of a pause, which has as many frames at least before the cut: so values below all thresholds that are remembered over the cut are forgotten before anything depends on them.
    """
    floor = min(s.floor_new, s.floor_again, s.floor_global)
    top = lambda c: F.coalesce(F.array_max(c), F.lit(0.0))
    loud = (top("activity") >= s.activity_off) | (top("onset") >= s.onset_on) | (top("attack") >= floor)
    order = W.partitionBy("track").orderBy("frame")
    marks = evidence.select("track", "frame", loud.alias("loud")).withColumn("place", F.row_number().over(order)).withColumn("back", F.lag("frame", s.settled + 1).over(order))
    sounds = marks.where("loud").withColumn("before", F.lag("place").over(order))
    cuts = sounds.where(F.col("place") - F.col("before") > 2 * s.settled + 1).select("track", F.col("back").alias("first"))
    begins = evidence.groupBy("track").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("end"))
    all_ = begins.select("track", "first").unionByName(cuts).distinct()
    ends = F.lead("first").over(W.partitionBy("track").orderBy("first"))
    return all_.withColumn("next", ends).join(begins.select("track", "end"), "track").select("track", "first", F.coalesce("next", "end").alias("last"))


SPAN = 4096  # frame numbers of a block in which frames meet stretches


def track(evidence: DataFrame, low: int, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """track, frame, pitch, on, velocity from (track, frame, activity, onset, attack) rows with arrays over pitches; a track's rows follow each other, whatever their numbers."""

    def run(pdf):
        pdf = pdf.sort_values("frame")
        stack = [np.stack(pdf[c].to_list()) for c in ("activity", "onset", "attack")]
        rows = track_notes(*stack, settings)
        frames = pdf["frame"].to_numpy()
        return pd.DataFrame([(pdf["track"].iloc[0], frames[f], low + p, on, v) for f, p, on, v in rows], columns=["track", "frame", "pitch", "on", "velocity"])

    x = evidence.select("track", "frame", "activity", "onset", "attack")
    met = stretches(x, settings).withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor((F.col("last") - 1) / SPAN))))
    placed = x.withColumn("_block", F.floor(F.col("frame") / SPAN)).join(met, ["track", "_block"]).where("frame >= first and frame < last")
    return placed.groupBy("track", "first").applyInPandas(run, "track long, frame long, pitch int, `on` int, velocity int")
