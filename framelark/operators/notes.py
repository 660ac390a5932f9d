"""Note events and frame grids: rasterising, edges, note state, intervals, audits.

Tables are sparse: a roll has a row only where a pitch sounds, and the note state
works on runs of sounding frames, so nothing is materialised for silence. All
windows are partitioned by (track, pitch) or by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

VOICE = ("track", "pitch")


def spread(events: DataFrame, lo: Column, hi: Column, *keep: str) -> DataFrame:
    """One row for each frame in [lo, hi); empty ranges give none."""
    return events.select(*keep, lo.alias("_lo"), hi.alias("_hi")).where("_hi > _lo").select(*keep, F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("frame"))


def rasterise(events: DataFrame, frames: int) -> DataFrame:
    """track, pitch, frame, velocity: the loudest event that covers the cell."""
    cells = spread(events.where(F.col("start") < frames), F.col("start"), F.least("end", F.lit(frames)), *VOICE, "amp")
    return cells.groupBy(*VOICE, "frame").agg(F.max("amp").alias("velocity"))


def onset_labels(events: DataFrame, frames: int, delay: int = 0, width: int = 2) -> DataFrame:
    """Cells in [start + delay, start + delay + width) of non-empty events."""
    lo = F.col("start") + delay
    return spread(events.where((F.col("end") > F.col("start")) & (F.col("start") < frames)), lo, F.least(lo + width, F.lit(frames)), *VOICE).distinct()


def event_flags(events: DataFrame, frames: int, silence: int = 3) -> DataFrame:
    """active_previous: the pitch sounds in the frame before; retrigger: or it ended less than `silence` frames ago."""
    kept = events.where((F.col("start") < frames) & (F.col("end") > F.col("start")))
    voice = W.partitionBy(*VOICE)
    before = F.max("end").over(voice.orderBy("start").rangeBetween(W.unboundedPreceding, -1))
    earlier = F.max("end").over(voice.orderBy("start", "end", "event_id").rowsBetween(W.unboundedPreceding, -1))
    active = F.coalesce(before >= F.col("start"), F.lit(False))
    near = F.coalesce(F.col("start") - earlier < silence, F.lit(False))
    return kept.withColumn("active_previous", active).withColumn("retrigger", active | near)


def chord_flag(events: DataFrame, within: int = 1) -> DataFrame:
    """Whether another pitch of the track starts within `within` frames; by a range window, not a self-join."""
    near = W.partitionBy("track").orderBy("start").rangeBetween(-within, within)
    other = (F.min("pitch").over(near) != F.col("pitch")) | (F.max("pitch").over(near) != F.col("pitch"))
    return events.withColumn("chord", other)


def runs(roll: DataFrame) -> DataFrame:
    """track, pitch, start, end of the maximal runs of sounding frames (gaps and islands)."""
    by = W.partitionBy(*VOICE).orderBy("frame")
    numbered = roll.select(*VOICE, "frame").withColumn("_island", F.col("frame") - F.row_number().over(by))
    return numbered.groupBy(*VOICE, "_island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).drop("_island")


def covered(events: DataFrame, frames: int) -> DataFrame:
    """track, pitch, start, end of the maximal runs of frames that events cover: the runs of `rasterise`, without its frames."""
    kept = events.where(F.col("start") < frames).select(*VOICE, "start", F.least("end", F.lit(frames)).alias("end")).where("`end` > start")
    by = W.partitionBy(*VOICE).orderBy("start", "end")
    upto = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    numbered = kept.withColumn("_new", F.coalesce((F.col("start") > upto).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*VOICE, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def rising_edges(roll: DataFrame) -> DataFrame:
    return runs(roll).select(*VOICE, F.col("start").alias("frame"))


def note_state(roll: DataFrame, frames: int, on_after: int = 2, off_after: int = 4) -> DataFrame:
    """`note_state_of_runs` of a roll's runs."""
    return note_state_of_runs(runs(roll), frames, on_after, off_after)


def note_state_of_runs(sounding: DataFrame, frames: int, on_after: int = 2, off_after: int = 4) -> DataFrame:
    """Intervals [on, off) of a causal decoder: on after `on_after` sounding frames in a row, off after `off_after` silent ones.

    Runs closer than `off_after` frames form a cluster; the note begins in the first
    long enough run of its cluster and ends with the cluster.
    """
    by = W.partitionBy(*VOICE).orderBy("start")
    split = F.coalesce((F.col("start") - F.lag("end").over(by) >= off_after).cast("int"), F.lit(1))
    clustered = sounding.withColumn("_split", split).withColumn("_cluster", F.sum("_split").over(by))
    on = F.min(F.when(F.col("end") - F.col("start") >= on_after, F.col("start") + (on_after - 1)))
    off = F.least(F.max("end") + (off_after - 1), F.lit(frames))
    notes = clustered.groupBy(*VOICE, "_cluster").agg(on.alias("on"), off.alias("off"))
    return notes.where("on is not null and off > on").select(*VOICE, "on", "off")


def spaced(candidates: DataFrame, gap: int) -> DataFrame:
    """The frames kept if each must lie at least `gap` after the last kept one (greedy, in order, for each voice).

    A fold over the sorted candidates of one voice: the rule depends on what was kept.
    """
    start = F.array().cast("array<int>")

    def step(kept: Column, frame: Column) -> Column:
        free = (F.size(kept) == 0) | (frame - F.element_at(kept, -1) >= gap)
        return F.when(free, F.concat(kept, F.array(frame))).otherwise(kept)

    folded = candidates.groupBy(*VOICE).agg(F.aggregate(F.array_sort(F.collect_set(F.col("frame").cast("int"))), start, step).alias("kept"))
    return folded.select(*VOICE, F.explode("kept").alias("frame"))


def note_ons(notes: DataFrame, onsets: DataFrame, refractory: int) -> DataFrame:
    """track, pitch, on, off, frame, retrigger: the note-on of each note [on, off), and its retriggers.

    A rising onset while the note is on (after its first frame) triggers it again if `refractory` frames have passed since its
    last note-on. Notes and onsets of a voice share one window; each note is a fold over its own onsets.
    """
    rising = rising_edges(onsets).select(*VOICE, "frame", F.lit(None).cast("int").alias("on"), F.lit(None).cast("int").alias("off"))
    starts = notes.select(*VOICE, F.col("on").cast("int").alias("frame"), F.col("on").cast("int").alias("on"), F.col("off").cast("int").alias("off"))
    so_far = W.partitionBy(*VOICE).orderBy("frame").rangeBetween(W.unboundedPreceding, 0)
    both = starts.unionByName(rising.withColumn("frame", F.col("frame").cast("int"))).select(
        *VOICE, "frame", F.col("on").alias("own"), F.last("on", True).over(so_far).alias("on"), F.last("off", True).over(so_far).alias("off")
    )
    inside = both.where((F.col("own") == F.col("frame")) | (F.col("own").isNull() & (F.col("frame") > F.col("on")) & (F.col("frame") < F.col("off"))))

    def step(kept: Column, frame: Column) -> Column:
        return F.when(frame - F.element_at(kept, -1) >= refractory, F.concat(kept, F.array(frame))).otherwise(kept)

    frames = F.array_sort(F.collect_set("frame"))  # the note-on is the first
    kept = F.aggregate(F.slice(frames, 2, F.size(frames)), F.slice(frames, 1, 1), step)
    each = inside.groupBy(*VOICE, "on", "off").agg(kept.alias("kept"))
    return each.select(*VOICE, "on", "off", F.explode("kept").alias("frame")).withColumn("retrigger", F.col("frame") > F.col("on"))


TICKS, FRAME_SECONDS, VELOCITY = 960, 256 / 22_050, 80


def segments(activity: DataFrame, onsets: DataFrame) -> DataFrame:
    """track, pitch, start, end of the notes in rolls of predictions: runs of activity, cut where an onset rises within."""
    whole = runs(activity)
    starts = whole.select(*VOICE, F.col("start").alias("frame"), F.col("start").alias("own"), "end")
    rising = rising_edges(onsets).select(*VOICE, "frame", F.lit(None).cast("int").alias("own"), F.lit(None).cast("int").alias("end"))
    so_far = W.partitionBy(*VOICE).orderBy("frame", F.col("own").isNull()).rowsBetween(W.unboundedPreceding, 0)
    both = starts.unionByName(rising).select(*VOICE, "frame", "own", F.last("own", True).over(so_far).alias("run"), F.last("end", True).over(so_far).alias("end"))
    cut = both.where("own is not null or (frame > run and frame < `end`)").select(*VOICE, "run", "frame", "end")
    after = F.lead("frame").over(W.partitionBy(*VOICE, "run").orderBy("frame"))
    return cut.select(*VOICE, F.col("frame").alias("start"), F.coalesce(after, F.col("end")).alias("end"))


def sounded(ons: DataFrame) -> DataFrame:
    """track, pitch, start, end of the notes of `note_ons`: a retrigger ends the note and begins it anew."""
    until = F.coalesce(F.lead("frame").over(W.partitionBy(*VOICE, "on").orderBy("frame")), F.col("off"))
    return ons.select(*VOICE, F.col("frame").alias("start"), until.alias("end"))


def midi_of_rolls(rolls: dict[str, DataFrame], frame_seconds: float = FRAME_SECONDS, velocity: int = VELOCITY) -> DataFrame:
    """MIDI messages of notes (track, pitch, start, end) by roll; at a tick ends come first. Ties of a rounded tick go to the even number.

    `seq` numbers all messages of a track, roll by roll in the order of their names; `delta` begins anew with each roll.
    """
    tick = lambda frame: F.rint(F.col(frame) * F.lit(frame_seconds) * TICKS).cast("long")
    pair = F.array(F.struct(tick("end").alias("tick"), F.lit(0).alias("on"), F.lit(0).alias("velocity")), F.struct(tick("start").alias("tick"), F.lit(1).alias("on"), F.lit(velocity).alias("velocity")))
    rows = None
    for name, notes in rolls.items():
        one = notes.select(*VOICE, F.explode(pair).alias("m")).select(*VOICE, "m.*", F.lit(name).alias("roll"))
        rows = one if rows is None else rows.unionByName(one)
    order = W.partitionBy("track").orderBy("roll", "tick", "on", "pitch")
    before = F.when(F.lag("roll").over(order) == F.col("roll"), F.lag("tick").over(order))
    return rows.select(*VOICE, "tick", "on", "velocity", F.row_number().over(order).alias("seq"), (F.col("tick") - F.coalesce(before, F.lit(0))).alias("delta"), "roll")


def midi_of_predictions(activity: DataFrame, onsets: DataFrame, frame_seconds: float = FRAME_SECONDS, velocity: int = VELOCITY) -> DataFrame:
    """MIDI messages of rolls of predictions: a note ends, and begins anew, where an onset rises in it."""
    return midi_of_rolls({"raw": segments(activity, onsets)}, frame_seconds, velocity).drop("roll")


def evaluation_violations(events: DataFrame, low: int, high: int) -> DataFrame:
    """event_id, problem of the events that an evaluation cannot use: every row of a corpus has to be sound."""
    problem = (
        F.when(F.col("pitch").isNull() | F.col("start").isNull() | F.col("end").isNull(), "missing value")
        .when(~F.col("pitch").between(low, high), "pitch out of range")
        .when(F.col("start") < 0, "negative start")
        .when(F.col("end") < F.col("start"), "ends before it starts")
    )
    return events.select("event_id", problem.alias("problem")).where("problem is not null")


def classified_events(events: DataFrame, frames: int, silence: int = 3, within: int = 0) -> DataFrame:
    """The events that begin within the frames and last, with active_previous, retrigger and chord."""
    return chord_flag(event_flags(events, frames, silence), within)


def midi_events(events: DataFrame, rate: int = 960) -> DataFrame:
    """Note-on and note-off rows with ticks and delta ticks; off before on at a tick, then by pitch."""
    lasting = events.withColumn("end", F.greatest("end", F.col("start") + 1))
    velocity = F.greatest(F.least(F.rint(F.col("amp") * 127), F.lit(127)), F.lit(1)).cast("int")
    pair = F.array(
        F.struct((F.col("end") * rate).cast("long").alias("tick"), F.lit(0).alias("on"), F.lit(0).alias("velocity")),
        F.struct((F.col("start") * rate).cast("long").alias("tick"), F.lit(1).alias("on"), velocity.alias("velocity")),
    )
    rows = lasting.select("track", "pitch", "event_id", F.explode(pair).alias("m")).select("track", "pitch", "event_id", "m.*")
    order = W.partitionBy("track").orderBy("tick", "on", "pitch", "event_id")
    return rows.withColumn("seq", F.row_number().over(order)).withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0)))


def running_polyphony(midi: DataFrame) -> DataFrame:
    """`midi` with the voices that sound after each message."""
    order = W.partitionBy("track").orderBy("seq")
    return midi.withColumn("polyphony", F.sum(F.when(F.col("on") == 1, 1).otherwise(-1)).over(order))


def lifecycle_audit(midi: DataFrame) -> DataFrame:
    """Per track: orphan offs, dangling ons, balance, widest voice stacking and pitch range."""
    sign = F.when(F.col("on") == 1, 1).otherwise(-1)
    depth = F.sum(sign).over(W.partitionBy(*VOICE).orderBy("seq"))
    voices = midi.withColumn("_depth", depth).groupBy(*VOICE).agg(F.min("_depth").alias("low"), F.max("_depth").alias("high"), F.sum(sign).alias("left"))
    return voices.groupBy("track").agg(
        F.sum((F.col("low") < 0).cast("int")).alias("orphan_voices"),
        F.sum((F.col("left") != 0).cast("int")).alias("dangling_voices"),
        F.sum("left").alias("balance"),
        F.max("high").alias("max_voice_depth"),
        F.min("pitch").alias("min_pitch"),
        F.max("pitch").alias("max_pitch"),
    )


def complexity_profile(events: DataFrame, roll: DataFrame, frames: int) -> DataFrame:
    """Per track: events, events for each 100 frames, mean and largest polyphony, share of frames with 2 or more and 4 or more."""
    counts = events.groupBy("track").agg(F.count("*").alias("events"))
    per_frame = roll.groupBy("track", "frame").agg(F.count("*").alias("n"))
    poly = per_frame.groupBy("track").agg(
        F.sum("n").alias("cells"), F.max("n").alias("max_polyphony"), F.count_if(F.col("n") >= 2).alias("two"), F.count_if(F.col("n") >= 4).alias("four")
    )
    return counts.join(poly, "track", "left").select(
        "track",
        "events",
        F.round(F.col("events") * 100 / frames, 6).alias("event_rate"),
        F.round(F.coalesce("cells", F.lit(0)) / frames, 6).alias("mean_polyphony"),
        F.coalesce("max_polyphony", F.lit(0)).alias("max_polyphony"),
        F.round(F.coalesce("two", F.lit(0)) / frames, 6).alias("share_two"),
        F.round(F.coalesce("four", F.lit(0)) / frames, 6).alias("share_four"),
    )


def absolute_messages(events: DataFrame, low: int, high: int, rate: int = 960) -> DataFrame:
    """MIDI messages of one reference each (ref, seconds, on, channel, pitch, velocity) at wall-clock ticks.

    Pitches outside low..high go; ties of a rounded tick go to the even number; at a tick old notes end before new ones begin.
    """
    tick = F.greatest(F.rint(F.col("seconds") * rate), F.lit(0.0)).cast("long")
    velocity = F.when(F.col("on") == 1, F.greatest(F.least("velocity", F.lit(127)), F.lit(1))).otherwise(0).cast("int")
    rows = events.where(F.col("pitch").between(low, high)).select("ref", tick.alias("tick"), "on", "channel", "pitch", velocity.alias("velocity"))
    order = W.partitionBy("ref").orderBy("tick", "on", "channel", "pitch", "velocity")
    return rows.withColumn("seq", F.row_number().over(order)).withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0)))


def label_events(labels: DataFrame) -> DataFrame:
    """Events of labels (ref, start, end, midi, velocity, string): a string 0..5 is its channel, any other plays on 0; empty labels go."""
    channel = F.when(F.col("string").between(0, 5), F.col("string")).otherwise(0).cast("int")
    velocity = F.rint(F.coalesce("velocity", F.lit(80.0))).cast("int")
    pair = F.array(F.struct(F.col("start").cast("double").alias("seconds"), F.lit(1).alias("on"), velocity.alias("velocity")), F.struct(F.col("end").cast("double").alias("seconds"), F.lit(0).alias("on"), F.lit(0).alias("velocity")))
    return labels.where("`end` > start").select("ref", channel.alias("channel"), F.col("midi").cast("int").alias("pitch"), F.explode(pair).alias("m")).select("ref", "channel", "pitch", "m.*")


def tempo_events(messages: DataFrame, per_beat: int, tempo: int = 500_000) -> DataFrame:
    """Events of messages (ref, seq, delta, tempo or null, on or null, channel, pitch, velocity) with the tempo map worked into seconds.

    A message's delta passes at the tempo set before it. A note-on of velocity 0 is a note-off.
    """
    order = W.partitionBy("ref").orderBy("seq")
    before = F.coalesce(F.last("tempo", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(tempo))
    timed = messages.withColumn("passed", (F.col("delta") * before).cast("long"))  # whole numbers, so that sums are exact
    timed = timed.withColumn("seconds", F.sum("passed").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.lit(per_beat * 1e6))
    on = F.when((F.col("on") == 1) & (F.col("velocity") > 0), 1).otherwise(0)
    return timed.where("on is not null").select("ref", "channel", "pitch", "seconds", on.alias("on"), F.when(on == 1, F.col("velocity")).otherwise(0).alias("velocity"))


def routed(plan: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Events of each planned reference (ref, kind) from the source of its kind."""
    out = None
    for kind, events in sources.items():
        one = events.join(plan.where(F.col("kind") == kind).select("ref"), "ref", "left_semi").select("ref", F.lit(kind).alias("kind"), "seconds", "on", "channel", "pitch", "velocity")
        out = one if out is None else out.unionByName(one)
    return out


def unsupported(plan: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Planned references of a kind that has no source: empty when the plan can be carried out."""
    return plan.where(~F.col("kind").isin(*sources) | F.col("kind").isNull())


def all_notes_off(midi: DataFrame, upto: int) -> DataFrame:
    """Note-offs at tick `upto` for every voice that then sounds: the panic message, one for each voice."""
    sounding = midi.where(F.col("tick") <= upto).groupBy(*VOICE).agg(F.max_by("on", "seq").alias("last"))
    return sounding.where("last = 1").select(*VOICE, F.lit(upto).cast("long").alias("tick"), F.lit(0).alias("on"), F.lit(0).alias("velocity"))
