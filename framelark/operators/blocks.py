"""Long signals in blocks: halos, causal resampling, and features that depend on all that came before.

A signal is rows (track, block, samples): block b holds the samples from b * span on, all of its signal's
blocks but the last being full. `with_halo` gives each block the samples before it, so frames that reach back over the
border of a block are computed in one task each, and a signal of any length is spread over the cluster.

What has a memory without end (an exponential average) is averaged in each block from nothing; the ends of
a block's averages are sent to the blocks after it, REACH frames far: what comes from further back is below
the precision of a double. So averages, too, need one exchange of short rows and no pass along the signal, and
they do not depend on how blocks are dealt to tasks. Results are the same for any number of tasks, and equal
to those of one pass over the signal up to rounding.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOP, FRAMES = 256, 64  # samples a frame, frames a block
SPAN = HOP * FRAMES


def with_halo(chunks: DataFrame, halo: int, span: int = SPAN) -> DataFrame:
    """(track, block, samples) with `halo`: the last samples of the block before, none for a signal's first block."""
    if not 0 <= halo <= span:
        raise ValueError("a halo reaches into the block before only")
    tails = chunks.select("track", (F.col("block") + 1).alias("block"), F.slice("samples", F.greatest(F.size("samples") - halo + 1, F.lit(1)), halo).alias("halo"))
    empty = F.array().cast("array<float>")
    own = chunks.select("track", "block", F.col("samples").cast("array<float>").alias("samples"))
    return own.join(tails, ["track", "block"], "left").select("track", "block", F.coalesce(F.col("halo").cast("array<float>"), empty).alias("halo"), "samples")


def floats(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    ends = np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy(zero_copy_only=False)])).astype(int)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), kind))


def frames_of(halo: np.ndarray, samples: np.ndarray, size: int, hop: int = HOP, before: int = 0) -> np.ndarray:
    """The last `size` samples up to each frame's sample, from `before` frames before the block on; zeros before the signal's begin."""
    n = -(-len(samples) // hop)
    need = size - 1 + before * hop
    x = np.concatenate([np.zeros(max(need - len(halo), 0), np.float32), halo[max(len(halo) - need, 0) :], samples])
    return np.lib.stride_tricks.sliding_window_view(x, size)[: (n + before - 1) * hop + 1 : hop]


# --- resampling -------------------------------------------------------------------------------------

TAPS, BETA = 257, 8.6
PASS_HZ, STOP_HZ = 10_000.0, 11_025.0
RATE = 22_050


@dataclass(frozen=True)
class Resampler:
    """Causal linear-phase resampling from `rate` to `target`: output m is the input at time m * rate / target, (TAPS - 1) / 2 input samples late."""

    rate: int
    target: int = RATE

    @property
    def up(self) -> int:
        return self.target // gcd(self.rate, self.target)

    @property
    def down(self) -> int:
        return self.rate // gcd(self.rate, self.target)

    def outputs(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def inputs(self, first: int, last: int) -> tuple[int, int]:
        """Range of input samples on which outputs first <= m < last depend; it can begin below 0."""
        return first * self.down // self.up - (TAPS - 1), (last - 1) * self.down // self.up + 1

    def kernels(self) -> np.ndarray:
        """A row of TAPS for each phase; each sums to 1."""
        centre = (TAPS - 1) // 2
        cut = (PASS_HZ + STOP_HZ) / 2 / self.rate
        late = centre - np.arange(self.up)[:, None] / self.up - np.arange(TAPS)
        k = 2 * cut * np.sinc(2 * cut * late) * np.kaiser(TAPS, BETA)
        return k / k.sum(axis=1, keepdims=True)

    def run(self, x: np.ndarray, first_input: int, first: int, last: int) -> np.ndarray:
        """Outputs first..last - 1 from the inputs x that begin at number `first_input`; what is missing, or not finite, is 0."""
        lo, hi = self.inputs(first, last)
        padded = np.zeros(hi - lo)
        a, b = max(lo, first_input), min(hi, first_input + len(x))
        if b > a:
            padded[a - lo : b - lo] = np.nan_to_num(x[a - first_input : b - first_input].astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        m = np.arange(first, last)
        base, phase = m * self.down // self.up, m * self.down % self.up
        kernels, out = self.kernels()[:, ::-1], np.zeros(len(m))
        windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
        for p in np.unique(phase):
            of = np.flatnonzero(phase == p)
            out[of] = windows[base[of] - (TAPS - 1) - lo] @ kernels[p]
        top = np.finfo(np.float32).max
        return np.clip(out, -top, top).astype(np.float32)


def resample(chunks: DataFrame, rate: int, target: int = RATE, span: int = SPAN) -> DataFrame:
    """(track, block, samples) at `target` from chunks at `rate`, blocks of `span` samples each.

    Each input block is sent to the output blocks that need of it: its own time, and the filter's reach beyond.
    """
    r = Resampler(rate, target)
    begin = F.col("block") * span
    # from the first output at or after a block's first input to the last that its last input reaches
    lo = F.floor((begin * r.up + (r.down - 1)) / r.down / span)
    hi = F.floor((begin + F.size("samples") + (TAPS - 2)) * r.up / r.down / span)
    parts = chunks.where(F.size("samples") > 0).select("track", begin.alias("at"), "samples", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("block"))
    ends = chunks.groupBy("track").agg(F.max(begin + F.size("samples")).alias("n"))
    grouped = parts.groupBy("track", "block").agg(F.array_sort(F.collect_list(F.struct("at", "samples"))).alias("parts"))  # 2 or 3 parts, or as many as blocks make one

    def run(batches):
        for batch in batches:
            track, block, got, total = (batch.column(c) for c in ("track", "block", "parts", "n"))
            out, keep = [], []
            for i, (b, pieces, n) in enumerate(zip(block.to_pylist(), got, total.to_pylist(), strict=True)):
                first, last = b * span, min((b + 1) * span, r.outputs(n))
                if last <= first:
                    continue
                at = pieces.values.field("at").to_pylist()
                xs = floats(pieces.values.field("samples"))
                x = np.zeros(at[-1] + len(xs[-1]) - at[0], np.float32)
                for a, piece in zip(at, xs, strict=True):
                    x[a - at[0] : a - at[0] + len(piece)] = piece
                out.append(r.run(x, at[0], first, last))
                keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([track.take(rows), block.take(rows), pa.array(out, pa.list_(pa.float32()))], names=["track", "block", "samples"])

    schema = f"track {chunks.schema['track'].dataType.simpleString()}, block long, samples array<float>"
    return grouped.join(ends, "track").select("track", "block", "parts", "n").mapInArrow(run, schema)


# --- features with averages -------------------------------------------------------------------------


class Frontend:
    """What features of frames are made of. `size`: samples of a frame; `halo`: samples needed before a block."""

    size: int
    before = 0  # frames before the block that `measure` needs
    alpha: float

    @property
    def halo(self) -> int:
        return self.size - 1 + self.before * HOP

    def start(self) -> np.ndarray:
        """The averages before a signal's first frame."""
        raise NotImplementedError

    def measure(self, frames: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """What the frames from number `first` on give by themselves, and the values to be averaged; `before` frames more are given, unless first = 0."""
        raise NotImplementedError

    def finish(self, raw: np.ndarray, values: np.ndarray, earlier: np.ndarray, average: np.ndarray) -> np.ndarray:
        """The features, given each frame's average before and after it."""
        raise NotImplementedError


PRECISION = 2.0**-60


def _reach(frontend: Frontend, frames: int) -> int:
    """Blocks after which the weight of an average has gone below PRECISION."""
    return int(np.ceil(np.log(PRECISION) / np.log(1 - frontend.alpha) / frames))


def _local(values: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential averages from nothing."""
    out, now = np.empty_like(values), np.zeros(values.shape[1])
    for k, row in enumerate(values):
        now = now + alpha * (row - now)
        out[k] = now
    return out


def _measure(frontend: Frontend, tail: int, frames: int):
    """mapInArrow: rows (track, block, place, first, raw, values) of a block for itself and for those after it.

    place: 1.. for the end of the averages of so many blocks ago, 0 for the last `tail` frames of the block before (with their averages from
    nothing), -1 for the block itself.
    """

    def run(batches):
        for batch in batches:
            halos, samples = floats(batch.column("halo")), floats(batch.column("samples"))
            tracks, blocks = batch.column("track"), batch.column("block").to_pylist()
            out: list[tuple] = []
            for i, (b, halo, x) in enumerate(zip(blocks, halos, samples, strict=True)):
                if not len(x):
                    continue
                first = b * frames
                cut = frames_of(halo, x, frontend.size, HOP, frontend.before if first else 0)
                raw, values = frontend.measure(cut, first)
                local = np.concatenate([values[:1] * 0, _local(values, frontend.alpha)])  # before the first frame, and after each
                out.append((i, b, -1, first, raw, values))
                if tail:
                    out.append((i, b + 1, 0, first + len(raw) - tail, raw[-tail:], np.concatenate([values, local[:-1], local[1:]], axis=1)[-tail:]))
                out += [(i, b + k, k, first, raw[:0], local[-1:]) for k in range(1, _reach(frontend, frames) + 2)]
            whole = lambda k, kind: pa.array([o[k] for o in out], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    tracks.take(whole(0, pa.int64())),
                    *(whole(k, pa.int64()) for k in (1, 2, 3)),
                    pa.array([o[4].astype(np.float32).tobytes() for o in out], pa.binary()),
                    pa.array([o[5].astype(np.float64).tobytes() for o in out], pa.binary()),
                ],
                names=["track", "block", "place", "first", "raw", "values"],
            )

    return run


def _finish(frontend: Frontend, tail: int, lags: tuple[int, ...], frames: int):
    """mapInArrow over what `_measure` gives, sorted by block and place from the furthest on: the features of each frame, lagged copies in a row."""
    start = frontend.start()
    width, reach = len(start), _reach(frontend, frames)

    def averages(local: np.ndarray, carry: np.ndarray, k: int) -> np.ndarray:
        """Averages from nothing with what was carried to their block, from its frame k on."""
        return local + carry * (1 - frontend.alpha) ** np.arange(k, k + len(local))[:, None]

    def carried(ends: dict[int, np.ndarray], block: int, ago: int) -> np.ndarray:
        """Averages at the begin of the block `ago` before `block`."""
        keep = (1 - frontend.alpha) ** frames
        out = np.zeros(width)
        for k in range(reach, 0, -1):
            if k + ago in ends:
                out = out + ends[k + ago] * keep ** (k - 1)
        if block - ago <= reach:
            out = out + start * keep ** (block - ago)
        return out

    def run(batches):
        of, ends, before = None, {}, None
        for batch in batches:
            tracks = batch.column("track")
            rows = zip(*(batch.column(c).to_pylist() for c in ("track", "block", "place", "first", "raw", "values")), strict=True)
            out: list[tuple[int, int, np.ndarray]] = []
            for i, (track, block, place, first, raw, values) in enumerate(rows):
                if (track, block) != of:
                    of, ends, before = (track, block), {}, None
                v = np.frombuffer(values)
                if place > 0:
                    ends[place] = v
                    continue
                if place == 0:
                    before = (np.frombuffer(raw, np.float32), v.reshape(-1, 3 * width))
                    continue
                v = v.reshape(-1, width)
                line = averages(np.concatenate([v[:1] * 0, _local(v, frontend.alpha)]), carried(ends, block, 0), 0)
                y = frontend.finish(np.frombuffer(raw, np.float32).reshape(len(v), -1), v, line[:-1], line[1:])
                past = np.zeros((max(lags), y.shape[1]), np.float32)
                if before is not None:
                    px, (pv, earlier, average) = before[0], np.split(before[1], 3, axis=1)
                    carry, k = carried(ends, block, 1), frames - len(pv)
                    t = frontend.finish(px.reshape(len(pv), -1), pv, averages(earlier, carry, k), averages(average, carry, k + 1))
                    past[len(past) - len(t) :] = t
                both = np.concatenate([past, y])
                n = len(past)
                out.append((i, first, np.concatenate([both[n - k : n - k + len(y)] for k in lags], axis=1)))
            if out:
                at = np.concatenate([np.full(len(x), i) for i, _, x in out])
                number = np.concatenate([first + np.arange(len(x)) for _, first, x in out])
                yield pa.RecordBatch.from_arrays([tracks.take(pa.array(at)), pa.array(number), lists(np.concatenate([x for *_, x in out]), pa.float32())], names=["track", "frame", "x"])

    return run


def features(cut: DataFrame, frontend: Frontend, lags: tuple[int, ...] = (0,), frames: int = FRAMES) -> DataFrame:
    """(track, frame, x array<float>) of cut signals (track, block, halo, samples); x has the features of frames `lags` ago in a row, zeros before the begin."""
    if max(lags) > frames:
        raise ValueError("lags reach into the block before only")
    kind = cut.schema["track"].dataType.simpleString()
    measured = cut.mapInArrow(_measure(frontend, max(lags), frames), f"track {kind}, block long, place long, first long, raw binary, values binary")
    # a block and what is sent to it: two rows of frames and a dozen short ones
    dealt = measured.repartition("track", "block").sortWithinPartitions("track", "block", F.col("place").desc())
    return dealt.mapInArrow(_finish(frontend, max(lags), lags, frames), f"track {kind}, frame long, x array<float>")
