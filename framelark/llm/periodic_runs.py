"""Periodic runs of words: stretches that repeat themselves, found exactly, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least max(6, 4 q) that no neighbouring word extends. Method: for every period p up to a
quarter of a text, a grid of points 3 p apart. A run of period p holds at least 3 p places whose word
equals the one p further, so a point of the grid is among them. From every pair (p, point) the stretch
is extended both ways as far as words p apart are equal: the longest common extension, searched by
halving on prefix hashes, for all pairs of all texts of a slice at once. There are n / 3 (1 + 1/2 +
1/3 + ...) points for n words. A multiple of a run's period finds the same stretch again; the smallest
period of a stretch is kept. Hashes only ever make an extension too long, so each run is confirmed on
the words themselves, and pairs whose run isn't confirmed are extended word by word.

`find_runs` gives for each document its words, its runs as (start, length, period) and the text in
which each run is cut down to its first q words.

Scale: a document is read by one task and nothing is shuffled. Texts come in slices of about half a
megabyte, and pairs are made in blocks of PAIRS, so memory is bounded by the longest text alone.

Edge cases: null, empty and wordless texts have no words and no runs, and collapse to an empty text.
Words are compared as they are (no folding of case). Documents with repeated, equal or null ids are
looked at each for itself; an empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches
from framelark.llm.textscan import NON_SPACE, Words, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
PAIRS = 1 << 20  # pairs (period, point) handled at once

MODULI = (2147483647, 2147483629)  # two primes below 2**31: products fit 64 bits
BASES = (1103515245, 1664525347)


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words and for no others."""
    data = w.buf[NON_SPACE[w.buf]]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class PrefixHashes:
    """Hashes of all stretches of a sequence: two sums of words times powers of a base, modulo a prime each."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.sums, self.powers = [], []
        spread = np.random.default_rng(7).integers(1, MODULI[1], int(numbers.max(initial=0)) + 1)
        for m, base in zip(MODULI, BASES, strict=True):
            power = np.ones(n + 1, np.int64)
            done, step = 1, base
            while done <= n:  # powers by doubling
                k = min(done, n + 1 - done)
                power[done : done + k] = power[:k] * step % m
                done, step = done + k, step * step % m
            terms = spread[numbers] * power[:n] % m
            self.sums.append(np.concatenate([[0], np.cumsum(terms) % m]))
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at a and at b (a < b) of `length` words have the same hash."""
        out = np.ones(len(a), bool)
        for m, s, power in zip(MODULI, self.sums, self.powers, strict=True):
            out &= (s[a + length] - s[a]) % m * power[b - a] % m == (s[b + length] - s[b]) % m
        return out

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of each pair of places, onwards or `back`, at most `most`: halved for all pairs together."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + high[at] + 1) >> 1
            shift = middle if back else 0
            same = self.equal(a[at] - shift, b[at] - shift, middle)
            low[at] = np.where(same, middle, low[at])
            high[at] = np.where(same, high[at], middle - 1)
        return low


def _grid(counts: np.ndarray, first: np.ndarray):
    """Blocks of (text, period, point) with the points as places in all words of the slice."""
    periods = np.where(counts >= LEAST_LENGTH, counts // LEAST_EXPONENT, 0)
    text = np.repeat(np.arange(len(counts)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (LEAST_EXPONENT - 1) * period
    points = -(-(counts[text] - period) // step)
    upto = np.cumsum(points)
    row = 0
    while row < len(text):
        done = int(upto[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        for a in range(0, int(upto[end - 1]) - done, PAIRS):  # one period of a huge text can have more
            k = np.arange(a, min(a + PAIRS, int(upto[end - 1]) - done))
            r = row + np.searchsorted(upto[row:end] - done, k, "right")
            point = k + done - (upto[r] - points[r])
            yield text[r], period[r], first[text[r]] + point * step[r]
        row = end


def _holds(x: np.ndarray, start: int, end: int, p: int, lo: int, hi: int) -> bool:
    """Whether [start, end) in the text [lo, hi) has period p and can't be extended."""
    return (
        bool((x[start : end - p] == x[start + p : end]).all())
        and (start == lo or x[start - 1] != x[start - 1 + p])
        and (end == hi or x[end] != x[end - p])
    )


def _by_word(x: np.ndarray, i: int, p: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch of period p around the place i, word by word."""
    start, end = i, i + p
    while end < hi and x[end] == x[end - p]:
        end += 1
    while start > lo and x[start - 1] == x[start - 1 + p]:
        start -= 1
    return start, end


def runs_in(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start within it, length and period of all runs, by text, start and period.

    `first` has the place of each text's first word in `numbers`, and the number of words as its last value.
    """
    none = np.zeros(0, np.int64)
    counts = np.diff(first)
    if not len(numbers) or counts.max(initial=0) < LEAST_LENGTH:
        return none, none, none, none
    hashes, found = PrefixHashes(numbers), []
    for text, p, i in _grid(counts, first):
        same = np.flatnonzero(numbers[i] == numbers[i + p])  # others extend by nothing
        text, p, i = text[same], p[same], i[same]
        j = i + p
        onward = hashes.extension(i, j, first[text + 1] - j)
        start = i - hashes.extension(i, j, i - first[text], back=True)
        end = j + onward
        long = end - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * p)
        got = np.stack([start, end, p, i, text])[:, long]
        got = got[:, np.lexsort(got[2::-1])]
        found.append(got[:, ~_repeats(got[:3])])
    got = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    got = got[:, np.lexsort(got[2::-1])]
    smallest = ~_repeats(got[:2])
    group, runs = np.cumsum(smallest) - 1, []
    wrong = []
    for g, (start, end, p, i, text) in enumerate(got[:, smallest].T.tolist()):
        if _holds(numbers, start, end, p, int(first[text]), int(first[text + 1])):
            runs.append((text, start - int(first[text]), end - start, p))
        else:
            wrong.append(g)
    if wrong:
        for start, end, p, i, text in got[:, np.isin(group, wrong)].T.tolist():
            start, end = _by_word(numbers, i, p, int(first[text]), int(first[text + 1]))
            if end - start >= max(LEAST_LENGTH, LEAST_EXPONENT * p):
                runs.append((text, start - int(first[text]), end - start, p))
        least: dict[tuple[int, int, int], int] = {}
        for text, start, length, p in runs:
            least[text, start, length] = min(p, least.get((text, start, length), p))
        runs = [(*k, p) for k, p in least.items()]
    runs.sort(key=lambda r: (r[0], r[1], r[3]))
    out = np.array(runs, np.int64).reshape(-1, 4).T
    return out[0], out[1], out[2], out[3]


def _repeats(rows: np.ndarray) -> np.ndarray:
    """Which columns of the sorted table equal the one before."""
    out = np.zeros(rows.shape[1], bool)
    out[1:] = (rows[:, 1:] == rows[:, :-1]).all(axis=0)
    return out


RUN = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def _slice_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, its number of runs, all runs (rows of start, length, period) and the collapsed texts."""
    w = Words(buf, offs, NON_SPACE)
    numbers = word_numbers(w)
    text, start, length, period = runs_in(numbers, w.first)
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, w.first[text] + start + period, 1)
    np.add.at(edge, w.first[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    upto = np.searchsorted(kept, w.first)
    whole = np.diff(upto) == w.counts
    texts = []
    data = buf.tobytes()
    for k in range(len(offs) - 1):
        if whole[k]:
            texts.append(b" ".join(data[offs[k] : offs[k + 1]].split()))
        else:
            at = kept[upto[k] : upto[k + 1]]
            texts.append(b" ".join(data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)))
    return w.counts, np.bincount(text, minlength=len(offs) - 1), np.stack([start, length, period]), texts


@F.arrow_udf(FOUND)
def periodic(texts: pa.Array) -> pa.Array:
    counts, sizes, runs, collapsed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)], []
    for _, _, buf, offs in slices(texts):
        n, k, r, t = _slice_runs(buf, offs)
        counts.append(n)
        sizes.append(k)
        runs.append(r)
        collapsed += t
    start, length, period = np.concatenate(runs, axis=1)
    rows = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], names=["start", "length", "period"])
    ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(counts).astype(np.int64)), pa.ListArray.from_arrays(ends, rows), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["n_words", "runs", "collapsed"],
    )


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, n_words, runs (array of start, length, period, by start and period) and the collapsed text."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("id"), periodic(F.col(text)).alias("found")).select(F.col("id").alias(key), "found.*")


def with_periodic_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `text` of the documents, where those with crc32(id) % 10 = 0 end in a repeated passage.

    With g = crc32(id) / 10, each word from number a = g % n on becomes the word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8): periodic texts of known place and period.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.when(h % 10 == 0, g).alias("g"))
    words = F.filter(F.split(F.col("t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = split.withColumn("w", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p")))
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")
    return cut.select(F.col("id").alias(key), F.when(F.col("a").isNotNull(), made).otherwise(F.col("t")).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers and digests of what `find_runs` gives, with the run of the greatest length / period."""
    # quotients of numbers below 2**27 are equal as doubles only if they are equal
    order = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("n")))
    rows = found.select(key, "n_words", "runs", "collapsed", F.array_max(order).alias("best"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return rows.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.n) div -best.q").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
