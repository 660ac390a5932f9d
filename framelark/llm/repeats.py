"""Repeated passages: recurring phrases are confirmed, compiled into sharded
Aho-Corasick automata, and located in all documents.

A window is WINDOW consecutive words of one document. A window is removed if its
words also start earlier: in a document with a smaller id, or earlier in the
same document. Every word of a removed window is cut.

1. Anchors. Each window has a minimizer: the smallest hash among its 6-word runs.
   Equal windows have equal minimizers, so a window can only recur if its anchor does.
   Anchors are counted over all documents (8 bytes each, summed map-side first).
2. Runs. Consecutive windows with the same recurring anchor form a run. Its words
   go to the shard of the anchor. Nothing else of a text leaves its document, so all documents are streamed, but each
   only to the automata that can hold something of it.
3. Phrases. In a shard the windows whose hashes occur twice or more are confirmed, and their words
   compiled, as word numbers, into Aho-Corasick automata of bounded size. A run that
   only occurs as a whole is one phrase; else each of its windows is.
4. Occurrences. All runs of the shard are streamed through the automata, which locate every occurrence of each
   phrase by its words; the first stays, the others are removed.

Anchors met more than HOT times are not left to one task. Their windows (first
occurrence and count) are summed up by a groupBy on the words, and those that occur once are
dropped. The confirmed ones of an anchor are dealt by their words over buckets of about
AUTOMATON_PHRASES, and a run goes to the buckets of its windows. Each bucket is dealt
over sub-shards by document, one for every HOT occurrences of the anchor by bucket, and its phrases to all of them. So a passage that a third of
all documents share is spread, and no task holds more phrases than a bucket.

Equality of windows is decided on the words themselves, inside the automata. Hashes
only choose what is compared.

Edge cases: null and wordless texts have 0 words and keep nothing (the digest of the
empty string). Documents of fewer than WINDOW words are never touched. A null
id counts as larger than every other. Rows that share an id are compared by
start only: an equal start in a row of the same id is not earlier. An empty table gives
an empty result. Other columns pass through `without_repeats` under their own names, whatever they
are: helper columns take names that are free.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches, fresh, id_numbers, is_number, small, stash
from framelark.llm.textscan import NON_SPACE, Words, inside, slices, windows

WINDOW = 20
GRAM = 6
HOT = 4_000  # occurrences of an anchor from which its runs are spread, and of which a task then gets about so many
AUTOMATON_PHRASES = 20_000
LAST_ID = 2**63 - 1


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i with a full window."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(out) - (width - have)], out[width - have :])
    return out


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of one text its minimizer; empty if the text is shorter than a window."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    return _slide(windows(h, GRAM), window - GRAM + 1, np.minimum)


def picked_grams(h: np.ndarray, window: int) -> np.ndarray:
    """The 6-word runs of one text that are the minimizer of some window, one entry for each position."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    grams, width = windows(h, GRAM), window - GRAM + 1
    least = _slide(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return grams[grams == _slide(np.concatenate([pad, least, pad]), width, np.maximum)]


ANCHORS = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())]))


def anchors(window: int):
    """Arrow UDF: the distinct anchors of each text and at how many positions each one occurs."""

    @F.arrow_udf(ANCHORS)
    def find(texts: pa.Array) -> pa.Array:
        sizes, hs, ns = [0], [], []
        for lo, hi, buf, offs in slices(texts):
            w = Words(buf, offs, NON_SPACE)
            h = w.hashes()
            for d in range(hi - lo):
                picked = picked_grams(h[w.first[d] : w.first[d + 1]], window)
                if len(picked):
                    u, n = np.unique(picked, return_counts=True)
                    hs.append(u.view(np.int64))
                    ns.append(n.astype(np.int32))
                    sizes.append(len(u))
                else:
                    sizes.append(0)
        values = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64)), pa.array(np.concatenate(ns) if ns else np.zeros(0, np.int32))], names=["h", "n"]
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)

    return find


#: kind 0: sums of a hot window, 1: a run of a hot anchor, 2: any other run
#: total: occurrences of a hot anchor
RUNS = "shard long, kind int, rid long, id long, start int, words string, n int, total long"
HELD_PHRASES = 50_000


def runs_of(window: int, sums_only: bool = False):
    """mapInArrow: the runs of each text whose anchors are in `cold` or `hot`, or else the sums of hot windows; shard is the anchor."""

    def cut(batches):
        out: list[list] = [[] for _ in range(8)]
        held = 0
        sums: dict[tuple[int, bytes], list] = {}

        def put(*row) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def batch_of() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            arrays[5] = arrays[5].cast(pa.string())
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "kind", "rid", "id", "start", "words", "n", "total"])

        def phrases():
            for (key, words), (at, start, n, total) in sums.items():
                put(key, 0, None, at, start, words, n, total)
                if len(out[0]) >= 20_000:
                    yield batch_of()
            sums.clear()
            if out[0]:
                yield batch_of()

        for batch in batches:
            if sums_only:
                batch = batch.filter(pc.greater(pc.list_value_length(batch["hot"]), 0))
            rids, ids = batch["rid"].to_pylist(), batch["id"].to_pylist()
            cold, hot = batch["cold"], batch["hot"]
            for lo, hi, buf, offs in slices(batch["text"]):
                raw = buf.tobytes()
                w = Words(buf, offs, NON_SPACE)
                h = w.hashes()
                for d in range(hi - lo):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    m = minimizers(h[a:b], window)
                    if not len(m):
                        continue
                    rid, ident = rids[lo + d], ids[lo + d]
                    edges = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                    keys = m[edges].view(np.int64)
                    totals = {x["h"]: x["n"] for x in hot[lo + d].as_py()}
                    is_hot = np.isin(keys, np.fromiter(totals, np.int64, len(totals)))
                    wanted = is_hot if sums_only else is_hot | np.isin(keys, np.asarray(cold[lo + d].values))
                    ends = np.concatenate([edges[1:], [len(m)]])
                    for k in np.flatnonzero(wanted).tolist():
                        i, j, key = int(edges[k]), int(ends[k]) + window - 1, int(keys[k])  # words [i, j)
                        words = [raw[s:e] for s, e in zip(w.start[a + i : a + j].tolist(), w.end[a + i : a + j].tolist(), strict=True)]
                        text = b" ".join(words)
                        if not sums_only:
                            held += len(text) + 60
                            put(key, 1 if is_hot[k] else 2, rid, ident, i, text, 1, totals.get(key))
                            continue
                        for x in range(j - i - window + 1):
                            phrase = (key, b" ".join(words[x : x + window]))
                            old = sums.get(phrase)
                            if old is None:
                                sums[phrase] = [ident, i + x, 1, totals[key]]
                            else:
                                old[:2] = min((old[0], old[1]), (ident, i + x))
                                old[2] += 1
                    if held > 4 << 20:
                        yield batch_of()
                        held = 0
                    if len(sums) > HELD_PHRASES:
                        yield from phrases()
                        held = 0
        yield from phrases()

    return cut


class Locator:
    """Confirmed phrases of a shard as automata of bounded size over word numbers."""

    def __init__(self, window: int):
        self.window = window
        self.numbers: dict[str, int] = {}
        self.automata: list = []
        self.first: list[tuple[int, int] | None] = []  # first occurrence of each phrase
        self.length: list[int] = []
        self._open = None

    def number(self, words: str) -> tuple[int, ...]:
        numbers = self.numbers
        return tuple([numbers.setdefault(w, len(numbers)) for w in words.split(" ")])

    def known(self, words: str) -> tuple[int, ...]:
        """As `number`, with one number for all words that are in no phrase."""
        get, none = self.numbers.get, len(self.numbers)
        return tuple([get(w, none) for w in words.split(" ")])

    def add(self, phrase: tuple[int, ...], first: tuple[int, int] | None = None) -> None:
        if self._open is None or len(self._open) >= AUTOMATON_PHRASES:
            self._open = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            self.automata.append(self._open)
        self._open.add_word(phrase, len(self.first))
        self.first.append(first)
        self.length.append(len(phrase))

    def compile(self) -> None:
        for a in self.automata:
            a.make_automaton()

    def locate(self, numbers: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """(start within the run, windows, phrase) of every located phrase, sorted."""
        length, w = self.length, self.window
        return sorted((end - length[k] + 1, length[k] - w + 1, k) for a in self.automata for end, k in a.iter(numbers))

    def meet(self, located: list[tuple[int, int, int]], at: int, start: int) -> None:
        """Count an occurrence of what was located in a run of document `at` that begins at `start`."""
        for i, _, k in located:
            if self.first[k] is None or (at, start + i) < self.first[k]:
                self.first[k] = (at, start + i)


def _ranges(starts: list[int]) -> list[list[int]]:
    """Sorted positions as [from, to) ranges."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return out


CUTS = "rid long, cuts array<array<int>>"
_CUT_TYPE = pa.list_(pa.list_(pa.int32()))


def _removed(locator: Locator, rows: list[tuple], located: dict[str, list]) -> pa.RecordBatch:
    """Which windows of each run (rid, id, start, words) are not in the first occurrence of their phrase."""
    rids, cuts = [], []
    for rid, at, start, words in rows:
        gone = sorted({start + i + x for i, n, k in located.get(words, ()) if locator.first[k] < (at, start + i) for x in range(n)})
        if gone:
            rids.append(rid)
            cuts.append(_ranges(gone))
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(cuts, _CUT_TYPE)], names=["rid", "cuts"])


def _window_hashes(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place within it, hash) of every window of some texts, in order."""
    parts = []
    for lo, _, buf, offs in slices(pa.array(texts, pa.string())):
        w = Words(buf, offs, NON_SPACE)
        starts = np.flatnonzero(inside(w.first, window, len(w)))
        doc = w.doc[starts]
        parts.append((lo + doc, starts - w.first[doc], windows(w.hashes(), window)[starts]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _cold(window: int, groups: list[list[tuple]]) -> pa.RecordBatch:
    """Confirm, compile and locate the runs of some anchors."""
    copies: dict[str, list] = {}  # of each different run
    alone: set[str] = set()  # runs that are the only one of their anchor
    for rows in groups:
        for _, at, start, words in rows:
            copies.setdefault(words, []).append((at, start))
        if all(r[3] == rows[0][3] for r in rows):
            alone.add(rows[0][3])
    texts = list(copies)
    of, place, hashes = _window_hashes(texts, window)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    times = np.bincount(which, np.array([len(copies[t]) for t in texts], np.int64)[of], len(first))
    confirmed = times[which] > 1
    n_windows, n_confirmed, n_first = (np.bincount(x, minlength=len(texts)) for x in (of, of[confirmed], of[first]))

    locator = Locator(window)
    numbers = {t: locator.number(texts[t]) for t in np.flatnonzero(n_confirmed).tolist()}
    whole = {t for t in numbers if texts[t] in alone and n_first[t] == n_windows[t] == n_confirmed[t]}
    for t in whole:
        locator.add(numbers[t])
    for k in first[confirmed[first]].tolist():
        t = int(of[k])
        if t not in whole:
            locator.add(numbers[t][int(place[k]) : int(place[k]) + window])
    locator.compile()
    located = {texts[t]: locator.locate(x) for t, x in numbers.items()}
    for words, found in located.items():
        for at, start in copies[words]:
            locator.meet(found, at, start)
    return _removed(locator, [r for rows in groups for r in rows], located)


def locate(window: int):
    """mapInArrow over rows of RUNS sorted by shard and kind: the removed windows of each run."""

    def run(batches):
        shard, kind = None, None
        groups: list[list[tuple]] = []  # cold
        held = 0
        sums: dict[str, list] = {}  # hot
        locator, located, rows = Locator(window), {}, []

        def hot_rows():
            for r in rows:
                if r[3] not in located:
                    located[r[3]] = locator.locate(locator.known(r[3]))
            done = _removed(locator, rows, located)
            rows.clear()
            located.clear()
            return done

        for batch in batches:
            for key, what, rid, at, start, words, n in zip(*(batch[c].to_pylist() for c in ("shard", "kind", "rid", "id", "start", "words", "n")), strict=True):
                if key != shard or (what == 2) != (kind == 2):
                    if rows:
                        yield hot_rows()
                    locator, sums = Locator(window), {}
                    if held >= 2 * AUTOMATON_PHRASES:
                        yield _cold(window, groups)
                        groups, held = [], 0
                    if what == 2:
                        groups.append([])
                shard, kind = key, what
                if what == 2:
                    groups[-1].append((rid, at, start, words))
                    held += 4
                elif what == 0:
                    old = sums.setdefault(words, [(at, start), 0])
                    old[0] = min(old[0], (at, start))
                    old[1] += n
                else:
                    if sums:
                        for phrase, (first, count) in sums.items():
                            if count > 1:
                                locator.add(locator.number(phrase), first)
                        locator.compile()
                        sums = {}
                    rows.append((rid, at, start, words))
                    if len(rows) >= 5_000:
                        yield hot_rows()
        if rows:
            yield hot_rows()
        if groups:
            yield _cold(window, groups)

    return run


def dealt(texts: DataFrame, window: int, hot: int = HOT) -> DataFrame:
    """The rows that `locate` takes: cold runs by anchor, confirmed hot windows and hot runs by bucket and salt."""
    first = F.min(F.struct("id", "start"))
    sums = texts.mapInArrow(runs_of(window, True), RUNS).groupBy("shard", "words").agg(first.alias("first"), F.sum("n").alias("n"), F.max("total").alias("total")).where("n > 1")
    # a row for AUTOMATON_PHRASES phrases at least, so this side is small
    buckets = sums.groupBy("shard").count().where(F.col("count") > AUTOMATON_PHRASES)
    buckets = small(stash(buckets.select("shard", F.ceil(F.col("count") / AUTOMATON_PHRASES).alias("_b"))))
    bucket = lambda words: F.pmod(F.xxhash64(words), F.coalesce("_b", F.lit(1)))
    salts = F.ceil(F.col("total") / (F.lit(hot) * F.coalesce("_b", F.lit(1))))
    phrases = sums.join(buckets, "shard", "left").select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), salts - 1), lambda s: F.xxhash64("shard", bucket(F.col("words")), s))).alias("shard"),
        F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rid"), "first.id", "first.start", "words", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"),
    )
    words = F.split("words", " ")
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: bucket(F.array_join(F.slice(words, i, F.lit(window)), " ")))
    own = F.when(F.col("_b").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(each))
    shards = F.when(F.col("kind") == 2, F.array("shard")).otherwise(F.transform(own, lambda b: F.xxhash64("shard", b, F.pmod("rid", salts))))
    runs = texts.mapInArrow(runs_of(window), RUNS).join(buckets, "shard", "left")
    runs = runs.select(F.explode(shards).alias("shard"), "kind", "rid", "id", "start", "words", "n")
    return phrases.unionByName(runs)


def with_cuts(docs: DataFrame, into: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """`docs` with a column `into` (a name that is free): ranges [from, to) of starts of removed windows (null: none)."""
    bounded_batches(docs.sparkSession)
    rid = F.xxhash64(F.col(key), F.coalesce(text, F.lit("")))
    listed = stash(docs.select(rid.alias("rid"), F.explode(anchors(window)(F.col(text))).alias("a")).select("rid", "a.h", "a.n"))
    counted = listed.groupBy("h").agg(F.sum("n").alias("n"))
    recurring = stash(counted.where("n > 1").select("h", F.col("n").alias("total"), (F.col("n") > hot).alias("hot")))
    wanted = (
        listed.select("rid", "h")
        .join(recurring, "h")
        .groupBy("rid")
        .agg(F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.struct("h", F.col("total").alias("n")))).alias("hot"))
    )  # a document's own anchors
    # both joins read the same columns, so texts are shuffled once; the caller's travel as one struct, so no name of theirs meets one used here
    keyed = docs.select(rid.alias("key"), F.struct(*(F.col(c) for c in docs.columns)).alias("own"))
    found = keyed.join(wanted, F.col("key") == F.col("rid"))
    if is_number(docs, key):
        number = F.col("own")[key].cast("long")
    else:  # ids of another type go by their place in their order
        found, number = found.join(id_numbers(docs, key), F.col("own")[key] == F.col("_id"), "left"), F.col("_n").cast("long")
    ident = F.coalesce(number, F.lit(LAST_ID))
    runs = dealt(found.select("rid", ident.alias("id"), F.col("own")[text].alias("text"), "cold", "hot"), window, hot)
    cuts = runs.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(locate(window), CUTS)
    cuts = cuts.groupBy("rid").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    return keyed.join(cuts, F.col("key") == F.col("rid"), "left").select("own.*", F.col("cuts").alias(into))


def _gone(n: int, cuts: list | None, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for lo, hi in cuts or ():
        step[lo] += 1
        step[min(hi - 1 + window, n)] -= 1
    return np.cumsum(step[:n]) > 0


DIGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def digest(window: int):
    @F.arrow_udf(DIGEST)
    def sums(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        n, removed, shas = [], [], []
        for lo, hi, buf, offs in slices(texts):
            raw, w = buf.tobytes(), Words(buf, offs, NON_SPACE)
            for d in range(hi - lo):
                a, b = int(w.first[d]), int(w.first[d + 1])
                mine = cuts[lo + d].as_py()
                if mine:
                    gone = _gone(b - a, mine, window)
                    kept = np.flatnonzero(~gone) + a
                    words = [raw[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True)]
                    removed.append(int(gone.sum()))
                    joined = b" ".join(words)
                else:
                    removed.append(0)
                    joined = b" ".join(raw[int(offs[d]) : int(offs[d + 1])].split())
                n.append(b - a)
                shas.append(hashlib.sha256(joined).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=DIGEST.fieldNames())

    return sums


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **kw) -> DataFrame:
    """Per document: its words, the removed words, and a digest of the kept ones joined by spaces."""
    cut = with_cuts(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "cuts", "doc", "text", window, **kw)
    return cut.select(F.col("doc").alias(key), digest(window)(F.col("text"), F.col("cuts")).alias("s")).select(key, "s.*")


def _cut_text(window: int):
    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, mine in zip(texts, cuts, strict=True):
            mine, t = mine.as_py(), t.as_py()
            if not mine or t is None:
                out.append(t)
                continue
            raw = t.encode()
            w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NON_SPACE)
            edge = np.diff(np.concatenate([[0], _gone(len(w), mine, window).view(np.int8), [0]]))
            kept, at = [], 0
            for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                kept.append(raw[at : int(w.start[lo])])
                at = int(w.end[hi - 1])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return cut.asNondeterministic()  # to the planner: so a filter on the new text doesn't cut once more


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **kw) -> DataFrame:
    """`docs` with repeated passages cut out of the texts; a document of which no word is left goes."""
    into = fresh(docs, "_cuts")
    cut = with_cuts(docs, into, key, text, window, **kw)
    new = cut.select(*(_cut_text(window)(F.col(c), F.col(into)).alias(c) if c == text else F.col(c) for c in docs.columns), into)
    return new.where(F.col(into).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]")).drop(into)
