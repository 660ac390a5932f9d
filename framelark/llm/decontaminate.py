"""Benchmark decontamination by a generalised suffix automaton of test items.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters
and non-ASCII characters. The words of all items go into one suffix automaton
(each item starts at the root, so no match runs over two items). Document words
are streamed through it: each state holds the longest item passage that ends at
the current word. A word is hit if it lies in an occurrence of a window of an
item: `window` consecutive words, or the whole item if it has fewer.

Before the automaton runs, numpy drops the words that cannot lie in a window:
stretches in which some neighbouring pair of words never stands in an item.

The items are the bounded side. They are cut into blocks of at most
`block_words` words; each block is one automaton and one pass over the
documents. Between passes the documents with their hits so far are written to the shared
folder, so a large benchmark costs passes and disk, not memory or Python workers.

Edge cases: a null text has no words and is clean; items without words are
ignored; equal items are each counted by their own id; items with a null id
still hit words but are not listed; an empty benchmark leaves all documents
clean. Repeated documents are judged each for itself. Other columns pass
through untouched, whatever their names: helper columns take names that are free.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches, fresh, stash
from framelark.llm.textscan import ALNUM, LOWER, Words, slices

WINDOW = 10
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All passages of several word sequences, with the items each one comes from."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[int]] = [set()]
        self.whole: list[list[tuple[int, int]]] = [[]]  # short items that end here: (words, item)
        for k, (_, words) in enumerate(items):
            state = 0
            for w in words:
                state = self._extend(state, w)
                self.owners[state].add(k)
            if len(words) < window:
                self.whole[state].append((len(words), k))
        order = sorted(range(len(self.link)), key=lambda s: -self.length[s])
        for s in order:  # a passage occurs wherever a longer one ends with it
            up = self.link[s]
            if up > 0:
                self.owners[up] |= self.owners[s]
        #: nearest state on the way to the root, itself included, at which a short item ends
        self.out = [-1] * len(self.link)
        for s in reversed(order):
            self.out[s] = s if self.whole[s] else (self.out[self.link[s]] if self.link[s] >= 0 else -1)
        words = [w for _, w in items]
        self.pairs = np.unique(np.array([_pair(a, b) for w in words for a, b in zip(w, w[1:], strict=False)], np.uint64))
        self.singles = np.unique(np.array([w[0] for w in words if len(w) == 1], np.uint64))
        self.least = min((min(len(w), window) for w in words if len(w) > 1), default=window)

    def _new(self, length: int, link: int = -1, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        self.whole.append([])
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        old = nxt[last].get(w)
        if old is not None and length[old] == length[last] + 1:
            return old
        cur = None if old is not None else self._new(length[last] + 1)
        p = last
        if cur is not None:
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
                return cur
        q = nxt[p][w]
        if length[q] == length[p] + 1:
            link[cur] = q
            return cur
        clone = self._new(length[p] + 1, link[q], copy=q)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        if cur is None:
            return clone
        link[cur] = clone
        return cur

    def stream(self, words: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Mark the words of one stretch that lie in windows; collect the items."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        marked = -1
        window = self.window
        for i, w in enumerate(words):
            step = nxt[state].get(w)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = nxt[state].get(w)
            if step is None:
                continue
            state, matched = step, matched + 1
            if matched >= window:
                first = max(marked + 1, i + 1 - matched)
                hit[at + first : at + i + 1] = True
                marked = i
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.owners[s]
            s = self.out[state]
            while s > 0:
                for n, k in self.whole[s]:
                    if n <= matched:
                        hit[at + i + 1 - n : at + i + 1] = True
                        found.add(k)
                s = self.out[link[s]]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Hit words, and the items found in each text, for texts whose words begin at `first`."""
        hit = np.zeros(len(h), bool)
        found: dict[int, set[int]] = {}
        if not len(h):
            return hit, found
        runs = []
        if len(self.pairs) and len(h) > 1:
            good = _member(_pair(h[:-1], h[1:]), self.pairs)
            cuts = first[1:-1]
            good[cuts[(cuts > 0) & (cuts < len(h))] - 1] = False
            edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            keep = b - a >= self.least
            runs += [*zip(a[keep].tolist(), b[keep].tolist(), strict=True)]
        if len(self.singles):
            runs += [(i, i + 1) for i in np.flatnonzero(_member(h, self.singles)).tolist()]
        if runs:
            owner = np.searchsorted(first, [a for a, _ in runs], "right") - 1
            for (a, b), d in zip(runs, owner.tolist(), strict=True):
                got: set[int] = set()
                self.stream(h[a:b].tolist(), hit, a, got)
                if got:
                    found.setdefault(d, set()).update(got)
        return hit, found


def _pair(a, b):
    if isinstance(a, int):
        return (a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29)) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted `table`; a bitmap of low bits sorts out most first."""
    bits = max(16, int(len(table) * 16).bit_length())
    seen = np.zeros(1 << bits, bool)
    low = np.uint64((1 << bits) - 1)
    seen[table & low] = True
    out = seen[x & low]
    at = np.flatnonzero(out)
    y = x[at]
    out[at] = table[np.minimum(np.searchsorted(table, y), len(table) - 1)] == y
    return out


_built: dict[str, SuffixAutomaton] = {}


def _words(texts: pa.Array) -> list[list[int]]:
    out = []
    for _, _, buf, offs in slices(texts):
        w = Words(LOWER[buf], offs, ALNUM)
        h = w.hashes()
        out += [h[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def item_blocks(items: DataFrame, text: str, key: str, block_words: int):
    """Items in driver memory one block at a time, each of at most `block_words` words (or one item)."""
    block, size = [], 0
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        n = len(r.t.split()) + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.k, r.t))
        size += n
    if block:
        yield block


def _union(a: list, b: list) -> list[list[int]]:
    """Spans [from, to) of both lists, those that touch joined."""
    merged: list[list[int]] = []
    for lo, hi in sorted([*a, *b]):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return merged


def benchmark_hits(text: Column, block: list[tuple[str, str]], window: int, spark, before: Column | None = None) -> Column:
    """Struct of (n_words, hit word spans [from, to), ids of the items found) for one block of items, joined to the hits `before`."""
    ident = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(block)

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        sam = _built.get(ident)
        if sam is None:
            items = _words(pa.array([t for _, t in shared.value], pa.string()))
            _built.clear()
            sam = _built[ident] = SuffixAutomaton([(k, w) for k, w in enumerate(items) if w], window)
            sam.names = [n for (n, _), w in zip(shared.value, items, strict=True) if w]
        n_words, spans, items = [], [], []
        for lo, hi, buf, offs in slices(texts):
            w = Words(LOWER[buf], offs, ALNUM)
            hit, found = sam.hits(w.hashes(), w.first)
            n_words += w.counts.tolist()
            for d in range(hi - lo):
                got = found.get(d)
                if not got:
                    spans.append([])
                    items.append([])
                    continue
                edge = np.diff(np.concatenate([[0], hit[w.first[d] : w.first[d + 1]].view(np.int8), [0]]))
                spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist())
                items.append(sorted({sam.names[k] for k in got if sam.names[k] is not None}))
        for d, old in enumerate(earlier.to_pylist()):
            if old is not None and old["items"] + old["spans"]:
                spans[d], items[d] = _union(old["spans"], spans[d]), sorted({*old["items"], *items[d]})
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
            names=HITS.fieldNames(),
        )

    # not deterministic to the planner: so a filter on the hits doesn't scan the texts once more
    return scan.asNondeterministic()(text, F.lit(None).cast(HITS) if before is None else before)


def with_hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_key: str = "item_id",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    into: str = "hits",
) -> DataFrame:
    """`docs` with a column `into` (a name that is free): the struct of `benchmark_hits` over all items."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = [F.col(c) for c in docs.columns]
    out = None
    for block in item_blocks(items, item_text, item_key, block_words):
        if out is None:
            out = docs.select(*own, benchmark_hits(F.col(text), block, window, spark).alias(into))
        else:
            out = stash(out).select(*own, benchmark_hits(F.col(text), block, window, spark, F.col(into)).alias(into))
    return docs.select(*own, benchmark_hits(F.col(text), [], window, spark).alias(into)) if out is None else out


def _n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per document: its words, its hit words, the items found and a digest of their ids."""
    found = with_hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), items, into="hits", **kw)
    hits = F.col("hits")
    return found.select(
        F.col("key").alias(key),
        hits["n_words"].alias("n_words"),
        _n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (_n_hit(hits) > 0).alias("contaminated"),
    )


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, cut in zip(texts, spans.to_pylist(), strict=True):
        if not cut or not t.is_valid:
            out.append(t.as_py())
            continue
        raw = t.as_py().encode()
        buf = np.frombuffer(raw, np.uint8)
        w = Words(LOWER[buf], np.array([0, len(buf)]), ALNUM)
        kept, at = [], 0
        for lo, hi in cut:
            kept.append(raw[at : int(w.start[lo])])
            at = int(w.end[hi - 1])
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", least_words: int = 10, most_share: float = 0.5, **kw
) -> DataFrame:
    """`docs` without benchmark passages.

    Hit spans are cut out of the text. A document goes as a whole if more than
    `most_share` of its words are hit, or if fewer than `least_words` words are
    left after a cut. Untouched documents keep their text byte for byte.
    """
    into = fresh(docs, "_hits")
    out = with_hits(docs, items, text=text, into=into, **kw)
    hits = F.col(into)
    n_hit, n = _n_hit(hits), hits["n_words"]
    gone = (n_hit > 0) & ((n_hit > most_share * n) | (n - n_hit < least_words))
    return out.where(~gone).select(*(_cut(F.col(c), hits["spans"]).alias(c) if c == text else F.col(c) for c in docs.columns))
