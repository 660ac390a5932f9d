"""Language-model scores under a hierarchical Pitman-Yor model.

Two levels of restaurants over a uniform base: the root (unigrams), and one
restaurant for each preceding word of the training texts (and for the begin of a
text), all sharing the root as parent. Every training token is a customer of the
restaurant of the word before it; a customer that opens a table there is a customer
of the root.

Seating is sampled by Gibbs: in each sweep customers get up one after the other and are seated anew by
the Chinese restaurant rule, given where all others sit: at a table of their dish in proportion to its
customers less the discount, or at a new one in proportion to the restaurant's pull and the root's
probability of the dish. Every customer of every dish gets up once in each sweep: dishes of up to ALONE customers
side by side, longer ones by themselves. After BURN sweeps SAMPLES sweeps are kept, and
a text's probability uses the predictive probabilities averaged over them. Discounts and strengths
start at START and are drawn once from their posterior (auxiliary variables) given the first seating.

The jobs:

1. Words of each chunk of text are counted, to find the TOP most frequent ones (a code of two bytes for them, nothing
   else) and the hot ones (more than 1 / HOT of the tokens).
2. Distinct pairs (preceding word, word) of each chunk go to shards by the preceding word, as arrays; pairs of hot
   preceding words are dealt by the pair. A shard seats its restaurants, and sends tokens and tables of each
   word to the word's part of the root.
3. Parts of the root are seated, and answer the shards that asked for a word.
4. Chunks go to the shards again, with the documents in which each pair stands. A shard seats its restaurants
   given the root, scores all its pairs, and returns sums by chunk and document, which are added up.

So what is gathered is every pair of the corpus, and a task holds one shard of about SHARD tokens or one chunk of
about CHUNK. The driver holds sums, the list of TOP words and the totals of hot restaurants.
Nothing relies on how the input is partitioned from one job to another.

Hashes are sorted together with their places in one number of 64 bits, which numpy sorts several times as fast as it finds an order.

Choices: one customer of each dish moves at a time, all dishes of up to ALONE customers in parallel; so a dish sees its restaurant's tables
without those of the others that have just got up. In restaurants of three dishes and nine customers mean tables
are within 2 % of those of enumeration, in larger ones nearer. A task goes through all customers of a dish: the most frequent pair's grow with the corpus.
Tables of a hot restaurant are summed over its shards once, after job 2, and held through job 4. Words are compared
by 64-bit hashes.

Edge cases: null and empty texts are one end token. A null id counts as an
empty id, whose remainder is 0 (held out); ids can be of any type. Without training texts N and V are 0 and every
probability is the base's. Repeated rows are scored, and counted in training, each for
itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import bounded_batches, stash
from framelark.llm.textscan import LOWER, NON_SPACE, Index, Words, lookup, mix, slices

BURN, SAMPLES = 1, 2
FOLDS = 10
TOP = 65_535
HOT = 1_000
CHUNK, CHUNK_DOCS = 1_000_000, 16_000
PIECE = 3 << 16  # bytes of text handled at once
FEW = 1 << 21  # a chunk of fewer tokens is sorted by leading bits: 11 of them at least tell a word's pairs apart
SHARD = 3_000_000
ALONE = 512
END = np.uint64(0x5BD1E995C6A4A793)
BEGIN = np.uint64(0x2545F4914F6CDD1D)  # the restaurant at the begin of a text
SPELLED = 0xFFFF  # code of a word that is not among the TOP
REPLY, PAIRS, IDS = 0, 1, 2


@dataclass(frozen=True)
class Hyper:
    discount: float = 0.8
    strength: float = 5.0
    root_discount: float = 0.6
    root_strength: float = 10.0


START = Hyper()


# ---- seating ------------------------------------------------------------------


def expected_tables(n: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes with n customers, in expectation; weight: pull of the restaurant times the root's probability."""
    t, j = np.ones(len(n)), np.ones(len(n))
    while (j < n).any():
        step = np.minimum(np.maximum(1.0, np.floor(j / 64)), n - j)
        t += step * weight / (weight + np.maximum(j - discount * t, 1e-9))
        j += step
    return t


def opened(c: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """As `expected_tables` in doubling steps; c is sorted, the largest first."""
    t, j = np.ones(len(c)), 1
    while len(c) and j < c[0]:
        k = int(np.searchsorted(-c, -j, "left"))
        step = np.minimum(j, c[:k] - j)
        w = weight[:k]
        t[:k] += step * w / (w + np.maximum(j + step / 2 - discount * t[:k], 1e-9))
        j *= 2
    return t


class LongDish:
    """The seating of one dish with many customers: the table of each, and the tables' sizes."""

    def __init__(self, n: int, start: int):
        self.n = n
        self.table = np.arange(n, dtype=np.int32) % np.int32(start)
        self.size = np.bincount(self.table, minlength=start).tolist()
        self.free: list[int] = []

    def sweep(self, rnd, tables: float, moves: bool, chance: float, discount: float, strength: float) -> int:
        """Each customer gets up and is seated anew; by how much the number of tables changes. rnd: uniform random numbers; tables: the restaurant's."""
        table, size, free, others = memoryview(self.table), self.size, self.free, self.n - 1
        before = t = now = len(size) - len(free)
        pull = lambda: (strength + discount * (tables + t - before if moves else tables)) * chance
        weight = pull()
        for x in range(self.n):
            a = table[x]
            left = size[a] = size[a] - 1
            if not left:
                free.append(a)
                t -= 1
            if t != now:
                now, weight = t, pull()
            while True:  # a new table, or that of a random other customer, which is rejected so that a table counts its customers less the discount
                v = rnd() * (weight + others) - weight
                if v < 0:
                    if free:
                        a = free.pop()
                    else:
                        a = len(size)
                        size.append(0)
                    size[a] = 1
                    t += 1
                    break
                y = int(v)
                if y < others:
                    a = table[y + (y >= x)]
                    s = size[a]
                    if (v - y) * s < s - discount:
                        size[a] = s + 1
                        break
            table[x] = a
        return t - before


class Seating:
    """Where the customers of some dishes sit.

    n: customers of each dish; at: its restaurant. The table of each customer is kept, here
    for dishes of 2 to ALONE customers: a single one has one table always.
    """

    def __init__(self, n: np.ndarray, at: np.ndarray, restaurants: int, discount: float, strength: float, rng: np.random.Generator, held: np.ndarray | None = None, held_tables: np.ndarray | None = None, chance: np.ndarray | None = None):
        self.discount, self.strength, self.rng, self.of = discount, strength, rng, at
        self.n = n.astype(np.int64)
        moving = np.flatnonzero((self.n >= 2) & (self.n <= ALONE))
        self.dish = moving[np.argsort((-self.n[moving]).astype(np.int16), kind="stable")]
        self.long = np.flatnonzero(self.n > ALONE)
        c = self.c = self.n[self.dish]
        self.off = np.concatenate([[0], np.cumsum(c)])[:-1]
        total = int(c.sum())
        start, longs = np.clip(np.round(c**discount), 1, c), np.round(self.n[self.long] ** discount)
        if chance is not None:  # about as many tables as a sequence of customers opens
            tables = np.bincount(at, np.minimum(self.n, 1), restaurants) + np.bincount(at[self.dish], start - 1, restaurants) + np.bincount(at[self.long], longs - 1, restaurants)
            start = opened(c, (strength + discount * tables[at[self.dish]]) * chance[self.dish], discount)
            start = np.clip(np.floor(start + rng.random(len(c))), 1, c)
            longs = np.round(expected_tables(self.n[self.long].astype(float), (strength + discount * tables[at[self.long]]) * chance[self.long], discount))
        start, longs = start.astype(np.int64), np.clip(longs, 1, self.n[self.long]).astype(np.int64)
        self.long_dishes = [LongDish(int(n), int(k)) for n, k in zip(self.n[self.long], longs, strict=True)]
        within = np.arange(total) - np.repeat(self.off, c)
        self.table = (within % np.repeat(start, c)).astype(np.int32)
        self.size = np.bincount(np.repeat(self.off, c) + self.table, minlength=total).astype(np.int32)
        self.free = (within + np.repeat(start, c)).astype(np.int32)  # tables that are not in use, by dish; the first `n_free` count
        self.n_free = c - start
        self.t = np.minimum(self.n, 1).astype(float)
        self.t[self.dish] = start
        self.t[self.long] = longs
        self.tables = np.bincount(at, self.t, restaurants)
        self.held = np.zeros(restaurants, bool) if held is None else held
        if held_tables is not None:
            self.tables = np.where(self.held, held_tables, self.tables)
        self.moves = ~self.held

    def sweep(self, chance: np.ndarray) -> None:
        """All customers get up and are seated anew; chance: the parent's probability of each dish."""
        rng, d = self.rng, self.discount
        if len(self.long):
            rnd = random.Random(int(rng.integers(1 << 62))).random
            for k, dish in zip(self.long.tolist(), self.long_dishes, strict=True):
                r = int(self.of[k])
                change = dish.sweep(rnd, float(self.tables[r]), bool(self.moves[r]), float(chance[k]), float(d), float(self.strength))
                self.t[k] += change
                self.tables[r] += change if self.moves[r] else 0
        at, chance, t, all_others = self.of[self.dish], chance[self.dish], self.t[self.dish], self.c - 1.0  # in the order of visits
        moves, least = self.moves[at], -self.c
        j = 0
        while True:
            k = int(np.searchsorted(least, -j, "left"))  # those with more than j customers
            if not k:
                break
            off, others, now = self.off[:k], all_others[:k], t[:k]
            x = off + j
            a = off + self.table[x]
            size = self.size[a] - 1
            self.size[a] = size
            left = np.flatnonzero(size == 0)
            self.free[off[left] + self.n_free[left]] = a[left] - off[left]
            self.n_free[left] += 1
            now[left] -= 1
            np.add.at(self.tables, at[left[moves[left]]], -1)
            weight = (self.strength + d * self.tables[at[:k]]) * chance[:k]
            mass = others - d * now
            v = rng.random(k) * (weight + mass) - weight
            opens = v < 0
            new, todo = np.flatnonzero(opens), np.flatnonzero(~opens)
            # at a table: that of a random other customer, rejected so that a table counts its customers less the discount; if there is one table, or a table for each of the others, all are alike
            o, one = others[todo], now[todo]
            v = v[todo] * (o / mass[todo])
            alike = (one == 1) | (one == o)
            while len(todo):
                y = np.minimum(v.astype(np.int64), o.astype(np.int64) - 1)
                v -= y
                y += y >= j
                y = self.table[off[todo] + y]
                b = off[todo] + y
                s = self.size[b]
                took = alike | (v * s < s - d)
                self.table[x[todo[took]]] = y[took]
                self.size[b[took]] = s[took] + 1
                again = np.flatnonzero(~took)
                todo, o, alike = todo[again], o[again], False
                v = rng.random(len(todo)) * o
            self.n_free[new] -= 1
            b = self.free[off[new] + self.n_free[new]]
            self.table[x[new]] = b
            self.size[off[new] + b] = 1
            now[new] += 1
            np.add.at(self.tables, at[new[moves[new]]], 1)
            j += 1
        self.t[self.dish] = t

    def evidence(self) -> np.ndarray:
        """Sums of the auxiliary variables of discount and strength: y, 1 - y, 1 - z, -log x (see `drawn`)."""
        d, s = self.discount, self.strength
        tables, customers = self.tables[self.moves], np.bincount(self.of, self.n, len(self.tables))[self.moves]
        real = customers > 0
        tables, customers = tables[real].astype(np.int64), customers[real]
        most = int(tables.max(initial=1))
        y = np.concatenate([[0, 0], np.cumsum(s / (s + d * np.arange(1, most)))])[tables].sum()
        sizes = np.concatenate([self.size, *(np.array(x.size, self.size.dtype) for x in self.long_dishes)])
        sizes = sizes[sizes > 1]
        z = np.concatenate([[0, 0], np.cumsum((1 - d) / (np.arange(1, int(sizes.max(initial=1))) - d))])[sizes].sum()
        x = self.rng.beta(s + 1, np.maximum(customers[customers > 1] - 1, 1e-9))
        return np.array([y, np.maximum(tables - 1, 0).sum() - y, z, -np.log(np.maximum(x, 1e-300)).sum()])


def drawn(evidence: np.ndarray, seed: int) -> tuple[float, float]:
    """Discount and strength from their posterior given the sums of auxiliary variables, under Beta(1, 1) and Gamma(1, 1)."""
    rng = np.random.default_rng(seed)
    y, not_y, not_z, log_x = evidence
    return float(np.clip(rng.beta(1 + not_y, 1 + not_z), 0.05, 0.95)), float(np.clip(rng.gamma(1 + y) / (1 + log_x), 0.01, 1e4))


# ---- texts, chunks and shards ---------------------------------------------------


def tokens_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and where each text begins."""
    w = Words(LOWER[buf], offs, NON_SPACE)
    n = len(offs) - 1
    out = np.empty(len(w) + n, np.uint64)
    out[np.arange(len(w)) + w.doc] = w.hashes()
    first = w.first + np.arange(n + 1)
    out[first[1:] - 1] = END
    return out, first


def before_of(tokens: np.ndarray, first: np.ndarray, begin) -> np.ndarray:
    """What stands before each token: `begin` at the begin of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[first[:-1]] = begin
    return out


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(((u << np.uint64(1)) | (u >> np.uint64(63))) ^ w)


def by_leading_bits(x: np.ndarray) -> np.ndarray:
    """The places of 64-bit numbers in the order of their leading bits (all but those that a place takes); equal ones keep their order.

    Numbers are sorted several times as fast as places.
    """
    low = np.uint64((1 << len(x).bit_length()) - 1)
    key = x & ~low
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    key &= low
    return key.view(np.int64)


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different 64-bit numbers, sorted, and which of them each is."""
    order = by_leading_bits(x)
    y = x[order]
    if (y[1:] < y[:-1]).any():
        order = np.argsort(x)
        y = x[order]
    differs = np.concatenate([np.ones(min(len(x), 1), bool), y[1:] != y[:-1]])
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(differs) - 1
    return y[differs], at


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part 0 .. parts - 1 of each hash; larger hashes are in later parts."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def chunks(batches):
    """(ids, held_out, tokens, first) of consecutive texts with about CHUNK tokens."""
    parts: list[tuple] = []
    size = docs = 0

    def joined():
        ids, held, tokens, counts = zip(*parts, strict=True)
        return pa.concat_arrays(ids), np.concatenate(held), np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    for batch in batches:
        held_out = np.asarray(batch["held_out"])
        for lo, hi, buf, offs in slices(batch["text"], PIECE):
            tokens, first = tokens_of(buf, offs)
            parts.append((batch["id"].slice(lo, hi - lo), held_out[lo:hi], tokens, np.diff(first)))
            size += len(tokens)
            docs += hi - lo
            if size >= CHUNK or docs >= CHUNK_DOCS:
                yield joined()
                parts, size, docs = [], 0, 0
    if parts:
        yield joined()


def _lists(values: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _rows(schema: pa.Schema, size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


LONG, INT = pa.int64(), pa.int32()


def deal_schema(id_type: pa.DataType) -> pa.Schema:
    many = {"code": INT, "spelled": LONG, "n": INT, "docs": INT, "doc": pa.int16(), "times": INT, "x": pa.float32(), "ids": id_type, "held_out": pa.bool_(), "tokens": INT, "base": pa.float64(), "known": INT}
    return _schema(("shard", LONG), ("kind", INT), ("chunk", LONG), *((k, pa.list_(t)) for k, t in many.items()))


REQUEST = _schema(("part", LONG), ("kind", INT), ("shard", LONG), *((k, pa.list_(LONG)) for k in ("w", "n", "t")), ("sums", pa.list_(pa.float64())))
ANSWER = _schema(("shard", LONG), ("kind", INT), ("w", pa.list_(LONG)), ("n", pa.list_(LONG)), ("x", pa.list_(pa.float32())), ("sums", pa.list_(pa.float64())))


def ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "int32": "int", "int16": "short", "float": "float", "double": "double", "bool": "boolean", "string": "string"}
    return ", ".join(f"{f.name} array<{names[str(f.type.value_type)]}>" if pa.types.is_list(f.type) else f"{f.name} {names[str(f.type)]}" for f in schema)


@dataclass(frozen=True)
class Known:
    """What all tasks know: the TOP words, sorted by hash; count is a first guess until job 3 has counted."""

    top: np.ndarray
    count: np.ndarray
    root: np.ndarray  # root customers less discounts
    hot: np.ndarray  # sorted
    hot_customers: np.ndarray
    hot_tables: np.ndarray
    tokens: float  # of all texts
    shards: int
    train: int = 0
    vocabulary: int = 0
    root_customers: float = 0.0
    root_tables: float = 0.0
    hyper: Hyper = field(default=START)

    def less_discounts(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.maximum(customers - self.hyper.root_discount * tables, 0.0)

    def root_chance(self, x: np.ndarray) -> np.ndarray:
        """The root's predictive probability of words with `x` customers less discounts."""
        h = self.hyper
        return (x + (h.root_strength + h.root_discount * self.root_tables) / (self.vocabulary + 1)) / (h.root_strength + self.root_customers)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.train + 0.1 * (self.vocabulary + 1)))


def _frequent(batches):
    """The counts of the TOP most frequent words of each chunk; a null word has the sum of all."""
    for _, _, tokens, _ in chunks(batches):
        w, n = np.unique(tokens, return_counts=True)
        if len(w) > TOP:
            keep = np.argpartition(-n, TOP)[:TOP]
            w, n = w[keep], n[keep]
        w = pa.array([*w.view(np.int64), None], LONG)
        yield pa.RecordBatch.from_arrays([w, pa.array([*n, len(tokens)], LONG)], names=["w", "n"])


def _deal(known: Known, schema: pa.Schema, with_docs: bool):
    """The pairs of each chunk, by shard; and the chunk's documents, with what is known of their TOP words."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        top, absent = Index(known.top), [0, 0]  # codes -1: another word, -2: the begin of a text
        hot = np.append(lookup(known.hot, known.top) >= 0, absent).astype(bool)  # hot words are among the TOP
        base, seen = np.append(known.base(known.count), absent), np.append(known.count > 0, absent)
        begin = mix(np.array([BEGIN]))[0]
        for ids, held, tokens, first in chunks(batches):
            number += 1
            w_code = top.find(tokens).astype(np.int32)
            u_code = before_of(w_code, first, -2)
            pair = mix(tokens)
            u = before_of(pair, first, begin)
            pair = pair_hash(u, pair)
            place = np.where(hot[u_code], pair, (u & np.uint64(0xFFFFFFFF00000000)) | (pair & np.uint64(0xFFFFFFFF)))
            order = by_leading_bits(place) if len(place) < FEW else np.argsort(place, kind="stable")  # a pair can stand twice beside one whose leading bits are the same: shards merge it
            pair = pair[order]
            differs = np.concatenate([[True], pair[1:] != pair[:-1]])
            pairs = np.flatnonzero(differs)
            at = order[pairs]
            u_code, w_code_at = u_code[at], w_code[at]
            spelled = np.flatnonzero(np.stack([u_code < 0, w_code_at < 0], 1))  # preceding words and words by turns
            words = tokens[at[spelled >> 1] - 1 + (spelled & 1)]
            words[(u_code[spelled >> 1] == -2) & (spelled & 1 == 0)] = BEGIN
            code = np.where(u_code < 0, SPELLED, u_code) << 16 | np.where(w_code_at < 0, SPELLED, w_code_at)
            if with_docs:
                doc = np.repeat(np.arange(len(ids), dtype=np.int16), np.diff(first))[order]
                entries = np.flatnonzero(differs | np.concatenate([[True], doc[1:] != doc[:-1]]))
                times = np.diff(entries, append=len(tokens))
                doc, of_pair = doc[entries], np.flatnonzero(differs[entries])
                docs = np.diff(of_pair, append=len(entries))
                n = np.add.reduceat(np.where(held[doc], 0, times), of_pair)
            else:
                n = np.add.reduceat(np.repeat(~held, np.diff(first))[order].astype(np.int32), pairs)
            place = place[at]
            shard = part_of(place, known.shards)
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            sizes = np.diff(np.append(cut, len(pairs)))
            k = len(cut)
            columns = {
                "shard": pa.array(shard[cut], LONG), "kind": pa.array(np.full(k, PAIRS), INT), "chunk": pa.array(np.full(k, number), LONG),
                "code": _lists(code.astype(np.uint32).view(np.int32), sizes, INT),
                "spelled": _lists(words.view(np.int64), np.diff(np.searchsorted(spelled, 2 * cut), append=len(spelled)), LONG),
                "n": _lists(n, sizes, INT),
            }
            if with_docs:
                of_shard = np.add.reduceat(docs, cut)
                columns |= {"docs": _lists(docs, sizes, INT), "doc": _lists(doc, of_shard, pa.int16()), "times": _lists(times, of_shard, INT)}
            yield _rows(schema, k, **columns)
            if with_docs:
                sums = lambda x, s=first[:-1]: np.add.reduceat(x, s)  # noqa: E731  every text has a token
                one = [len(ids)]
                yield _rows(
                    schema, 1, shard=pa.array(part_of(mix(np.array([number], np.uint64)), known.shards), LONG), kind=pa.array([IDS], INT), chunk=pa.array([number], LONG),
                    ids=pa.ListArray.from_arrays(pa.array([0, len(ids)], INT), ids), held_out=_lists(held, one, pa.bool_()), tokens=_lists(np.diff(first), one, INT),
                    base=_lists(sums(base[w_code]), one, pa.float64()), known=_lists(sums(seen[w_code]), one, INT),
                )

    return run


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.asarray(batch[name][row].values)


class Shard:
    """The pairs of one shard, from all chunks."""

    def __init__(self, known: Known, number: int):
        self.known, self.number = known, number
        self.codes, self.spelled, self.n, self.parts = [], [], [], []
        self.replies: list[tuple] = []

    def add(self, batch: pa.RecordBatch, row: int) -> None:
        self.codes.append(_values(batch, "code", row).view(np.uint32))
        self.spelled.append(_values(batch, "spelled", row).view(np.uint64))
        self.n.append(_values(batch, "n", row))
        if batch["doc"][row].is_valid:
            self.parts.append((batch["chunk"][row].as_py(), _values(batch, "docs", row), _values(batch, "doc", row), _values(batch, "times", row)))

    def ready(self) -> None:
        """Merge the chunks' pairs; number words and restaurants, both in the order of their hashes."""
        code, spelled = np.concatenate(self.codes), np.concatenate(self.spelled)
        self.codes, self.spelled = [], []
        top, (others, of_spelled) = self.known.top, numbered(spelled)
        of_top = np.zeros(SPELLED + 1, np.int32)
        of_top[: len(top)] = np.arange(len(top)) + np.searchsorted(others, top)
        of_others = (np.arange(len(others)) + np.searchsorted(top, others)).astype(np.int32)
        words = np.empty(len(top) + len(others), np.uint64)
        words[of_top[: len(top)]], words[of_others] = top, others
        code = np.stack([code >> np.uint32(16), code & np.uint32(SPELLED)], 1)
        both = of_top[code]
        both[code == SPELLED] = of_others[of_spelled]
        key, rows = both[:, 0].astype(np.uint64), len(both)
        key *= np.uint64(len(words))
        key += both[:, 1].astype(np.uint64)
        free = 64 - int(len(words) ** 2 - 1).bit_length()
        order = by_leading_bits(key << np.uint64(free)) if rows.bit_length() <= free else np.argsort(key, kind="stable")
        key = key[order]
        different = np.concatenate([[True], key[1:] != key[:-1]])
        self.pair = np.empty(rows, np.int32)
        self.pair[order] = np.cumsum(different, dtype=np.int32) - 1
        at = np.flatnonzero(different)
        self.n = np.add.reduceat(np.concatenate(self.n)[order], at, dtype=np.int64)
        key = key[at]
        u = key // np.uint64(len(words))
        w = (key - u * np.uint64(len(words))).astype(np.int64)
        differs = np.concatenate([[True], u[1:] != u[:-1]])
        self.contexts, self.context = words[u[differs]], np.cumsum(differs) - 1
        used = np.zeros(len(words), bool)
        used[w] = True
        self.words, self.word = words[used], (np.cumsum(used) - 1)[w]
        hot = lookup(self.known.hot, self.contexts)
        self.hot = hot >= 0
        self.customers = np.where(self.hot, self.known.hot_customers[hot] if len(self.known.hot) else 0.0, np.bincount(self.context, self.n, len(self.contexts)))
        self.held_tables = np.where(self.hot, self.known.hot_tables[hot] if len(self.known.hot) else 0.0, 0.0)

    def known_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Count, and root customers less discounts, of each word: of the TOP from what all tasks know, of others from the replies."""
        count, x = np.zeros(len(self.words)), np.zeros(len(self.words))
        at = lookup(self.known.top, self.words)
        count[at >= 0], x[at >= 0] = self.known.count[at[at >= 0]], self.known.root[at[at >= 0]]
        if self.replies:
            w, n, root = (np.concatenate(v) for v in zip(*((w, n, self.known.less_discounts(root[: len(w)], root[len(w) :])) for w, n, root in self.replies), strict=True))
            k = lookup(self.words, w)
            count[k[k >= 0]], x[k[k >= 0]] = n[k >= 0], root[k >= 0]
        return count, x

    def seating(self, first: bool, chance: np.ndarray) -> Seating:
        h = self.known.hyper
        rng = np.random.default_rng([self.number, int(first)])
        held = None if first else self.hot
        return Seating(self.n, self.context, len(self.contexts), h.discount, h.strength, rng, held, None if first else self.held_tables, chance)


def _seat(known: Known):
    """Job 2: seat each shard with a guess of the root, and ask the parts of the root for its words."""

    def asked(s: Shard):
        s.ready()
        at = lookup(known.top, s.words)
        guess = np.where(at >= 0, np.maximum(known.count[at], 2.0) if len(known.top) else 2.0, 2.0) / max(known.tokens, 1.0)
        seats = s.seating(True, guess[s.word])
        for _ in range(BURN):
            seats.sweep(guess[s.word])
        n, t = np.bincount(s.word, s.n, len(s.words)), np.bincount(s.word, seats.t, len(s.words))
        part = part_of(s.words, known.shards)  # words are sorted, and so are their parts
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(cut, len(part)))
        k = len(cut)
        yield _rows(
            REQUEST, k, part=pa.array(part[cut], LONG), kind=pa.array(np.full(k, PAIRS), INT), shard=pa.array(np.full(k, s.number), LONG),
            w=_lists(s.words.view(np.int64), sizes, LONG), n=_lists(n.astype(np.int64), sizes, LONG), t=_lists(np.round(t).astype(np.int64), sizes, LONG),
        )
        rows = [[*seats.evidence()]]
        for k in np.flatnonzero(s.hot):
            rows.append([float(lookup(known.hot, s.contexts[k : k + 1])[0]), float(s.n[s.context == k].sum()), float(seats.tables[k])])
        yield _rows(REQUEST, len(rows), kind=pa.array(np.full(len(rows), IDS), INT), sums=pa.array(rows, pa.list_(pa.float64())))

    return _by_shard(known, asked, lambda batch, row: None)


def _by_shard(known: Known, done, other):
    """mapInArrow over rows sorted by shard and kind: `done` for each shard, `other` for rows that are neither pairs nor replies."""

    def run(batches):
        shard = None
        for batch in batches:
            for row, (number, kind) in enumerate(zip(batch["shard"].to_pylist(), batch["kind"].to_pylist(), strict=True)):
                if shard is not None and (shard.number != number or kind == IDS):
                    if shard.codes:
                        yield from done(shard)
                    shard = None
                if kind == IDS:
                    yield from other(batch, row) or ()
                    continue
                shard = shard or Shard(known, number)
                if kind == REPLY:
                    shard.replies.append((_values(batch, "spelled", row).view(np.uint64), _values(batch, "n", row), _values(batch, "x", row)))
                else:
                    shard.add(batch, row)
        if shard is not None and shard.codes:
            yield from done(shard)

    return run


def _seat_root(known: Known):
    """Job 3: seat a part of the root, whose customers are the tables of all shards, and answer the shards: x has customers, then tables."""

    def seated(part: int, asked: list[tuple]):
        words, place = np.unique(np.concatenate([w for _, w, _, _ in asked]), return_inverse=True)
        n = np.bincount(place, np.concatenate([x for _, _, x, _ in asked]), len(words)).astype(np.int64)
        t = np.bincount(place, np.concatenate([x for _, _, _, x in asked]), len(words)).astype(np.int64)
        real = max(1, int((n > 0).sum()))
        h = known.hyper
        # the words of a part are a random share of all, so its tables and dishes stand for those of the root
        seats = Seating(t, np.zeros(len(t), np.int64), 1, h.root_discount, h.root_strength / known.shards, np.random.default_rng([part, 2]), chance=np.full(len(t), 1.0 / real))
        kept = np.zeros(len(t))
        for k in range(BURN + SAMPLES):
            seats.sweep(np.full(len(t), 1.0 / real))
            kept += seats.t if k >= BURN else 0.0
        kept /= SAMPLES
        sums = [[float(n.sum()), float((n > 0).sum()), float(t.sum()), float(kept.sum()), *seats.evidence()]]
        yield _rows(ANSWER, 1, kind=pa.array([IDS], INT), sums=pa.array(sums, pa.list_(pa.float64())))
        real = n > 0
        rare = lookup(known.top, words) < 0
        answers, seen = [(-1, PAIRS, np.flatnonzero(real & ~rare))], 0
        for shard, w, _, _ in asked:
            k = place[seen : seen + len(w)]
            seen += len(w)
            answers.append((shard, REPLY, k[real[k] & rare[k]]))
        sizes = [len(k) for _, _, k in answers]
        k = np.concatenate([k for _, _, k in answers])
        yield _rows(
            ANSWER, len(answers), shard=pa.array([s for s, _, _ in answers], LONG), kind=pa.array([x for _, x, _ in answers], INT),
            w=_lists(words[k].view(np.int64), sizes, LONG), n=_lists(n[k], sizes, LONG),
            x=_lists(np.concatenate([y[k] for _, _, k in answers for y in (t, kept)]), [2 * x for x in sizes], pa.float32()),
        )

    def run(batches):
        part, asked = None, []
        for batch in batches:
            for row, (number, shard) in enumerate(zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), strict=True)):
                if number != part:
                    if asked:
                        yield from seated(part, asked)
                    part, asked = number, []
                asked.append((shard, _values(batch, "w", row).view(np.uint64), _values(batch, "n", row), _values(batch, "t", row)))
        if asked:
            yield from seated(part, asked)

    return run


def _score(known: Known, schema: pa.Schema):
    """Job 4: seat each shard given the root, and sum the scores of its pairs by chunk and document."""

    def scored(s: Shard):
        s.ready()
        count, x = s.known_words()
        root = known.root_chance(x)[s.word]
        seats = s.seating(False, root)
        h = known.hyper
        p = np.zeros(len(root))
        for k in range(BURN + SAMPLES):
            seats.sweep(root)
            if k >= BURN:
                p += np.maximum(s.n - h.discount * seats.t, 0.0) + (h.strength + h.discount * seats.tables[s.context]) * root
        score = np.log10(p / SAMPLES / (h.strength + s.customers[s.context]))
        rare = lookup(known.top, s.words) < 0
        rare, base, is_known = rare[s.word], known.base(count)[s.word], (count > 0)[s.word]
        seen = 0
        for chunk, docs, doc, times in s.parts:
            pair = s.pair[seen : seen + len(docs)]
            seen += len(docs)
            k = np.flatnonzero(np.repeat(rare[pair], docs))  # what is known of the TOP words the chunk has said
            of_rare, size = np.repeat(pair, docs)[k], int(doc.max()) + 1
            sums = [np.bincount(doc, times * np.repeat(score[pair], docs))] + [np.bincount(doc[k], times[k] * y[of_rare], size) for y in (base, is_known)]
            there = np.zeros(size, bool)
            there[doc] = True
            d = np.flatnonzero(there)
            one = [len(d)]
            yield _rows(
                schema, 1, chunk=pa.array([chunk], LONG), kind=pa.array([PAIRS], INT), doc=_lists(d, one, pa.int16()),
                x=_lists(sums[0][d], one, pa.float32()), base=_lists(sums[1][d], one, pa.float64()), known=_lists(sums[2][d].astype(np.int64), one, INT),
            )

    def other(batch, row):
        one = batch.slice(row, 1)
        return [_rows(schema, 1, **{c: one[c] for c in ("chunk", "ids", "held_out", "tokens", "base", "known")}, kind=pa.array([REPLY], INT))]

    return _by_shard(known, scored, other)


def _added(schema: pa.Schema):
    """The sums of each document of a chunk, from rows sorted by chunk and kind: its documents first."""

    def emit(chunk):
        ids, held, tokens, base, known, score = chunk
        return pa.RecordBatch.from_arrays([ids, held, pa.array(tokens, LONG), pa.array(known, LONG), pa.array(base), pa.array(score)], schema=schema)

    def run(batches):
        now = None
        for batch in batches:
            for row, kind in enumerate(batch["kind"].to_pylist()):
                if kind == REPLY:
                    if now:
                        yield emit(now)
                    tokens = _values(batch, "tokens", row)
                    now = [batch["ids"][row].values, batch["held_out"][row].values, tokens, _values(batch, "base", row).copy(), _values(batch, "known", row).astype(np.int64), np.zeros(len(tokens))]
                    continue
                doc = _values(batch, "doc", row)
                now[3][doc] += _values(batch, "base", row)
                now[4][doc] += _values(batch, "known", row)
                now[5][doc] += _values(batch, "x", row)
        if now:
            yield emit(now)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """Train on the documents outside fold 0 and score all: see the module's text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == 0
    kind = docs.schema[key].dataType
    carried = F.col(key) if kind.typeName() in ("long", "integer", "string") else F.col(key).cast("string")
    rows = docs.select(carried.alias("id"), held.alias("held_out"), F.coalesce(text, F.lit("")).alias("text"))
    id_type = {"long": LONG, "integer": INT}.get(rows.schema["id"].dataType.typeName(), pa.string())

    # 1: frequent and hot words
    counted = stash(rows.mapInArrow(_frequent, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    tokens = (counted.where("w is null").first() or (None, 0))[1] or 0
    top = counted.where("w is not null").orderBy(F.col("n").desc(), "w").limit(TOP).toPandas().sort_values("w", key=lambda w: w.astype("int64").to_numpy().view(np.uint64))
    words, count = top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(float)
    hot = words[count > tokens / HOT]
    nothing = np.zeros(len(hot))
    known = Known(words, count, np.zeros(len(words)), hot, nothing, nothing, float(tokens), int(tokens // SHARD) + 1)

    def dealt(known: Known, with_docs: bool) -> DataFrame:
        schema = deal_schema(id_type)
        return rows.mapInArrow(_deal(known, schema, with_docs), ddl(schema))

    def by(df: DataFrame, name: str) -> DataFrame:
        return df.repartition(known.shards, name).sortWithinPartitions(name, "kind")

    # 2: restaurants with a guess of the root
    asked = stash(by(dealt(known, False), "shard").mapInArrow(_seat(known), ddl(REQUEST)))
    sums = asked.where(F.col("kind") == IDS).select("sums")
    parts = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4)]
    evidence = np.array([x or 0.0 for x in sums.where(F.size("sums") == 4).agg(*parts).first()], float)
    at_hot = sums.where(F.size("sums") == 3).groupBy(F.col("sums")[0].cast("int").alias("k")).agg(F.sum(F.col("sums")[1]), F.sum(F.col("sums")[2])).collect()  # fewer than HOT rows
    customers, tables = np.zeros(len(hot)), np.zeros(len(hot))
    for k, c, t in at_hot:
        customers[k], tables[k] = c, t
    discount, strength = drawn(evidence, 1) if tokens else (START.discount, START.strength)
    known = replace(known, hot_customers=customers, hot_tables=tables, hyper=replace(START, discount=discount, strength=strength))

    # 3: the root; its discount and strength are drawn given its seating
    requests = by(asked.where(F.col("kind") == PAIRS), "part")
    answers = stash(requests.mapInArrow(_seat_root(known), ddl(ANSWER)))
    total = np.array([x or 0.0 for x in answers.where(F.col("kind") == IDS).agg(*(F.sum(F.col("sums")[i]) for i in range(8))).first()], float)
    known = replace(known, train=int(total[0]), vocabulary=int(total[1]), root_customers=total[2], root_tables=total[3])
    if total[2]:
        d, s = drawn(total[4:], 2)
        known = replace(known, hyper=replace(known.hyper, root_discount=d, root_strength=s))
    size = F.size("w")
    zipped = F.arrays_zip("w", "n", F.slice("x", F.lit(1), size).alias("c"), F.slice("x", size + 1, size).alias("t"))
    of_top = answers.where((F.col("kind") == PAIRS) & (size > 0)).select(F.explode(zipped).alias("v")).select(*(F.col("v")[i].alias(c) for i, c in (("w", "w"), ("n", "n"), ("c", "c"), ("t", "t")))).toPandas()  # at most TOP rows
    at = lookup(words, of_top["w"].to_numpy(np.int64).view(np.uint64))
    count, root = np.zeros(len(words)), np.zeros(len(words))
    count[at], root[at] = of_top["n"].to_numpy(float), known.less_discounts(of_top["c"].to_numpy(float), of_top["t"].to_numpy(float))
    known = replace(known, count=count, root=root)

    # 4: scores
    schema = deal_schema(id_type)
    replies = answers.where(F.col("kind") == REPLY).select(
        "shard", "kind", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("array<int>").alias("code"), F.col("w").alias("spelled"),
        F.transform("n", lambda n: F.least(n, F.lit(2**31 - 1)).cast("int")).alias("n"),
        *(F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in ddl(schema).split(", ")[6:9]), "x",
        *(F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in ddl(schema).split(", ")[10:]),
    )
    sums_of = _schema(("chunk", LONG), ("kind", INT), *((f.name, f.type) for f in schema if f.name in ("ids", "held_out", "tokens", "base", "known", "doc", "x")))
    partial = by(dealt(known, True).unionByName(replies), "shard").mapInArrow(_score(known, sums_of), ddl(sums_of))
    out = _schema(("id", id_type), ("held_out", pa.bool_()), ("n_tokens", LONG), ("n_known", LONG), ("base_score", pa.float64()), ("score", pa.float64()))
    scored = by(partial, "chunk").mapInArrow(_added(out), ddl(out))
    return scored.select(
        F.col("id").cast(kind).alias(key), "held_out", "n_tokens", "n_known", F.lit(known.train).cast("long").alias("train_tokens"), "base_score", "score"
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
