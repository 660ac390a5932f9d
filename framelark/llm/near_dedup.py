"""Near-duplicate documents: MinHash banding, verification, connected components.

Words are runs of bytes other than space and \\t\\n\\v\\f\\r, after lower-casing A-Z. A
document's set is its distinct 5-word shingles, or its whole word sequence as
one shingle if it has fewer words. Two documents are linked if their sets have a
Jaccard similarity of at least 0.75; a component is what links reach.

1. Equal sets (by a 128-bit digest) are collapsed to the smallest id first, so
   exact copies cost one row each from here on.
2. Each set gets 128 universal hash minima, cut into 32 bands of 4. A pair at
   0.75 misses all bands with a chance of 5e-6, a more similar pair with less.
3. In each bucket every member is compared with the bucket's smallest id: that
   is a row for each member, never all pairs. Candidates are verified
   on their full sets; links give components.
4. What step 3 can miss is a link between two members of a bucket that are
   in different components after it. Buckets whose members are all in one
   component are done. In the others signatures of different components are
   compared inside the task (buckets of more than BLOCK members in pairs of blocks), and
   each pair of components with signatures near enough is one row. Such a pair is
   settled on full sets: the larger component is an index of shingles, in blocks of
   members, and the members of the smaller one are streamed past it until one links.
   So rows follow components, never pairs of members.
5. Components come from alternating large-star and small-star steps over the
   verified links until nothing changes; every step is written to the shared folder.

Scale: bucket minima are grouped with partial aggregation; joins on bucket or
digest are sort-merge joins between plain exchanges, which Spark splits where a key is
hot. Links, components and signatures never come to the driver; it sees
only counts.

Edge cases: a null or wordless text has an empty set: n_shingles 0, linked with
nothing. Ids of any type are compared in their own order. A null id is a row of its own: not linked, kept. Rows that repeat an id are
one document with all of their texts. Ties go to the smallest id. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches, id_numbers, is_number, small, stash
from framelark.llm.textscan import LOWER, NON_SPACE, Words, mix, slices, windows

SHINGLE = 5
MINIMA = 128
BANDS = 32
ROWS = MINIMA // BANDS
BLOCK = 4096  # members compared by signature in one group
PARTNERS = 256  # pairs of one document that are verified in one group
INDEX = 512  # members of a component in one index
SPREAD = 4.5  # standard errors by which a signature may fall short of the threshold

_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, buf, offs in slices(texts):
        w = Words(LOWER[buf], offs, NON_SPACE)
        h = w.hashes()
        wins = windows(h, SHINGLE)
        for d in range(hi - lo):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= SHINGLE:
                yield np.unique(wins[a : b - SHINGLE + 1])
            elif b > a:
                yield np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each of MINIMA universal hash functions (multiply-add, upper 32 bits)."""
    out = np.empty(MINIMA, np.uint64)
    if len(s) <= 4096:
        return ((s[None, :] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)).min(axis=1)
    for k in range(MINIMA):
        out[k] = ((s * _MUL[k] + _ADD[k]) >> np.uint64(32)).min()
    return out


SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(T.LongType())),
        T.StructField("minima", T.BinaryType()),
    ]
)


@F.arrow_udf(SIGNED)
def signature(texts: pa.Array) -> pa.Array:
    sizes, digests, buckets, signatures = [], [], [], []
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for s in shingle_sets(texts):
        sizes.append(len(s))
        if not len(s):
            digests.append(None)
            buckets.append(np.zeros(0, np.int64))
            signatures.append(None)
            continue
        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        m = minima(s)
        key = salt.copy()
        for r in range(ROWS):
            key = mix(key ^ m[r::ROWS])
        buckets.append(key.view(np.int64))
        signatures.append(mix(m).astype(np.uint16).tobytes())
    ends = np.cumsum([0, *map(len, buckets)])
    flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays(
        [
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            pa.array(signatures, pa.binary()),
        ],
        names=SIGNED.fieldNames(),
    )


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_array(texts: pa.Array) -> pa.Array:
    sets = [s.view(np.int64) for s in shingle_sets(texts)]
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def verified(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union.

    Few different a stand in many pairs. So pairs are dealt by a, in parts of about PARTNERS; the set of a goes to each
    part once, and the sets of its partners are streamed past it.
    """
    wanted = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = stash(docs.join(small(wanted), "id", "left_semi").select("id", shingle_array(F.col("text")).alias("s")))  # read twice
    parts = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    hubs = sets.join(parts, F.col("id") == F.col("a")).select("id", "s", part).select(F.xxhash64("id", "part").alias("group"), F.lit(None).cast("long").alias("small"), "id", "s")
    others = pairs.join(small(parts), "a").join(sets, F.col("b") == F.col("id"))
    others = others.select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("group"), F.col("b").alias("small"), "id", "s")
    rows = hubs.unionByName(others).repartition("group").sortWithinPartitions("group", F.col("small").isNotNull(), "small")
    return rows.mapInArrow(_settle(threshold), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in `links` (a, b): the smallest id that links reach.

    Alternates large-star (each node points its larger neighbours at its smallest
    one) and small-star (each node points its smaller neighbours, and itself, at its
    smallest one) until the links are stars around the smallest ids.
    """

    def directed(e: DataFrame) -> DataFrame:
        """b > a always."""
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    def large_star(e: DataFrame) -> DataFrame:
        near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m"))
        # the larger neighbours of u are the b of the links in which u is a
        return directed(e.join(low, e["a"] == low["u"]).select(F.least("m", "a").alias("a"), "b"))

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        moved = e.join(low, "b").select("m", "a", "b")
        return directed(moved.select(F.col("m").alias("a"), "b").unionByName(moved.select(F.col("m").alias("a"), F.col("a").alias("b"))))

    now = stash(directed(links))
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = stash(small_star(large_star(now)))
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def near_duplicates(docs: DataFrame, threshold: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, n_shingles, component_id and kept."""
    bounded_batches(docs.sparkSession)
    if not is_number(docs, key):
        return _of_other_ids(docs, threshold, key, text)
    signed = stash(docs.select(F.col(key).alias("id"), signature(F.col(text)).alias("s")).select("id", "s.*"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    real = F.col("id").isNotNull() & F.col("digest").isNotNull()

    # one row for each different set
    sets = stash(
        signed.where(real).groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    )
    reps = signed.where(real).select("id", "digest", "buckets").join(
        sets.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi"
    ).select("id", "buckets").dropDuplicates(["id", "buckets"])

    members = stash(in_buckets(reps))
    star = members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(stash(star), texts, threshold)
    links = stash(links)
    part = stash(components(links))

    near = stash(near_components(members, part, signed.where(real).select("id", "minima"), threshold))
    if near.limit(1).count():
        everyone = sets.select(F.col("rep").alias("id")).join(part, "id", "left").select("id", F.coalesce("component", "id").alias("c"))
        found = stash(settled(near, everyone, texts, threshold))
        if found.limit(1).count():
            part = stash(components(links.unionByName(found)))

    per_set = sets.join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # rows that repeat an id under several sets belong together
    many = per_set.select("digest", "component")
    plain = signed.select("id", "n_shingles", "digest")
    keyed = plain.where(real).join(many, "digest").select("id", "n_shingles", "component")
    loose = plain.where(~real).select("id", "n_shingles", F.col("id").alias("component"))
    out = keyed.unionByName(loose)
    return out.select(
        F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def _of_other_ids(docs: DataFrame, threshold: int, key: str, text: str) -> DataFrame:
    """The same for ids that are no whole numbers: they are numbered in their order, and put back."""
    ids = id_numbers(docs, key)
    numbered = docs.select(F.col(key).alias("_own"), F.col(text).alias("text")).join(ids, F.col("_own") == F.col("_id"), "left").select("_n", "text")
    got = near_duplicates(numbered, threshold, "_n", "text")
    names = lambda column, name: ids.select(F.col("_n").alias(f"_{name}_n"), F.col("_id").alias(name))
    got = got.join(names("_n", "_key"), F.col("_n") == F.col("__key_n"), "left").join(names("component_id", "_component"), F.col("component_id") == F.col("__component_n"), "left")
    return got.select(F.col("_key").alias(key), "n_shingles", F.col("_component").alias("component_id"), "kept")


def in_buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id, low) for the members of buckets with two or more members; low is the smallest."""
    spread = reps.select(F.explode("buckets").alias("bucket"), "id")
    shared = spread.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    return spread.join(shared.select("bucket", "low"), "bucket").select("bucket", "id", "low")


def _compare(threshold: int):
    """mapInArrow over members sorted by group: pairs of components with signatures near enough."""
    share = threshold / 100
    least = MINIMA * share - SPREAD * (MINIMA * share * (1 - share)) ** 0.5

    def pairs(c: np.ndarray, m: np.ndarray) -> np.ndarray:
        found = []
        for k in range(len(c) - 1):
            other = np.flatnonzero(c[k + 1 :] != c[k]) + k + 1
            if len(other):
                near = other[(m[other] == m[k]).sum(axis=1) >= least]
                if len(near):
                    met = np.unique(c[near])
                    found.append(np.stack([np.minimum(met, c[k]), np.maximum(met, c[k])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        got = pairs(np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(rows), MINIMA))
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], names=["x", "y"])

    def run(batches):
        group, rows = None, []
        for batch in batches:
            for key, c, m in zip(batch["group"].to_pylist(), batch["c"].to_pylist(), batch["minima"].to_pylist(), strict=True):
                if key != group:
                    if len(rows) > 1:
                        yield emit(rows)
                    group, rows = key, []
                rows.append((c, m))
        if len(rows) > 1:
            yield emit(rows)

    return run


def near_components(members: DataFrame, part: DataFrame, minima_of: DataFrame, threshold: int) -> DataFrame:
    """(x, y), x < y: pairs of components that share a bucket and have members with near signatures."""
    known = members.join(part, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    open_ = stash(
        known.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n")).where("x <> y").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    left = known.join(open_, "bucket").join(minima_of.dropDuplicates(["id"]), "id")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    each = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = each.select(group.alias("group"), "c", "minima").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_compare(threshold), "x long, y long").distinct()


def _settle(threshold: int):
    """mapInArrow over groups in which the members of the larger component stand before those of smaller ones."""

    def run(batches):
        group, ids, sets, index, done = None, [], [], None, set()
        for batch in batches:
            out_a, out_b = [], []
            rows = zip(batch["group"].to_pylist(), batch["small"].to_pylist(), batch["id"].to_pylist(), batch["s"], strict=True)
            for key, small_, ident, s in rows:
                s = np.asarray(s.values)
                if key != group:
                    group, ids, sets, index, done = key, [], [], None, set()
                if small_ is None:
                    ids.append(ident)
                    sets.append(s)
                    continue
                if not ids or small_ in done:
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets])
                    values = np.concatenate(sets)
                    order = np.argsort(values, kind="stable")
                    index = values[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
                    sets = []
                values, owner, sizes = index
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = hi - lo
                if not n.any():
                    continue
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(sizes))
                linked = np.flatnonzero((shared > 0) & (100 * shared >= threshold * (sizes + len(s) - shared)))
                if len(linked):
                    out_a.append(ids[int(linked[0])])
                    out_b.append(ident)
                    done.add(small_)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def settled(near: DataFrame, everyone: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """A verified link (a, b) for each pair of components that has one (or for each block of the larger)."""
    wanted = stash(near.select(F.explode(F.array("x", "y")).alias("c")).distinct())
    there = stash(everyone.join(wanted, "c").select("id", "c"))
    sizes = stash(there.groupBy("c").agg(F.countDistinct("id").alias("n")))
    sets = stash(docs.join(small(there.select("id").distinct()), "id", "left_semi").select("id", shingle_array(F.col("text")).alias("s")))
    n_x, n_y = sizes.select(F.col("c").alias("x"), F.col("n").alias("nx")), sizes.select(F.col("c").alias("y"), F.col("n").alias("ny"))
    sided = near.join(n_x, "x").join(n_y, "y")
    first = F.col("nx") >= F.col("ny")
    pairs = stash(
        sided.select(
            F.when(first, F.col("x")).otherwise(F.col("y")).alias("large"),
            F.when(first, F.col("y")).otherwise(F.col("x")).alias("small"),
            F.ceil(F.greatest("nx", "ny") / INDEX).alias("blocks"),
        )
    )
    full = there.join(sets, "id").select("id", "c", "s")
    large = pairs.select("large", "blocks").distinct()
    indexed = full.join(large, F.col("c") == F.col("large")).select(
        F.xxhash64("large", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("group"), F.lit(None).cast("long").alias("small"), "id", "s"
    )
    streamed = (
        full.join(pairs, F.col("c") == F.col("small"))
        .select("large", "small", "id", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        .select(F.xxhash64("large", "block").alias("group"), "small", "id", "s")
    )
    rows = indexed.unionByName(streamed).repartition("group").sortWithinPartitions("group", F.col("small").isNotNull(), "small")
    return rows.mapInArrow(_settle(threshold), "a long, b long")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """`docs` with one document of each component: that with the smallest id."""
    gone = stash(near_duplicates(docs, key=key, text=text, **kw).where("not kept").select(key).distinct())
    return docs.join(small(gone), key, "left_anti").select(*docs.columns)
