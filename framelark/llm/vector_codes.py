"""Product-quantised codes of vectors, from codebooks fitted on weighted distinct parts.

Each component x becomes the integer floor(4096 x); a vector is cut into equal consecutive parts. Equal
parts at a position are counted once, with their number as weight. The codebook of a position starts
with that part of the vectors with the smallest ids and goes through rounds of Lloyd's method on the
weighted distinct parts: each takes its nearest entry (squared distance, ties to the lower index), then
an entry becomes the floor of the mean of its parts; an entry without parts stays. At the end distinct
parts are assigned once more, and codes and errors are joined back to the vectors by part.

All of it is in integers, so the result depends neither on partitions nor on the order of rows.

Scale: what is fitted on is the table of distinct parts, written once and read in each round; a task
gives a sum for each entry, and the driver sees parts x entries rows (codebooks, a few KB, are all that
is sent to tasks). Parts that make up 1 / HEAVY of all vectors or more are at most HEAVY at each position; they are
joined by broadcast, so a vector that makes up a third of the rows doesn't meet in one task. The others are
joined by shuffle.

Edge cases: vectors that are null, or hold null or non-finite components, or are of another length than the vector
with the smallest id, are left out. Components beyond +-32768 count as that. A length that `parts` does not divide is an
error. Fewer vectors than entries make smaller codebooks; an empty table gives an empty result. Null ids
come last; rows that repeat an id are in order of their stored integers and get codes each for itself. Columns other than those named keep out of it, whatever their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches, small, stash

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 27  # squared distances of 64 such components fit a long
HEAVY = 256
EXACT = 1 << 22  # products of integers below, summed over a part, are exact as doubles
WHOLE = T.DecimalType(38, 0)


def integer_parts(parts: int, scale: int):
    """UDF: a vector as the bytes of its integer parts, 16 bits a component where all of the part fit, else 32; null if it is to be left out."""

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def cut(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten()
        sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        finite = np.isfinite(x)  # a null is NaN here
        bad = np.zeros(len(sizes), bool)
        bad[np.repeat(np.arange(len(sizes)), sizes)[~finite]] = True
        keep = ~bad & (sizes > 0)
        if (sizes[keep] % parts).any():
            raise ValueError(f"vectors of {sizes[keep][sizes[keep] % parts > 0][0]} components can't be cut into {parts} equal parts")
        rows = np.repeat(keep, sizes)
        with np.errstate(over="ignore"):
            ints = np.clip(np.floor(x[rows] * scale), -LIMIT, LIMIT).astype(np.int64)
        widths = np.repeat(sizes[keep] // parts, parts)
        starts = np.cumsum(widths) - widths
        least, most = (f.reduceat(ints, starts) if len(ints) else ints for f in (np.minimum, np.maximum))
        narrow = (least >= -(1 << 15)) & (most < 1 << 15)
        each = np.repeat(np.where(narrow, 2, 4), widths)
        ends = np.cumsum(each)
        data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        for size, kind in ((2, "<i2"), (4, "<i4")):
            of = np.flatnonzero(each == size)
            data[(ends[of] - size)[:, None] + np.arange(size)] = ints[of].astype(kind).view(np.uint8).reshape(-1, size)
        offs = np.concatenate([[0], np.cumsum(np.where(narrow, 2, 4) * widths)]).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(widths), [None, pa.py_buffer(offs), pa.py_buffer(data)])
        counts = np.concatenate([[0], np.cumsum(np.where(keep, parts, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(counts), pieces, mask=pa.array(~keep))

    return cut


def integers(values: pa.Array, width: int) -> np.ndarray:
    """Rows of integers from the bytes of parts of `width` components."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offs = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out = np.zeros((len(values), width), np.int64)
    for size, kind in ((2, "<i2"), (4, "<i4")):
        at = np.flatnonzero(np.diff(offs) == size * width)
        if len(at):
            out[at] = buf[offs[:-1][at][:, None] + np.arange(size * width)].view(kind)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each row, ties to the lower index, and the squared distance."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(np.abs(x).max(), np.abs(book).max()) < EXACT:
        c = book.astype(np.float64)
        code = ((c * c).sum(axis=1) - 2.0 * (x.astype(np.float64) @ c.T)).argmin(axis=1)
    else:
        code = np.concatenate([((block[:, None, :] - book) ** 2).sum(axis=2).argmin(axis=1) for block in np.array_split(x, len(x) // 4096 + 1)])
    return code, ((x - book[code]) ** 2).sum(axis=1)


def sums_of(books: np.ndarray):
    """A task's rows (part, entry, n, sums) for its distinct parts (part, value, weight)."""
    parts, entries, width = books.shape

    def run(batches):
        n, sums = np.zeros((parts, entries), object), np.zeros((parts, entries, width), object)
        for batch in batches:
            part, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in np.unique(part):
                of = np.flatnonzero(part == p)
                x, w = integers(batch.column(1).take(pa.array(of)), width), weight[of]
                code, _ = nearest(x, books[p])
                order = np.argsort(code, kind="stable")
                x, w = x[order], w[order]
                entry, starts = np.unique(code[order], return_index=True)
                # halves of the weights, so that sums of products stay within 64 bits
                for half, shift in ((w & 0x3FFFF, 0), (w >> 18, 18)):
                    if half.any():
                        sums[p, entry] += np.add.reduceat(x * half[:, None], starts).astype(object) * (1 << shift)
                        n[p, entry] += np.add.reduceat(half, starts).astype(object) * (1 << shift)
        used = [(p, e) for p in range(parts) for e in range(entries) if n[p, e]]
        whole = pa.decimal128(38)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in used], pa.int32()),
                pa.array([e for _, e in used], pa.int32()),
                pa.array([Decimal(n[u]) for u in used], whole),
                *(pa.array([Decimal(sums[u][k]) for u in used], whole) for k in range(width)),
            ],
            names=["part", "entry", "n", *(f"s{k}" for k in range(width))],
        )

    return run


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after `rounds` rounds over the weighted distinct parts."""
    width = books.shape[2]
    names = [f"s{k}" for k in range(width)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType())] + [T.StructField(c, WHOLE) for c in ("n", *names)])
    for _ in range(rounds):
        partial = distinct.mapInArrow(sums_of(books), schema)
        books = books.copy()
        for r in partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect():  # parts x entries rows
            books[r.part, r.entry] = [int(r[c]) // int(r.n) for c in names]
    return books


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """part, value, weight with the code and error of each distinct part."""
    width = books.shape[2]

    def run(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            code, error = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(part):
                of = np.flatnonzero(part == p)
                code[of], error[of] = nearest(integers(batch.column(1).take(pa.array(of)), width), books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=["part", "value", "weight", "code", "error"])

    return distinct.mapInArrow(run, "part int, value binary, weight long, code int, error long")


def code_text(parts: int) -> Column:
    """Codes of a vector's parts (rows part, code of a group) as two hex digits each, in part order."""
    words = []
    for first in range(0, parts, 8):
        n = min(8, parts - first)
        inside = (F.col("part") >= first) & (F.col("part") < first + n)
        placed = F.expr(f"shiftleft(cast(code as bigint), cast(8 * ({first + n - 1} - part) as int))")
        words.append(F.lpad(F.lower(F.hex(F.bit_or(F.when(inside, placed)))), 2 * n, "0"))
    return F.concat(*words)


def encode(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Per kept vector `key`, `label`, code and error; and the codebooks (part, entry, position in the part)."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold codebooks of 1 to 256 entries")
    spark = vectors.sparkSession
    bounded_batches(spark)
    cut = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.size(vector).alias("dims"), integer_parts(parts, scale)(F.col(vector)).alias("pieces"))
    kept = stash(cut.where("pieces is not null").select(F.monotonically_increasing_id().alias("row"), "id", "label", "dims", "pieces"))
    seeds = kept.select("id", "dims", "pieces").orderBy(F.col("id").asc_nulls_last(), "dims", "pieces").limit(1).collect()
    if not seeds:
        return kept.select(F.col("id").alias(key), F.col("label").alias(label), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    dims = seeds[0].dims
    kept = kept.where(F.col("dims") == dims)
    seeds = kept.select("id", "pieces").orderBy(F.col("id").asc_nulls_last(), "pieces").limit(entries).collect()  # `entries` rows
    width = dims // parts
    books = np.stack([integers(pa.array([bytes(s.pieces[p]) for s in seeds], pa.binary()), width) for p in range(parts)])

    each = kept.select("row", "id", "label", F.posexplode("pieces").alias("part", "value"))
    distinct = stash(each.groupBy("part", "value").agg(F.count("*").alias("weight")))
    books = lloyd(distinct, books, rounds)
    found = stash(assigned(distinct, books))
    n = found.where("part = 0").agg(F.sum("weight")).first()[0]
    is_heavy = F.col("weight") * HEAVY >= n
    heavy = F.broadcast(found.where(is_heavy).select("part", "value", "code", "error"))  # at most HEAVY rows a part
    light = found.where(~is_heavy).select("part", "value", "code", "error")
    on = ["part", "value"]
    coded = each.join(heavy, on).union(each.join(heavy.select(*on), on, "left_anti").join(light, on))
    whole = coded.groupBy("row", "id", "label").agg(code_text(parts).alias("code"), F.sum("error").alias("error"))
    return whole.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error"), books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **kw) -> DataFrame:
    """Codes and errors with the summed error of the label and the digest of the codebooks."""
    codes, books = encode(vectors, key, vector, label, **kw)
    codes = stash(codes.select(F.col(key).alias("id"), F.col(label).alias("label"), "code", "error"))
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast(WHOLE)).cast("long").alias("label_error"))
    found = codes.join(small(sums), F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 8) -> str:
    """The same in SQL (DuckDB), for small tables of vectors of parts x width components."""
    ctes = [
        f"k AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {parts * width})",
        f"""p AS MATERIALIZED (SELECT vec_id, label, g AS part, list_transform(e[g * {width} + 1:g * {width} + {width}], lambda x: floor(4096 * x)::BIGINT) AS v
        FROM (SELECT *, unnest(range(0, {parts})) AS g FROM k))""",
        "d AS MATERIALIZED (SELECT part, v, count(*) AS w FROM p GROUP BY ALL)",
        f"""b0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM k) USING (vec_id) WHERE rank <= {entries})""",
    ]
    pick = """SELECT part, v, any_value(w) AS w, min(struct_pack(dist := dist, entry := entry)) AS best
        FROM (SELECT d.part, d.v, d.w, b.entry, list_sum(list_transform(list_zip(d.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM d JOIN b{0} b ON b.part = d.part)
        GROUP BY part, v"""
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED ({pick.format(r)})")
        if r < rounds:
            ctes.append(
                f"""m{r} AS (SELECT part, entry, list(floor_mean ORDER BY pos) AS v FROM (
              SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
                SELECT part, best.entry AS entry, pos, sum(w * x)::BIGINT AS s, sum(w)::BIGINT AS n
                FROM (SELECT part, best, w, unnest(v) AS x, unnest(range(0, {width})) AS pos FROM a{r}) GROUP BY ALL)) GROUP BY ALL)"""
            )
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)")
    ctes.append(
        f"""c AS MATERIALIZED (SELECT p.vec_id, any_value(p.label) AS label, string_agg(printf('%02x', a.best.entry), '' ORDER BY p.part) AS code, sum(a.best.dist)::BIGINT AS error
        FROM p JOIN a{rounds} a ON a.part = p.part AND a.v = p.v GROUP BY p.vec_id)"""
    )
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
    FROM c"""
    )
