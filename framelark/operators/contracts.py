"""Contracts between tables: joins that must match, fingerprints, parameter inheritance, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framelark.operators.running import row_numbers
from framelark.operators.sized import small


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` without a partner: empty when the contract holds."""
    return left.join(right, keys, "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: keys missing on one side or repeated on either; empty when the pairing is exact."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = a.join(b, keys, "full")
    problem = F.when(F.col("n_left").isNull(), "missing left").when(F.col("n_right").isNull(), "missing right").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def row_ranges(tracks: DataFrame) -> DataFrame:
    """source, first, last: half-open row ranges from row counts, in order of `place`."""
    upto = F.sum("rows").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))  # a row for each track
    return tracks.select("source", (upto - F.col("rows")).alias("first"), upto.alias("last"))


BLOCK = 1 << 20


def in_ranges(rows: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with the source of the range their `row` lies in.

    Both sides are cut into blocks of row numbers, so the join is on equality; a range has a row for each block it meets.
    """
    met = ranges.where("last > first").withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))))
    near = rows.withColumn("_block", F.floor(F.col("row") / block)).join(met, "_block")
    return near.where((F.col("row") >= F.col("first")) & (F.col("row") < F.col("last"))).drop("first", "last", "_block")


def by_row(scores: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """Scores (by.., frame, pitch, score) with labels (frame, pitch, truth) at the same row position and pitch.

    The position of a frame is its place among the frames of its own table, so tables need not number frames alike.
    """

    def place(df: DataFrame, keys: list[str]) -> DataFrame:
        numbered = row_numbers(df.select(*keys, "frame").distinct(), [F.col(c) for c in (*keys, "frame")], "row")
        if not keys:
            return numbered
        first = numbered.groupBy(*keys).agg(F.min("row").alias("_first"))
        return numbered.join(small(first), keys).select(*keys, "frame", (F.col("row") - F.col("_first")).alias("row"))

    left = scores.join(place(scores, list(by)), [*by, "frame"])
    right = labels.join(place(labels, []), "frame").select("row", "pitch", "truth")
    return left.join(right, ["row", "pitch"]).select(*by, "row", "pitch", "score", "truth")


def header_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """field, left, right for the fields of two one-row headers that differ, or that one side lacks."""
    long = lambda df, name: df.select(F.explode(F.map_entries(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("string")))))).alias("e")).select(F.col("e.key").alias("field"), F.col("e.value").alias(name))
    return long(a, "left").join(long(b, "right"), "field", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def in_order(members: DataFrame, expected: DataFrame) -> DataFrame:
    """ok: whether members (ord, id) are the expected ones in the expected order; a row for each mismatch."""
    both = members.select("ord", F.col("id").alias("got")).join(expected.select("ord", F.col("id").alias("want")), "ord", "full")
    return both.where(~F.col("got").eqNullSafe(F.col("want")))


DIGIT_SETS = 8  # a SHA-256 as so many unsigned 32-bit numbers


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """by.., digest, rows: a SHA-256 over the rows as a multiset, whatever their order and partitions.

    Each row's canonical JSON is hashed; hashes are counted and added up as eight 32-bit numbers each (sums that every task can begin),
    and the digest is taken of the sums and the count. So no task holds the hashes of a group.
    """
    cols = sorted(c for c in df.columns if c not in by)
    h = F.sha2(F.to_json(F.struct(*cols)), 256)
    hashed = df.select(*by, h.alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"_s{k}") for k in range(DIGIT_SETS)]
    total = hashed.groupBy(*by).agg(*sums, F.count("*").alias("rows"))
    text = F.concat_ws(",", *(F.coalesce(F.col(f"_s{k}"), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(DIGIT_SETS)), F.col("rows").cast("string"))
    return total.select(*by, F.sha2(text, 256).alias("digest"), "rows")


def inherit(experiment_head: Column, experiment: Column, default_head: Column, default: Column) -> Column:
    """The most specific setting that is given."""
    return F.coalesce(experiment_head, experiment, default_head, default)


def pending(plan: DataFrame, done: DataFrame, *parameters: str) -> DataFrame:
    """Plan rows whose signature is not in the done table: what a resumed run has left to do."""
    signed = plan.withColumn("signature", F.sha2(F.to_json(F.struct(*sorted(parameters))), 256))
    return signed.join(done.select("signature").distinct(), "signature", "left_anti")


def key_violations(given: DataFrame, known: DataFrame) -> DataFrame:
    """key, problem for keys that are unknown or missing."""
    unknown = given.select("key").distinct().exceptAll(known.select("key").distinct()).withColumn("problem", F.lit("unknown"))
    missing = known.select("key").distinct().exceptAll(given.select("key").distinct()).withColumn("problem", F.lit("missing"))
    return unknown.unionByName(missing)


#: the letters, digits and marks of POSIX's portable file names; others can mean something to a shell or a file system
PORTABLE = "A-Za-z0-9._-"


def safe_name(name: Column) -> Column:
    """A portable file name: what isn't portable becomes an underscore for each run; it neither hides the file nor ends in marks."""
    return F.btrim(F.regexp_replace(name, f"[^{PORTABLE}]+", "_"), F.lit("._"))


def valid_id(name: Column) -> Column:
    # fixed value: the form that member ids have in score files
    return name.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$")


def contract_violations(given: DataFrame, wanted: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, given, wanted for every field in which two contracts of a key differ, or that one side lacks."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("e")
        return df.select(key, pairs).select(key, "e.*")

    both = long(given, "given").join(long(wanted, "wanted"), [key, "field"], "full")
    return both.where(~F.col("given").eqNullSafe(F.col("wanted")))


def realtime_factor(audio_seconds: Column, elapsed: Column) -> Column:
    """Seconds of audio for each second that its evaluation took."""
    return audio_seconds / F.greatest(elapsed, F.lit(1e-9))
