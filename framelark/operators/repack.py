"""Repacking: features of one dataset with the labels of another, and merges of row ranges, with where each row came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framelark.operators.contracts import in_ranges
from framelark.sources import artifacts as A

#: header fields in which two datasets of the same frames must agree
TIMEBASE = ("note_count", "midi_min", "sample_rate", "hop_size")


def range_problems(ranges: DataFrame) -> DataFrame:
    """first, last, problem: ranges (source, first, last, into) that are empty, overlap or leave a gap in the output rows [into, into + last - first).

    A row for each range, so one window orders them.
    """
    placed = ranges.withColumn("end", F.col("into") + F.col("last") - F.col("first"))
    empty = F.col("last") <= F.col("first")
    order = W.orderBy("into", "end")
    upto = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    judged = placed.withColumn("upto", upto)
    problem = F.when(empty, "empty").when(F.col("first") < 0, "negative row").when(F.col("into") < F.col("upto"), "overlap").when(F.col("into") > F.col("upto"), "gap")
    return judged.select("source", "first", "last", problem.alias("problem")).where("problem is not null")


def merged(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Output rows in place: rows (source, row, ..) that lie in a range (source, first, last, into) get the output row, and keep source and row as source_row.

    Rows and ranges meet by blocks of row numbers.
    """
    keyed = ranges.select(F.col("source").alias("_of"), "first", "last", "into")
    met = in_ranges(rows, keyed.withColumn("_first", F.col("first")))
    return met.where(F.col("source") == F.col("_of")).select(
        (F.col("row") - F.col("_first") + F.col("into")).alias("row"), "source", F.col("row").alias("source_row"), *(c for c in rows.columns if c not in ("row", "source"))
    )


def missing_rows(merged_rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """source, first, last, wanted, found of the ranges that their source doesn't fill, or fills twice."""
    got = merged_rows.groupBy("source").agg(F.count("*").alias("found"))
    want = ranges.groupBy("source").agg(F.sum(F.col("last") - F.col("first")).alias("wanted"))
    return want.join(got, "source", "left").where(F.coalesce("found", F.lit(0)) != F.col("wanted")).select("source", "wanted", F.coalesce("found", F.lit(0)).alias("found"))


def preconditions(spark: SparkSession, features: str, labels: str) -> DataFrame:
    """check, detail: what keeps two published datasets from being repacked; empty when nothing does."""
    a, b = (A.manifest(spark, p, "dataset") for p in (features, labels))
    found = []
    for side, path in (("feature", features), ("label", labels)):
        found += [(f"{side} source payload checksum", f"{r.section} rows {r.first}-{r.last} {r.problem}") for r in A.damage(spark, path).limit(5).collect()]
    for field in TIMEBASE:
        if a["header"].get(field) != b["header"].get(field):
            found.append((f"headers disagree on {field}", f"{a['header'].get(field)} and {b['header'].get(field)}"))
    for name, what in (("features", "frame counts"), ("indices", "onset index counts")):
        if a["sections"][name]["rows"] != b["sections"][name]["rows"]:
            found.append((f"{what} differ", f"{a['sections'][name]['rows']} and {b['sections'][name]['rows']}"))
    for name in ("activity", "indices"):
        if a["sections"][name]["digest"] != b["sections"][name]["digest"]:
            found.append((f"{name} sections are not identical", f"{a['sections'][name]['digest'][:12]} and {b['sections'][name]['digest'][:12]}"))
    for side, m in (("feature", a), ("label", b)):
        if m["header"].get("sampling", "natural") != "natural":
            found.append(("relabelling is for natural sampling only", f"{side} source: {m['header']['sampling']}"))
    if a["header"].get("tracks") != b["header"].get("tracks"):
        found.append(("rows belong to other tracks", ""))
    return spark.createDataFrame(found, "check string, detail string")


def repack(spark: SparkSession, features: str, labels: str, target: str) -> dict:
    """A dataset with the features of one and the labels of the other; its header says from which payloads it was made."""
    if len({p.rstrip("/") for p in (features, labels, target)}) < 3:
        raise ValueError("features, labels and target must be distinct")
    bad = preconditions(spark, features, labels).collect()
    if bad:
        raise ValueError("can't repack: " + "; ".join(f"{r.check} ({r.detail})" for r in bad))
    a, b = A.manifest(spark, features), A.manifest(spark, labels)
    x, indices = A.read_dataset(spark, features, verify=False)
    y, _ = A.read_dataset(spark, labels, verify=False)
    frames = x.select("row", "features").join(y.select("row", "activity", "onset"), "row")
    head = a["header"] | {"provenance": {n: {"artifact": m["digest"], "sections": {k: m["sections"][k]["digest"] for k in kept}} for n, m, kept in (("features", a, ["features"]), ("labels", b, ["activity", "onset", "indices"]))}}
    return A.publish_dataset(spark, target, frames, indices, head)
