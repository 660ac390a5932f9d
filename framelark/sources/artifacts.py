"""Published artifacts: named tables with a manifest and a tree of digests, in Parquet.

    publish(spark, path, kind, header, {"frames": (df, ["row"])})
    tables(spark, path); header(spark, path); damage(spark, path)

An artifact is a folder: a Parquet table for each section, the digests of its rows' blocks, and the manifest. The manifest is
written last, so a folder without one is unfinished and is not opened. `header` reads the manifest alone.

Digests are SHA-256 in a tree of fixed depth: rows in their section's order, numbered from 0, in blocks of FAN rows, blocks in groups of FAN, groups
in the section; the artifact's digest is taken of its kind, header and sections. A row's digest is that of the JSON of
its columns in order of name. Each step holds FAN digests at most, so sections of any size are digested in many tasks, and digests depend
on rows and order only, not on files or partitions. What is damaged is named by section and rows.

Datasets, models, ensemble bundles, frontends and thermometers are artifacts with sections and checks of their own, below.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators.running import row_numbers, running_sums

FAN = 4096
MANIFEST, DIGESTS = "_manifest", "_digests"


def _row_digest(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != "_row")), {"ignoreNullFields": "false"}), 256)


def block_digests(numbered: DataFrame, fan: int = FAN) -> DataFrame:
    """block, rows, digest of a table with `_row`."""
    each = numbered.select(F.col("_row"), _row_digest(numbered).alias("h"))
    rows = each.groupBy(F.floor(F.col("_row") / fan).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_row", "h"))).alias("r"))
    return rows.select("block", F.size("r").cast("long").alias("rows"), F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ""), 256).alias("digest"))


def section_digest(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """One row: rows, digest, from `block_digests`."""
    groups = blocks.groupBy(F.floor(F.col("block") / fan).alias("g")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("b"))
    tops = groups.select("g", "rows", F.sha2(F.array_join(F.transform("b", lambda x: x["digest"]), ""), 256).alias("digest"))
    whole = tops.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.array_sort(F.collect_list(F.struct("g", "digest"))).alias("t"))  # a digest for each FAN * FAN rows
    return whole.select("rows", F.sha2(F.array_join(F.transform("t", lambda x: x["digest"]), ""), 256).alias("digest"))


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def artifact_digest(kind: str, head: dict, sections: dict[str, dict]) -> str:
    return hashlib.sha256(_canonical([kind, head, {n: [s["rows"], s["digest"]] for n, s in sections.items()}]).encode()).hexdigest()


def publish(spark: SparkSession, path: str, kind: str, head: dict, sections: dict[str, tuple[DataFrame, list[str] | str]], fan: int = FAN) -> dict:
    """Write the sections, then the manifest; gives the manifest. A section is a table and the columns of its order, which must not tie, or the column that numbers its rows from 0."""
    listed = {}
    for name, (df, order) in sections.items():
        numbered = df.withColumn("_row", F.col(order).cast("long")) if isinstance(order, str) else row_numbers(df, [F.col(c) for c in order], "_row")
        numbered.repartitionByRange("_row").sortWithinPartitions("_row").write.parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        block_digests(back, fan).write.parquet(f"{path}/{DIGESTS}/{name}")
        found = section_digest(spark.read.parquet(f"{path}/{DIGESTS}/{name}"), fan).first()  # one row
        listed[name] = {"rows": found["rows"], "digest": found["digest"], "order": order, "schema": back.drop("_row").schema.simpleString()}
    manifest = {"kind": kind, "header": head, "sections": listed, "fan": fan, "digest": artifact_digest(kind, head, listed)}
    spark.createDataFrame([(_canonical(manifest),)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")
    return manifest


def manifest(spark: SparkSession, path: str, kind: str | None = None) -> dict:
    """The manifest, checked against itself; data is not opened."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise ValueError(f"{path}: not a finished artifact")
    got = json.loads(spark.read.text(f"{path}/{MANIFEST}").first().value)
    if artifact_digest(got["kind"], got["header"], got["sections"]) != got["digest"]:
        raise ValueError(f"{path}: the manifest does not match its digest")
    if kind is not None and got["kind"] != kind:
        raise ValueError(f"{path}: a {got['kind']}, not a {kind}")
    return got


def header(spark: SparkSession, path: str, kind: str | None = None) -> dict:
    return manifest(spark, path, kind)["header"]


def damage(spark: SparkSession, path: str) -> DataFrame:
    """section, first, last, problem of rows whose blocks don't have their digests any more; empty when all is sound."""
    known, out = manifest(spark, path), None
    for name, section in known["sections"].items():
        fan = known["fan"]
        stored = spark.read.parquet(f"{path}/{DIGESTS}/{name}").select("block", F.col("digest").alias("want"), F.col("rows").alias("n_want"))
        found = block_digests(spark.read.parquet(f"{path}/{name}"), fan).select("block", "digest", "rows")
        both = stored.join(found, "block", "full").where(~F.col("want").eqNullSafe(F.col("digest")))
        problem = F.when(F.col("digest").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("rows") != F.col("n_want"), "rows lost or added").otherwise("changed")
        rows = both.select(F.lit(name).alias("section"), (F.col("block") * fan).alias("first"), (F.col("block") * fan + F.coalesce("n_want", "rows") - 1).alias("last"), problem.alias("problem"))
        top = section_digest(spark.read.parquet(f"{path}/{DIGESTS}/{name}"), fan).where(F.col("digest") != section["digest"])
        rows = rows.unionByName(top.select(F.lit(name).alias("section"), F.lit(0).cast("long").alias("first"), F.col("rows").cast("long") - F.lit(1), F.lit("digests changed").alias("problem")).toDF("section", "first", "last", "problem"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tables(spark: SparkSession, path: str, kind: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The sections, in their order's columns; `verify` reads all rows first and names what is damaged."""
    known = manifest(spark, path, kind)
    if verify:
        bad = damage(spark, path).orderBy("section", "first").limit(5).collect()
        if bad:
            raise ValueError(f"{path}: checksum mismatch: " + "; ".join(f"{r.section} rows {r.first}-{r.last} {r.problem}" for r in bad))
    return {name: spark.read.parquet(f"{path}/{name}").drop("_row") for name in known["sections"]}


def _refuse(bad: DataFrame, what: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(", ".join(f"{k} {v}" for k, v in r.asDict().items()) for r in rows))


# --- datasets: packed frames, their labels and the rows to train onsets on -----------------------------


def dataset_violations(frames: DataFrame, indices: DataFrame, feature_words: int, label_words: int) -> DataFrame:
    """row, problem of frames (row, features, activity, onset: words) and indices (place, row) that don't fit together."""
    problem = (
        F.when(F.col("features").isNull() | F.col("activity").isNull() | F.col("onset").isNull(), "features and labels disagree on frames")
        .when(F.size("features") != feature_words, "another number of feature words")
        .when((F.size("activity") != label_words) | (F.size("onset") != label_words), "another number of label words")
    )
    bad = frames.select("row", problem.alias("problem")).where("problem is not null")
    outside = indices.join(frames.select("row"), "row", "left_anti").select("row", F.lit("index outside the frames").alias("problem"))
    gaps = frames.agg(F.count("*").alias("n"), F.count_distinct("row").alias("d"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    gaps = gaps.where("n > 0 and (n <> d or lo <> 0 or hi <> n - 1)").select(F.col("hi").alias("row"), F.lit("rows don't follow each other from 0").alias("problem"))
    return bad.unionByName(outside).unionByName(gaps)


def publish_dataset(spark: SparkSession, path: str, frames: DataFrame, indices: DataFrame, head: dict, fan: int = FAN) -> dict:
    """A dataset; head needs feature_count, note_count, midi_min, sample_rate, hop_size, seed and can have fingerprint."""
    words = [-(-head[k] // 64) for k in ("feature_count", "note_count")]
    _refuse(dataset_violations(frames, indices, *words), "the dataset doesn't fit together")
    sections = {name: (frames.select("row", F.col(name).alias("words")), "row") for name in ("features", "activity", "onset")}
    return publish(spark, path, "dataset", head, sections | {"indices": (indices.select("place", "row"), ["place"])}, fan)


def read_dataset(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """frames (row, features, activity, onset) and indices (place, row)."""
    t = tables(spark, path, "dataset", verify)
    words = [t[name].withColumnRenamed("words", name) for name in ("features", "activity", "onset")]
    return words[0].join(words[1], "row").join(words[2], "row"), t["indices"]


# --- models and bundles of them ------------------------------------------------------------------------

INT16 = 32767


def bundle_violations(members: DataFrame, clauses: DataFrame, literals: DataFrame) -> DataFrame:
    """id, problem: ids that repeat, members out of order, geometries or fingerprints that differ, weights that 16 bits don't hold, literals without a place.

    members: head, place, id, outputs, literals (counts), fingerprint. clauses: id, clause, weights. literals: id, clause, literal.
    """
    p = lambda df, text: df.select("id", F.lit(text).alias("problem"))
    many = members.groupBy("id").count().where("count > 1")
    places = members.groupBy("head").agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("id").alias("id"))
    places = places.where("n <> d or lo <> 0 or hi <> n - 1")
    kinds = members.groupBy("outputs", "literals").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = kinds.agg(F.max_by("id", F.struct("n", "id")).alias("usual"))  # one row
    geometry = kinds.join(F.broadcast(first), F.col("id") != F.col("usual"))
    prints = members.select(F.coalesce("fingerprint", F.lit("")).alias("f"), "id").groupBy("f").agg(F.min("id").alias("id"))
    usual = prints.agg(F.min("f").alias("f0"))
    prints = prints.join(F.broadcast(usual), F.col("f") != F.col("f0"))
    known = members.select("id", "outputs", F.col("literals").alias("n_literals"))
    own = clauses.join(known, "id", "left")
    unknown = own.where("outputs is null")
    large = own.where(F.exists("weights", lambda w: (F.abs(w) > INT16) | w.isNull()))
    wide = own.where(F.size("weights") != F.col("outputs"))
    lost = literals.join(clauses.select("id", "clause"), ["id", "clause"], "left_anti")
    outside = literals.join(known, "id").where((F.col("literal") < 0) | (F.col("literal") >= F.col("n_literals")))
    twice = literals.groupBy("id", "clause", "literal").count().where("count > 1")
    out = p(many, "id repeats")
    for df, text in (
        (places, "members are out of order"), (geometry, "geometries differ"), (prints, "fingerprints differ"), (unknown, "clause of an unknown member"), (large, "weight does not fit int16"),
        (wide, "another number of weights"), (lost, "literal without a clause"), (outside, "literal out of range"), (twice, "literal repeats"),
    ):
        out = out.unionByName(p(df, text))
    return out.distinct()


def sparse_rows(clauses: DataFrame, literals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clauses (id, clause, weights, first, size) and literals (position, literal): each clause's literals are those at first .. first + size - 1.

    Positions are running sums over all clauses in order of (id, clause), taken by ranges.
    """
    sizes = clauses.join(literals.groupBy("id", "clause").agg(F.count("*").alias("size")), ["id", "clause"], "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    upto = running_sums(sizes, [F.col("id"), F.col("clause")], upto=F.col("size"))
    placed = upto.select("id", "clause", "weights", (F.col("upto") - F.col("size")).alias("first"), "size")
    numbered = row_numbers(literals.select("id", "clause", "literal"), [F.col(c) for c in ("id", "clause", "literal")], "position")
    return placed, numbered.select("position", "literal")


def publish_bundle(spark: SparkSession, path: str, members: DataFrame, clauses: DataFrame, literals: DataFrame, head: dict, legacy: bool = False) -> dict:
    """A bundle of models; all must have one geometry and one fingerprint. Models without a fingerprint need `legacy`."""
    _refuse(bundle_violations(members, clauses, literals), "the models can't be bundled")
    if not legacy and members.where("fingerprint is null").limit(1).count():
        raise ValueError("models without a feature fingerprint are bundled only if `legacy` says so")
    rows, flat = sparse_rows(clauses, literals)
    return publish(spark, path, "bundle", head, {"members": (members, ["head", "place"]), "clauses": (rows, ["id", "clause"]), "literals": (flat, "position")})


BLOCK = 1 << 16


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members, clauses (id, clause, weights) and literals (id, clause, literal)."""
    t = tables(spark, path, "bundle", verify)
    # a clause's range of positions meets the literals by blocks of positions
    spans = t["clauses"].where("size > 0").select("id", "clause", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("size") - 1) / BLOCK))).alias("b"))
    met = t["literals"].withColumn("b", F.floor(F.col("position") / BLOCK)).join(spans, "b").where("position >= first and position < first + size")
    return t["members"], t["clauses"].select("id", "clause", "weights"), met.select("id", "clause", "literal")


def publish_model(spark: SparkSession, path: str, clauses: DataFrame, literals: DataFrame, head: dict) -> dict:
    """One model: clauses (clause, weights) and literals (clause, literal)."""
    one = spark.createDataFrame([("model", 0, "model", head["outputs"], head["literals"], head.get("fingerprint"))], "head string, place int, id string, outputs int, literals int, fingerprint string")
    named = lambda df: df.select(F.lit("model").alias("id"), "*")
    _refuse(bundle_violations(one, named(clauses), named(literals)), "the model is not sound")
    return publish(spark, path, "model", head, {"clauses": (clauses, ["clause"]), "literals": (literals, ["clause", "literal"])})


# --- frontends and thermometers ------------------------------------------------------------------------


def publish_frontend(spark: SparkSession, path: str, entries: DataFrame, head: dict) -> dict:
    """Thermometer entries of all banks (bank, out_col, raw_col, threshold, ulps): out_col counts from 0 in each bank, raw_col is below head["columns"]."""
    inside = F.col("raw_col").between(0, head["columns"] - 1) & F.col("threshold").isNotNull() & ~F.isnan("threshold") & (F.col("ulps") >= 0)
    bad = entries.where(~F.coalesce(inside, F.lit(False))).select("bank", "out_col", F.lit("no such column, threshold or tolerance").alias("problem"))
    order = entries.groupBy("bank").agg(F.count("*").alias("n"), F.count_distinct("out_col").alias("d"), F.min("out_col").alias("lo"), F.max("out_col").alias("hi"))
    order = order.where("n <> d or lo <> 0 or hi <> n - 1").select("bank", F.col("hi").alias("out_col"), F.lit("columns don't follow each other from 0").alias("problem"))
    _refuse(bad.unionByName(order), "the frontend is not sound")
    return publish(spark, path, "frontend", head, {"entries": (entries, ["bank", "out_col"])})


def publish_thermometer(spark: SparkSession, path: str, literals: DataFrame, head: dict) -> dict:
    """Literals of a fitted thermometer (literal, d, q, threshold)."""
    return publish(spark, path, "thermometer", head, {"literals": (literals, "literal")})


# --- metadata that grew ----------------------------------------------------------------------------------

#: from each version of a header to the next: what a dataset of the older version means in terms of the newer
UPGRADES = {
    1: lambda h: h | {"version": 2, "fingerprint": h.get("fingerprint"), "sampling": h.get("sampling", "natural")},
    2: lambda h: {k: v for k, v in h.items() if k != "harmonic_contrast"} | {"version": 3, "semantics": {"contrast": "every harmonic" if h.get("harmonic_contrast") else "fundamental", "frames": "causal"}},
}
LATEST = 3


def upgraded(head: dict) -> dict:
    """The header in the latest version: rules applied one after the other; a header of the latest version stays as it is."""
    version = head.get("version", 1)
    if not 1 <= version <= LATEST:
        raise ValueError(f"unknown version {version}")
    for v in range(version, LATEST):
        head = UPGRADES[v](head)
    return head


def upgrade(spark: SparkSession, path: str, target: str) -> dict:
    """The artifact at `path` under the latest header, in `target`: sections are copied as they are, and must keep their digests."""
    old = manifest(spark, path)
    t = tables(spark, path)
    new = publish(spark, target, old["kind"], upgraded(old["header"]), {n: (t[n], s["order"]) for n, s in old["sections"].items()}, old["fan"])
    changed = [n for n, s in old["sections"].items() if new["sections"][n]["digest"] != s["digest"]]
    if changed:
        raise ValueError(f"{target}: the payload of {', '.join(changed)} changed")
    return new
