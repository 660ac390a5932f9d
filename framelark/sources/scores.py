"""Score files: tab-separated integer scores and decisions of each frame behind a block of metadata, checked as a whole.

    #<magic>
    #head=activity
    #frames=..   #outputs=..   #midi_min=..   #sample_rate=..   #hop_size=..   #threshold=..
    frame  score_40 ..  pred_40 ..
    0      -3 ..        0 ..

Metadata lines can have keys beyond the required ones. A file is read by as many tasks as it has splits; a folder of text files written by
`write_score_file` reads as one file. `problems` gives a row for everything that breaks the form; `read_score_file` refuses such files and names the first.
Frames are 0 to frames - 1, each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the metadata that every score file has
NUMBERS = ("frames", "outputs", "midi_min", "sample_rate", "hop_size", "threshold")
REQUIRED = ("head", *NUMBERS)
INT32 = (-(1 << 31), (1 << 31) - 1)


def write_score_file(scores: DataFrame, path: str, magic: str, meta: dict) -> None:
    """Rows (frame, pitch, score, pred) as one score file in parts; `meta` needs REQUIRED but frames, which are counted.

    Rows go by ranges of frames, so the parts in order are the file.
    """
    pitches = range(int(meta["midi_min"]), int(meta["midi_min"]) + int(meta["outputs"]))
    wide = scores.groupBy("frame").agg(*(F.max(F.when(F.col("pitch") == p, F.col(c))).alias(f"{c}_{p}") for c in ("score", "pred") for p in pitches))
    columns = ["frame", *(f"{c}_{p}" for c in ("score", "pred") for p in pitches)]
    frames = scores.select("frame").distinct().count()
    head = [f"#{magic}", *(f"#{k}={v}" for k, v in {**meta, "frames": frames}.items()), "\t".join(columns)]
    first = scores.sparkSession.createDataFrame([(k - len(head), line) for k, line in enumerate(head)], "at long, value string")
    rows = wide.select(F.col("frame").cast("long").alias("at"), F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))
    first.unionByName(rows).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select("value", place.alias("place"))


def metadata(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Values of each metadata key, in order; '' has the lines that are none."""
    out: dict[str, list[str]] = {}
    for r in _lines(spark, path).where("value like '#%'").orderBy("place").limit(1000).collect():  # a dozen lines
        key, sep, value = r.value[1:].partition("=")
        out.setdefault(key if sep else "", []).append(value if sep else r.value[1:])
    return out


def _head_problems(meta: dict[str, list[str]], magic: str) -> list[str]:
    marks = meta.get("", [])
    found = [f"malformed metadata: {m}" for m in marks if m != magic]
    found += [f"missing {magic} marker"] if magic not in marks else [f"duplicate {magic} marker"] if marks.count(magic) > 1 else []
    found += [f"duplicate metadata key {k}" for k, v in meta.items() if k and len(v) > 1]
    found += [f"missing metadata key {k}" for k in REQUIRED if k not in meta]
    found += [f"metadata {k} is no whole number" for k in NUMBERS if k in meta and not meta[k][0].lstrip("-").isdigit()]
    return found + [f"metadata {k} is not positive" for k in ("frames", "outputs", "sample_rate", "hop_size") if k in meta and meta[k][0].lstrip("-").isdigit() and int(meta[k][0]) <= 0]


def problems(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """problem, frame (null: of the file as a whole)."""
    meta = metadata(spark, path)
    found = _head_problems(meta, magic)
    schema = "problem string, frame long"
    if found:
        return spark.createDataFrame([(p, None) for p in found], schema)
    n, frames, low = (int(meta[k][0]) for k in ("outputs", "frames", "midi_min"))
    header = "\t".join(["frame", *(f"{c}_{p}" for c in ("score", "pred") for p in range(low, low + n))])
    lines = _lines(spark, path)
    order = lines.agg(F.max(F.when(F.startswith("value", F.lit("#")), F.col("place"))).alias("last"), F.min(F.when(~F.startswith("value", F.lit("#")), F.col("place"))).alias("first"), F.min_by("value", F.when(~F.startswith("value", F.lit("#")), F.col("place"))).alias("head"))
    whole = order.select(F.when(F.col("head").isNull(), "no rows").when(F.col("head") != header, "unexpected columns").when(F.col("last") > F.col("first"), "metadata after the columns").alias("problem"), F.lit(None).cast("long").alias("frame")).where("problem is not null")
    cells = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != header)).select("value", cells.alias("c"))
    rows = rows.select("value", F.size("c").alias("width"), F.when(~F.exists("c", lambda x: ~x.rlike("^-?[0-9]{1,18}$")), F.transform("c", lambda x: x.cast("long"))).alias("v"))
    frame, scores, preds = F.col("v")[0], F.slice("v", 2, n), F.slice("v", 2 + n, n)
    problem = (
        F.when(F.col("value") == "", "blank line")
        .when(F.col("width") != 1 + 2 * n, F.concat(F.lit("another number of columns: "), F.col("width").cast("string")))
        .when(F.col("v").isNull(), "not a whole number")
        .when(F.exists(scores, lambda x: ~x.between(*INT32)), "score outside int32")
        .when(F.exists(preds, lambda x: ~x.isin(0, 1)), "decision that is not 0 or 1")
        .when(~frame.between(0, frames - 1), "frame out of range")
    )
    bad = rows.select(problem.alias("problem"), frame.alias("frame")).where("problem is not null")
    seen = rows.where("v is not null").groupBy(frame.alias("frame")).count()
    twice = seen.where("count > 1").select(F.lit("frame occurs twice").alias("problem"), "frame")
    missing = seen.where(F.col("frame").between(0, frames - 1)).agg(F.count("*").alias("n")).where(F.col("n") != frames).select(F.concat(F.col("n").cast("string"), F.lit(f" of {frames} frames")).alias("problem"), F.lit(None).cast("long").alias("frame"))
    return whole.unionByName(bad).unionByName(twice).unionByName(missing)


def read_score_file(spark: SparkSession, path: str, magic: str) -> tuple[dict, DataFrame]:
    """Metadata, and rows (frame, pitch, score, pred), of a sound file."""
    bad = problems(spark, path, magic).orderBy(F.col("frame").isNotNull(), "frame").limit(3).collect()
    if bad:
        raise ValueError(f"{path}: " + "; ".join(r.problem + ("" if r.frame is None else f" at frame {r.frame}") for r in bad))
    meta = {k: int(v[0]) if k in NUMBERS else v[0] for k, v in metadata(spark, path).items() if k}
    n, low = meta["outputs"], meta["midi_min"]
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("value rlike '^[0-9]'").select(cells.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return meta, rows.select(F.col("c")[0].cast("long").alias("frame"), (F.col("k") + low).alias("pitch"), F.get("c", F.col("k") + 1).cast("int").alias("score"), F.get("c", F.col("k") + 1 + n).cast("int").alias("pred"))
