"""The corpus pipeline: five stages from raw documents to a training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last return
the columns of `documents`; the last adds the columns of the mixture.

A stage's result is written before the next stage begins; then the intermediate results of the earlier stage are removed. `run` owns those of its
stages and removes them, and each stage's result when the next one is written, so runs beside each other don't meet. A stage that is called by itself
leaves its intermediate results to a later stage called in the same session and thread.

Edge cases, in all stages: a column of the documents keeps its name and values whatever its
name is (columns that the last stage adds get underscores where theirs is taken); an
empty table gives an empty table; repeated rows are treated alike, and those that repeat an id are
documents of that id. What a stage does with null and empty texts, null ids and ties
is in its docstring.
"""

from __future__ import annotations

import threading
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm import decontaminate, mixing, near_dedup, repeats, site_bayes
from framelark.llm.common import remove, shared_folder, stashes, table

def _stage(f):
    """A stage that removes what earlier stages, called by themselves in this session and thread, have left."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [g for _, g in STAGES].index(run_stage)
        left = spark.__dict__.setdefault("_framelark_stages", {}).setdefault(threading.get_ident(), [])
        for entry in [e for e in left if e[0] < place]:
            remove(spark, entry[1])
            left.remove(entry)
        out, made = run_stage.owned(spark, docs, sf_dir)
        left.append((place, made))
        return out

    def owned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[str]]:
        """The stage's result and the paths that it needs until it is written."""
        with stashes() as made:
            return f(spark, docs, sf_dir), made

    run_stage.owned = owned
    return run_stage


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null, empty and wordless texts are rejected. Null source or lang is a site or path of its own."""
    return site_bayes.without_bad(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id. Texts without words and null ids are in no group, and stay."""
    return near_dedup.without_near_duplicates(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier in the corpus are cut; a null id counts as the largest. Texts of fewer than 20 words stay as they are, null ones too; a text of which nothing is left goes."""
    return _recount(repeats.without_repeats(docs))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark go. Texts without hits, null ones too, stay byte for byte; items without words are ignored."""
    return _recount(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights, and shuffled. A null source is a source of its own, a null id is drawn as an empty one; sources without text go."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: The classifier is fitted, so SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder; only the last one's result stays there."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        out, made = stage.owned(spark, docs, sf_dir)
        out.write.parquet(path)
        remove(spark, [*made, *before])
        docs, before = spark.read.parquet(path), [path]
    return docs
