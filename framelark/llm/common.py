"""Shared pieces: tables, written intermediate results, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators.running import row_numbers

#: A side of a join is broadcast only when its measured size is at most this.
BROADCAST_ROWS = 200_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 4 << 20  # default bound on the Arrow batches sent to Python


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Python workers live on between tasks: large buffers go back to the system when they are freed, and few small ones are kept
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def bounded_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: the bytes of Arrow batches, and what idle workers hold.

    A session that sets a bound or variables of its own keeps them.
    """
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing (tests, local runs) a temporary folder is used;
    a local master has no other machine that would have to see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_framelark_shared", None)
    if made is None:
        made = spark._framelark_shared = "file://" + tempfile.mkdtemp(prefix="framelark-")
    return made


def stash(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    computing `df` again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")  # what was shuffled for the result isn't needed after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    for kept in _opened():
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_threads = threading.local()


def _opened() -> list[list[str]]:
    """The lists of this thread that are open."""
    return _threads.__dict__.setdefault("lists", [])


@contextmanager
def stashes():
    """The paths of the results that `stash` writes within: what is made of them must be written before they are removed."""
    made: list[str] = []
    _opened().append(made)
    try:
        yield made
    finally:
        _opened()[:] = [x for x in _opened() if x is not made]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written results."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores added until no column of `df` has it: a helper column never meets one of the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def is_number(docs: DataFrame, key: str) -> bool:
    """Whether ids are whole numbers that a long holds."""
    return docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")


def id_numbers(docs: DataFrame, key: str) -> DataFrame:
    """(_id, _n): a number for each id of another type, in their order; written, so it is the same each time it is read."""
    ids = docs.select(F.col(key).alias("_id")).where("_id is not null").distinct()
    return stash(row_numbers(ids, [F.col("_id")], "_n"))
