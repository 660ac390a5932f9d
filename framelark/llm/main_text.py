"""HTML main text by union-free regular-expression inference.

For each host a wrapper is inferred from all of its pages (see `page_tree`): the
pages' token streams are aligned one after the other, mismatches turning into
optional groups, repeated groups or text slots. Each node of the wrapper is
then judged once, by where it stands, whether its text varies, and how much of the host's text it
holds; a page's main text is what stands in the nodes that its host's wrapper counts as article text.

Scale: each task merges the pages of a host that it reads into one wrapper before
anything is shuffled, so what is shuffled is bounded by hosts times tasks, not by
pages; a wrapper's own size is bounded (see `page_tree`). Wrappers of a host are merged in rounds of groups of
about FAN, so a host with a third of all pages is no single group however many tasks read it. Merging
is associative enough for any order: labels that occur stay covered. The table of
wrappers is broadcast only if its size is counted small, else joined by host with
splittable skew.

Edge cases: null or empty html gives an empty text. A null or unparsable url
belongs to the host ''. A page without text in an article or main element, whatever
other pages of its host have, falls back to the block with most text. Near copies of a page mostly count as one
when a text is judged as part of the template. Wrappers end at DEPTH levels; text below counts
by the last level that the wrapper has, in its place. Repeated rows are extracted each for itself. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm import page_tree as P
from framelark.llm.common import bounded_batches, small, stash

FAN = 32  # wrappers merged in one group
HELD_HOSTS = 2_000  # wrappers that a task holds before it emits them
BROADCAST_CHARS = 16_000_000


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _infer(batches):
    held: dict[str, list] = {}

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            page = page.as_py()
            if not page:
                continue
            host = host.as_py()
            tree = P.parse(page)
            w = P.wrapper_of(tree, P.print_of(tree))
            held[host] = P.merge(held[host], w) if host in held else w
            if len(held) >= HELD_HOSTS:
                yield emit()
                held.clear()
    if held:
        yield emit()


def _merge_group(key, table):
    out = None
    for w in table["wrapper"]:
        w = json.loads(w.as_py())
        out = w if out is None else P.merge(out, w)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(out)], pa.string())})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper for each host, as JSON, from columns url and html."""
    bounded_batches(pages.sparkSession)
    schema = "host string, wrapper string"
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_infer, schema)
    while True:
        parts = stash(parts.withColumn("n", F.monotonically_increasing_id()))
        many = stash(parts.groupBy("host").count().where("count > 1").select(F.col("host").alias("of"), F.ceil(F.col("count") / FAN).alias("groups")))
        rounds = many.agg(F.max("groups")).first()[0]
        if rounds is None:
            return parts.select("host", "wrapper")
        spread = parts.join(small(many), F.col("host") == F.col("of"), "left")
        group = F.coalesce(F.pmod(F.xxhash64("n"), F.col("groups")), F.lit(0)).alias("group")
        parts = spread.select("host", "wrapper", group).groupBy("host", "group").applyInArrow(_merge_group, schema)


@F.arrow_udf(T.StringType())
def apply_wrapper(pages: pa.Array, wrappers: pa.Array) -> pa.Array:
    verdicts: dict[str, dict] = {}
    out = []
    for page, wrapper in zip(pages, wrappers, strict=True):
        page, wrapper = page.as_py(), wrapper.as_py()
        if not page or not wrapper:
            out.append("")
            continue
        if wrapper not in verdicts:
            if len(verdicts) > 500:
                verdicts.clear()
            verdicts[wrapper] = P.judge(json.loads(wrapper))
        out.append("\n".join(P.extract(P.parse(page), verdicts[wrapper])))
    return pa.array(out, pa.string())


def extract_main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, url, its main text and the text's code points."""
    bounded_batches(pages.sparkSession)
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    side = F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return (
        rows.join(side, "host", "left")
        .select("page_id", "url", apply_wrapper(F.col("html"), F.col("wrapper")).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
