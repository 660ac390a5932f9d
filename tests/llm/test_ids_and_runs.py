"""Ids of other types, and pipelines that don't meet."""

import random
import threading

import pytest

from framelark.llm import near_dedup, repeats

SCHEMA = "doc_id {}, text string, lang string, source string, n_chars long"


def some_docs():
    rnd = random.Random(4)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(80)) for _ in range(12)]
    rows = []
    for i in range(60):
        words = rnd.choice(base).split()
        words[rnd.randrange(80)] = "other"
        rows.append((i, " ".join(words)))
    return rows + [(60, None), (61, ""), (62, base[0] + " tail " + base[1]), (63, base[0])]


def test_ids_of_other_types(spark):
    kind, name = "string", lambda i: f"doc-{i:04d}"
    rows = some_docs()
    numbers = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA.format("long"))
    named = spark.createDataFrame([(name(i), t, "en", "s", 0) for i, t in rows] + [(None, rows[0][1], "en", "s", 0)], SCHEMA.format(kind))
    want = {(name(r.doc_id), r.n_shingles, name(r.component_id), r.kept) for r in near_dedup.near_duplicates(numbers).collect()}
    got = [tuple(r) for r in near_dedup.near_duplicates(named).collect()]
    assert {r for r in got if r[0] is not None} == want and len(got) == len(rows) + 1
    assert [r for r in got if r[0] is None] == [(None, got[[r[0] for r in got].index(name(0))][1], None, True)]
    kept = {name(r.doc_id) for r in near_dedup.without_near_duplicates(numbers).collect()}
    assert {r.doc_id for r in near_dedup.without_near_duplicates(named).collect()} == kept | {None}
    want = {(name(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeats.report(numbers).collect()}
    assert {tuple(r) for r in repeats.report(named.where("doc_id is not null")).collect()} == want


def test_pipelines_beside_each_other(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = []
    other = threading.Thread(target=lambda: got.append(corpus_pipeline.run(spark, sf).count()))
    other.start()
    one, two = (stages["quality classifier"](spark, docs, sf) for _ in range(2))  # the second call leaves the first one's results
    assert one.count() == two.count() > 0
    one.write.parquet(str(tmp_path / "one"))
    near = stages["near duplicates"](spark, spark.read.parquet(str(tmp_path / "one")), sf)
    assert 0 < near.count() <= one.sparkSession.read.parquet(str(tmp_path / "one")).count()
    other.join(300)
    assert len(got) == 1 and got[0] > 0
