"""Published artifacts: round trips, damage, refusals; repacking, upgrades and the onset sample."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelark.operators import repack as R
from framelark.operators import selection as S
from framelark.sources import artifacts as A

HEAD = {"feature_count": 70, "note_count": 49, "midi_min": 40, "sample_rate": 22050, "hop_size": 256, "seed": 1}
FRAMES = "row long, features array<long>, activity array<long>, onset array<long>"


def some_frames(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.getrandbits(63), rnd.getrandbits(6)], [rnd.getrandbits(40)], [rnd.getrandbits(40)]) for i in range(n)]
    return spark.createDataFrame(rows, FRAMES), spark.createDataFrame([(k, rnd.randrange(n)) for k in range(50)], "place long, row long")


def local(path):
    return Path(path.removeprefix("file://"))


def test_digests_do_not_depend_on_partitions(spark, tmp_path):
    frames, indices = some_frames(spark)
    a = A.publish_dataset(spark, f"file://{tmp_path}/a", frames.repartition(7), indices, HEAD, fan=16)
    b = A.publish_dataset(spark, f"file://{tmp_path}/b", frames.coalesce(1).orderBy(F.col("row").desc()), indices.repartition(3), HEAD, fan=16)
    assert a["sections"] == b["sections"] and a["digest"] == b["digest"]
    other = A.publish_dataset(spark, f"file://{tmp_path}/c", frames.withColumn("onset", F.when(F.col("row") == 200, F.array(F.lit(5).cast("long"))).otherwise(F.col("onset"))), indices, HEAD, fan=16)
    assert [n for n in a["sections"] if a["sections"][n]["digest"] != other["sections"][n]["digest"]] == ["onset"]
    got, places = A.read_dataset(spark, f"file://{tmp_path}/a")
    assert got.select(*frames.columns).exceptAll(frames).count() == 0 and got.count() == 300 and places.exceptAll(indices).count() == 0
    assert A.damage(spark, f"file://{tmp_path}/a").count() == 0


def test_damage_is_named(spark, tmp_path):
    frames, indices = some_frames(spark)
    path = f"file://{tmp_path}/a"
    A.publish_dataset(spark, path, frames, indices, HEAD, fan=16)
    there = spark.read.parquet(f"{path}/activity")
    rows = [(r._row, [1] if r._row == 37 else r.words, r.row) for r in there.collect() if r._row < 290]
    spark.createDataFrame(rows, "_row long, words array<long>, row long").select(*there.columns).write.mode("overwrite").parquet(f"{path}/activity")
    found = sorted((r.section, r.first, r.last, r.problem) for r in A.damage(spark, path).collect())
    assert found == [("activity", 32, 47, "changed"), ("activity", 288, 299, "rows lost or added")]
    with pytest.raises(ValueError, match="checksum mismatch: activity rows 32-47 changed"):
        A.read_dataset(spark, path)
    assert A.header(spark, path, "dataset")["hop_size"] == 256
    for f in local(f"{path}/features").glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:50])
    assert A.header(spark, path)["seed"] == 1  # opens no data
    with pytest.raises(Exception, match="features"):
        A.read_dataset(spark, path)


def test_unfinished_and_foreign_artifacts_are_not_opened(spark, tmp_path):
    frames, indices = some_frames(spark, 20)
    with pytest.raises(ValueError, match="not a finished artifact"):
        A.manifest(spark, f"file://{tmp_path}/none")
    path = f"file://{tmp_path}/a"
    A.publish_dataset(spark, path, frames, indices.where("row < 20"), HEAD)
    with pytest.raises(ValueError, match="a dataset, not a model"):
        A.tables(spark, path, "model")
    text = next(local(f"{path}/_manifest").glob("part-*"))
    text.write_text(text.read_text().replace('"hop_size":256', '"hop_size":512'))
    (local(f"{path}/_manifest") / f".{text.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="does not match its digest"):
        A.manifest(spark, path)


def test_datasets_that_do_not_fit_are_refused(spark, tmp_path):
    frames, indices = some_frames(spark, 20)
    inside = indices.where("row < 20")
    for bad, wrong, match in (
        (frames.withColumn("onset", F.when(F.col("row") != 3, F.col("onset"))), inside, "disagree on frames"),
        (frames.withColumn("features", F.slice("features", 1, 1)), inside, "feature words"),
        (frames.where("row <> 4"), inside.where("row <> 4"), "follow each other"),
        (frames, spark.createDataFrame([(0, 20)], "place long, row long"), "index outside"),
    ):
        with pytest.raises(ValueError, match=match):
            A.publish_dataset(spark, f"file://{tmp_path}/x", bad, wrong, HEAD)
    empty = A.publish_dataset(spark, f"file://{tmp_path}/e", frames.limit(0), indices.limit(0), HEAD)
    assert empty["sections"]["features"]["rows"] == 0 and A.read_dataset(spark, f"file://{tmp_path}/e")[0].count() == 0


def models(spark):
    rnd = random.Random(4)
    members = [("activity", k, f"a{k}", 3, 20, "f") for k in range(3)] + [("onset", k, f"o{k}", 3, 20, "f") for k in range(2)]
    clauses = [(m[2], c, [rnd.randint(-9, 9) for _ in range(3)]) for m in members for c in range(30)]
    literals = [(i, c, lit) for i, c, _ in clauses for lit in rnd.sample(range(20), rnd.choice([0, 1, 5]))]
    return (
        spark.createDataFrame(members, "head string, place int, id string, outputs int, literals int, fingerprint string"),
        spark.createDataFrame(clauses, "id string, clause int, weights array<int>"),
        spark.createDataFrame(literals, "id string, clause int, literal int"),
    )


def test_bundles(spark, tmp_path):
    m, c, lit = models(spark)
    a = A.publish_bundle(spark, f"file://{tmp_path}/a", m, c.repartition(5), lit.repartition(9), {})
    b = A.publish_bundle(spark, f"file://{tmp_path}/b", m, c.orderBy(F.rand(1)).coalesce(2), lit, {})
    assert a["digest"] == b["digest"]
    for got, want in zip(A.read_bundle(spark, f"file://{tmp_path}/a"), (m, c, lit), strict=True):
        assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    rows = A.tables(spark, f"file://{tmp_path}/a")["clauses"].orderBy("id", "clause").collect()
    upto = 0
    for r in rows:
        assert r.first == upto
        upto += r.size
    assert upto == lit.count()


def test_bundles_that_do_not_fit_are_refused(spark, tmp_path):
    m, c, lit = models(spark)
    change = lambda df, col, value, where: df.withColumn(col, F.when(F.expr(where), F.lit(value)).otherwise(F.col(col)))
    members = change(change(change(m, "place", 2, "id = 'a1'"), "outputs", 4, "id = 'o0'"), "fingerprint", "g", "id = 'a2'").union(m.where("id = 'a0'"))
    heavy = F.array(F.lit(40000), F.lit(0), F.lit(0))
    clauses = c.withColumn("weights", F.when(F.expr("id = 'a0' and clause = 2"), heavy).otherwise(F.col("weights"))).where("clause <> 5 or id <> 'o1'")
    literals = change(lit, "literal", 20, "id = 'a2' and clause > 3").union(spark.createDataFrame([("o1", 5, 1), ("a0", 1, 3), ("a0", 1, 3)], lit.schema))
    unknown = clauses.union(spark.createDataFrame([("zz", 0, [1, 2, 3])], c.schema))
    found = {(r.id, r.problem) for r in A.bundle_violations(members, unknown, literals).collect()}
    for id_, problem in (
        ("a0", "id repeats"), ("a0", "weight does not fit int16"), ("o0", "geometries differ"), ("o0", "another number of weights"), ("a2", "fingerprints differ"), ("a2", "literal out of range"),
        ("o1", "literal without a clause"), ("a0", "literal repeats"), ("zz", "clause of an unknown member"),
    ):
        assert (id_, problem) in found or (problem in ("fingerprints differ", "geometries differ") and problem in {p for _, p in found}), (id_, problem)
    assert "members are out of order" in {p for _, p in found}
    with pytest.raises(ValueError, match="int16"):
        A.publish_bundle(spark, f"file://{tmp_path}/x", m, clauses, lit.where("clause <> 5 or id <> 'o1'"), {})
    with pytest.raises(ValueError, match="legacy"):
        A.publish_bundle(spark, f"file://{tmp_path}/x", m.withColumn("fingerprint", F.lit(None).cast("string")), c, lit, {})
    A.publish_bundle(spark, f"file://{tmp_path}/old", m.withColumn("fingerprint", F.lit(None).cast("string")), c, lit, {}, legacy=True)


def test_frontends(spark, tmp_path):
    entries = spark.createDataFrame([("plain", k, k % 5, k / 7, 0) for k in range(20)] + [("extra", 0, 4, 0.5, 2)], "bank string, out_col int, raw_col int, threshold double, ulps int")
    A.publish_frontend(spark, f"file://{tmp_path}/f", entries, {"columns": 5})
    assert A.tables(spark, f"file://{tmp_path}/f", "frontend")["entries"].exceptAll(entries).count() == 0
    for bad in (entries.where("out_col <> 3"), entries.withColumn("raw_col", F.col("raw_col") + 1), entries.withColumn("ulps", F.lit(-1))):
        with pytest.raises(ValueError, match="frontend is not sound"):
            A.publish_frontend(spark, f"file://{tmp_path}/g", bad, {"columns": 5})


def test_repacking(spark, tmp_path):
    frames, indices = some_frames(spark, 100)
    other, _ = some_frames(spark, 100, seed=2)
    a, b, t = (f"file://{tmp_path}/{n}" for n in "abt")
    indices = spark.createDataFrame([(k, 3 * k) for k in range(30)], "place long, row long")
    A.publish_dataset(spark, a, frames, indices, HEAD)
    labels = other.select("row", "features").join(frames.select("row", "activity"), "row").join(other.select("row", "onset"), "row").select(*frames.columns)
    A.publish_dataset(spark, b, labels, indices, HEAD)
    R.repack(spark, a, b, t)
    got, _ = A.read_dataset(spark, t)
    want = frames.select("row", "features", "activity").join(other.select("row", "onset"), "row").select(*frames.columns)
    assert got.select(*frames.columns).exceptAll(want).count() == 0
    made = A.header(spark, t)["provenance"]
    assert made["features"]["artifact"] == A.manifest(spark, a)["digest"] and made["labels"]["sections"]["onset"] == A.manifest(spark, b)["sections"]["onset"]["digest"]
    with pytest.raises(ValueError, match="distinct"):
        R.repack(spark, a, a, t)
    cases = [
        (other, indices.withColumn("row", F.col("row") + 1), HEAD, ["activity sections are not identical", "indices sections are not identical"]),
        (labels.where("row < 95"), indices, HEAD | {"hop_size": 512, "sampling": "balanced", "tracks": [["x", 100]]}, ["headers disagree on hop_size", "frame counts differ", "natural sampling", "other tracks"]),
    ]
    for k, (f, i, head, wanted) in enumerate(cases):
        A.publish_dataset(spark, f"file://{tmp_path}/p{k}", f, i, head)
        found = [r.check for r in R.preconditions(spark, a, f"file://{tmp_path}/p{k}").collect()]
        assert all(any(problem in c for c in found) for problem in wanted), found
    there = spark.read.parquet(f"{b}/onset").collect()
    spark.createDataFrame([(r._row, r.row, [9]) for r in there], "_row long, row long, words array<long>").write.mode("overwrite").parquet(f"{b}/onset")
    with pytest.raises(ValueError, match="label source payload checksum"):
        R.repack(spark, a, b, f"file://{tmp_path}/u")


def test_merged_ranges(spark):
    rows = spark.createDataFrame([(s, r, f"{s}{r}") for s in "ab" for r in range(50)], "source string, row long, v string")
    ranges = spark.createDataFrame([("a", 5, 10, 0), ("b", 0, 3, 5), ("a", 20, 22, 8)], "source string, first long, last long, `into` long")
    assert R.range_problems(ranges).count() == 0
    got = [(r.row, r.source, r.source_row, r.v) for r in R.merged(rows, ranges).orderBy("row").collect()]
    want = [("a", k) for k in range(5, 10)] + [("b", k) for k in range(3)] + [("a", 20), ("a", 21)]
    assert got == [(i, s, k, f"{s}{k}") for i, (s, k) in enumerate(want)]
    assert R.missing_rows(R.merged(rows, ranges), ranges).count() == 0
    assert [r.source for r in R.missing_rows(R.merged(rows.where("row <> 21"), ranges), ranges).collect()] == ["a"]
    bad = spark.createDataFrame([("a", 0, 5, 0), ("b", 0, 5, 4), ("a", 5, 9, 12), ("b", 7, 7, 16)], ranges.schema)
    assert {(r.source, r.first, r.problem) for r in R.range_problems(bad).collect()} == {("b", 0, "overlap"), ("a", 5, "gap"), ("b", 7, "empty")}


def test_upgrades(spark, tmp_path):
    frames, indices = some_frames(spark, 30)
    first, second, third = (f"file://{tmp_path}/{k}" for k in range(3))
    old = A.publish_dataset(spark, first, frames, indices.where("row < 30"), HEAD | {"harmonic_contrast": True})
    once, twice = A.upgrade(spark, first, second), A.upgrade(spark, second, third)
    assert once["header"] == twice["header"] and once["digest"] == twice["digest"] and once["header"]["version"] == A.LATEST
    assert {n: s["digest"] for n, s in old["sections"].items()} == {n: s["digest"] for n, s in once["sections"].items()}
    assert once["header"]["semantics"]["contrast"] == "every harmonic" and "harmonic_contrast" not in once["header"]
    with pytest.raises(ValueError, match="unknown version"):
        A.upgraded({"version": 9})


def test_onset_sample(spark):
    rnd = random.Random(3)
    rows = [(t, f, a := rnd.choice([0, 0, 1, 2]), rnd.choice([0, 1]) if a else 0) for t in range(6) for f in range(200)]
    frames = spark.createDataFrame(rows, "track long, frame int, activity int, onsets int").repartition(7)
    got = S.onset_sample(frames, 4001).orderBy("place").collect()
    kind = {(t, f): 0 if o else 1 if a else 2 for t, f, a, o in rows}
    assert [r.place for r in got] == list(range(4001)) and all(kind[r.track, r.frame] == r.stratum for r in got)
    assert [sum(r.stratum == k for r in got) for k in range(3)] == [2201, 1400, 400]
    assert [r.stratum for r in got] != sorted(r.stratum for r in got)
    for k in range(3):  # every frame about as often
        seen = {}
        for r in got:
            if r.stratum == k:
                seen[r.track, r.frame] = seen.get((r.track, r.frame), 0) + 1
        n, total = sum(v == k for v in kind.values()), sum(seen.values())
        assert sum((seen.get(key, 0) - total / n) ** 2 for key, v in kind.items() if v == k) / (total / n) < n + 5 * (2 * n) ** 0.5
    assert S.onset_sample(frames.repartition(2), 4001).exceptAll(spark.createDataFrame(got)).count() == 0
    loud = frames.where("activity > 0")
    assert [S.onset_draws(c, 100) for c in ([5, 5, 5], [0, 5, 5], [5, 0, 5], [5, 5, 0], [0, 0, 0])] == [[55, 35, 10, 0], [0, 35, 65, 0], [55, 0, 45, 0], [55, 35, 0, 10], [0, 0, 0, 0]]
    assert {r.stratum for r in S.onset_sample(loud, 100).collect()} == {0, 1, 3} and S.onset_sample(frames.limit(0), 10).count() == 0


def test_onset_sample_sends_no_frames_through_the_driver(spark, monkeypatch):
    from framelark.plans import registry

    plans = []
    kept = S.in_order
    monkeypatch.setattr(S, "in_order", lambda rows, *order: (plans.append(rows), kept(rows, *order))[1])  # the frames as they are dealt, and the draws
    monkeypatch.setattr(S, "row_numbers", lambda rows, order, name: (plans.append(rows), rows.withColumn(name, F.lit(0)))[1])
    registry.QUERIES["o100_onset_sample"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2
    text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert "BroadcastHashJoin" not in text[0] and text[0].count("SortMergeJoin") == 2
    assert text[1].count("BroadcastHashJoin") == 1 and text[1].count("SortMergeJoin") == 1  # only the table of strata is broadcast
