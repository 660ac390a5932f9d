"""Streaming twins against their batch forms, for several cuts into batches."""

import random

import pytest
from pyspark.sql import functions as F

from framelark.operators import metrics as M
from framelark.streaming import causal

STORE = "spark.sql.streaming.stateStore.providerClass"


def batches(spark, path, rows, schema, cut):
    for k, part in enumerate(cut):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.json(str(path / f"b{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path / "*"))


def test_voices_end_by_time(spark, tmp_path):
    rnd = random.Random(5)
    rows, now = [], 0
    for _ in range(60):
        now += rnd.choice([1, 50, 400, 1500, 4000])
        rows.append((rnd.randrange(2), 40 + rnd.randrange(2), now, rnd.choice([0, 1, 1])))
    rows.append((9, 40, now + 60_000, 0))  # the watermark goes on
    schema = "track long, pitch int, at_ms long, `on` int"
    table = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in causal.silent_voices(table, 1000, F.lit(now + 58_000)).collect())
    assert len(want) > 10
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, cut in (("one", [range(61)]), ("some", [range(20), range(20, 45), range(45, 61)]), ("mixed", [list(range(0, 30, 2)), list(range(1, 30, 2)), range(30, 61)])):
            late = "2 seconds" if name != "mixed" else "600 seconds"
            source = batches(spark, tmp_path / name, rows + [(9, 40, now + 1_000_000, 0)] * (name == "mixed"), schema, [*cut, [61]] if name == "mixed" else cut)
            out = []
            stream = causal.end_silent_voices(source, F.timestamp_millis("at_ms"), 1000, late)
            query = stream.writeStream.foreachBatch(lambda df, _, out=out: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None and sorted(out) == want, name
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


@pytest.mark.parametrize("cut", [[range(90)], [range(10), range(10, 11), range(11, 90)]])
def test_running_confusion(spark, tmp_path, cut):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b"]), rnd.randrange(2), rnd.randrange(2)) for _ in range(90)]
    schema = "head string, y int, p int"
    source = batches(spark, tmp_path / "in", rows, schema, cut)
    last = {}
    stream = causal.running_confusion(source, "head")
    query = stream.writeStream.foreachBatch(lambda df, _: last.update({r[0]: tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = M.confusion(spark.createDataFrame(rows, schema), "head").select("head", "tp", "fp", "fn").collect()
    assert query.exception() is None and last == {r.head: tuple(r) for r in want}
