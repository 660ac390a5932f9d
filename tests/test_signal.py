import numpy as np
from pyspark.sql import functions as F

from framelark.operators import blocks
from framelark.operators import signal as G


def test_spectra_of_blocks(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(20000) / 22050)
    rows = [(1, b, [float(v) for v in x[b * blocks.SPAN : (b + 1) * blocks.SPAN]]) for b in range(2)]
    cut = blocks.with_halo(spark.createDataFrame(rows, "track long, block long, samples array<float>"), G.FFT - 1)
    got = {r.frame: np.array(r.magnitude) for r in G.spectra(cut).collect()}
    assert sorted(got) == list(range(79)) and abs(int(np.argmax(got[60])) - 440 * 2048 / 22050) < 1 and 0.8 < max(got[60]) <= 1.01
    w = np.hanning(2048)
    for f in (0, 3, 63, 64, 70, 78):
        part = x[max(0, f * 256 + 1 - 2048) : f * 256 + 1]
        want = np.abs(np.fft.rfft(np.concatenate([np.zeros(2048 - len(part)), part]) * w)) / (w.sum() / 2)
        assert np.abs(got[f] - want).max() < 1e-5
    framed = {r.frame: r.x for r in G.framed(cut).collect()}
    assert all(np.allclose(framed[f], x[max(0, f * 256 + 1 - 2048) : f * 256 + 1], atol=1e-6) for f in range(79))


def test_random_numbers_do_not_depend_on_rows(spark):
    df = spark.range(100).select(F.col("id"), G.uniform64(F.col("id"), F.lit(3).cast("long")).alias("u"))
    a = {r.id: r.u for r in df.repartition(3).collect()}
    b = {r.id: r.u for r in df.orderBy(F.col("id").desc()).collect()}
    assert a == b and 0.4 < np.mean(list(a.values())) < 0.6


def test_clause_training_learns_a_conjunction(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        x = rng.random(6) < 0.5
        rows.append((int(x[0] and not x[3]), [int(k) for k in np.flatnonzero(x)]))
    table = spark.createDataFrame(rows, "y int, literals array<int>")
    members = [dict(zip(("member", "clauses", "threshold", "s", "epochs", "seed"), m)) for m in ((0, 10, 5, 3.0, 20, 7), (1, 20, 8, 3.0, 20, 8))]
    model = G.train_clauses(table, members, 6).toPandas()
    for _, m in model.groupby("member"):
        clauses = m.groupby("clause").agg(weight=("weight", "first"), literals=("literal", list))
        right = 0
        for y, lits in rows:
            on = set(lits) | {k + 6 for k in range(6) if k not in lits}
            score = sum(w for w, l in clauses.itertuples(index=False) if set(l) <= on)
            right += (score > 0) == bool(y)
        assert right > 0.95 * len(rows)
