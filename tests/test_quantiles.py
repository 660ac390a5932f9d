"""Exact quantiles, running sums and mergeable digests against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import contracts as C
from framelark.operators import quantiles as Q
from framelark.operators import running as R


def some_values():
    rnd = np.random.default_rng(4)
    cols = {
        0: rnd.normal(size=3000), 1: np.full(40, 2.5), 2: rnd.integers(0, 5, 900).astype(float), 3: np.array([7.0]), 4: 2.0 ** -np.arange(300.0),
        5: np.concatenate([np.full(500, -1e300), [1e-300, 0.0, -0.0], np.full(20, 1e300)]), 6: np.array([1.0, 1.0 + 2**-52]),
    }
    return cols


@pytest.mark.parametrize("small_rows", [0, 10**9])
def test_quantiles(spark, small_rows):
    cols = some_values()
    rows = [(d, float(v)) for d, x in cols.items() for v in x] + [(0, None), (9, None)]
    points = (0.0, 0.05, 0.5, 0.75, 0.95, 0.999, 1.0)
    table = spark.createDataFrame(rows, "d int, v double").repartition(6)
    got = {(r.d, r.q): r.v for r in Q.quantiles(table, points, small_rows=small_rows).collect()}
    assert set(got) == {(d, q) for d in cols for q in range(len(points))}
    for d, x in cols.items():
        for q, p in enumerate(points):
            ordered, at = np.sort(x), p * (len(x) - 1)
            lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert got[d, q] == pytest.approx(lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi, rel=1e-12), (d, p)


@pytest.mark.parametrize("small_rows", [0, 10**9])
def test_counted_values(spark, small_rows):
    rnd = random.Random(3)
    rows = [(rnd.random(), rnd.randint(0, 4)) for _ in range(300)]
    whole = np.repeat([v for v, _ in rows], [n for _, n in rows])
    table = spark.createDataFrame(rows, "v double, n int").withColumn("d", F.lit(1))
    got = [r.v for r in Q.quantiles(table, (0.1, 0.5, 0.9), ("d",), "v", F.col("n"), small_rows=small_rows).orderBy("q").collect()]
    assert got == pytest.approx(np.quantile(whole, [0.1, 0.5, 0.9]).tolist())
    assert Q.quantiles(table.limit(0), (0.5,), small_rows=small_rows).count() == 0


def test_running_sums_and_numbers(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(40), rnd.randrange(9)) for i in range(500)]
    table = spark.createDataFrame(rows, "id int, k int, v int").repartition(7)
    got = {r.id: r.s for r in R.running_sums(table, [F.col("k").desc()], s=F.col("v")).collect()}
    assert got == {i: sum(v2 for _, k2, v2 in rows if k2 >= k) for i, k, _ in rows}
    places = {r.id: r.place for r in R.row_numbers(table, [F.col("k"), F.col("id")], "place").collect()}
    assert places == {i: n for n, (i, k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert R.running_sums(table.limit(0), [F.col("k")], s=F.col("v")).count() == 0


def test_digests_do_not_depend_on_order(spark):
    rows = [(i % 3, i, None if i % 7 == 0 else f"t{i % 11}") for i in range(200)] + [(0, 1, "x"), (0, 1, "x")]
    table = spark.createDataFrame(rows, "g int, a int, b string")
    digest = lambda df: {r.g: (r.digest, r.rows) for r in C.fingerprint(df, "g").collect()}
    whole = digest(table)
    assert whole == digest(table.repartition(9).orderBy(F.col("a").desc())) and whole[0][1] == 69
    assert digest(table.dropDuplicates())[0] != whole[0] and digest(table.withColumn("a", F.col("a") + (F.col("a") == 4).cast("int")))[1] != whole[1]


def test_leaks_and_confirmation_guards(spark):
    from framelark.operators import confirmation as K

    splits = spark.createDataFrame([(1, "a", "train"), (2, "a", "train"), (3, "b", "test"), (4, "b", "train"), (5, None, "test"), (6, None, "train")], "id long, grp string, split string")
    used = spark.createDataFrame([("f", 1), ("f", 2), ("f", 6)], "fit string, id long")
    assert K.leaks(used, splits).count() == 0
    planted = used.union(spark.createDataFrame([("f", 3), ("f", 4), ("g", 9), ("g", 5), ("f", 3)], used.schema))
    assert {tuple(r) for r in K.leaks(planted, splits).collect()} == {("f", 3, "held-out row"), ("f", 4, "group of a held-out row"), ("g", 9, "unknown row"), ("g", 5, "held-out row")}
    validation = spark.createDataFrame([("x", {"t": 1.0}, 0.5), ("y", {"t": 2.0}, 0.7), ("z", {"t": 3.0}, 0.7)], "candidate string, params map<string, double>, f1 double")
    choice = K.frozen(validation, F.col("f1").desc())
    assert choice.first().candidate == "y"
    runs = spark.createDataFrame([("y", {"t": 2.0}, 1), ("y", {"t": 2.5}, 1), ("x", {"t": 1.0}, 1), ("y", {"t": 2.0}, 2)], "candidate string, params map<string, double>, run int")
    assert sorted(r.problem for r in K.confirmation_guards(choice, runs).collect()) == ["confirmed more than once", "not the frozen candidate", "parameters changed"]
    assert K.confirmation_guards(choice, runs.limit(1)).count() == 0
