"""Vector codes against plain Lloyd over all rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from framelark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row string"


def brute(rows, parts, entries, rounds, scale=4096):
    kept = [(k, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts

    def stored(part):  # rows with equal ids go by their stored integers
        return np.array(part, "<i2" if all(-(1 << 15) <= x < 1 << 15 for x in part) else "<i4").tobytes()

    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [stored(r[2][p * width : (p + 1) * width]) for p in range(parts)]))
    kept = [r for r in kept if len(r[2]) == width * parts]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]

    def pick(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(pick(c[p], books[p])[1], []).append(c[p])
            for e, members in groups.items():
                books[p][e] = tuple(sum(m[k] for m in members) // len(members) for k in range(width))
    out, sums = [], {}
    for (key, lab, _), c in zip(kept, cut):
        best = [pick(c[p], books[p]) for p in range(parts)]
        out.append((key, lab, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(k, code, err, sums[lab], hashlib.sha256(text.encode()).hexdigest()) for k, lab, code, err in out]


def some_vectors(n, dims, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rnd.choice([rnd.gauss(0, 0.2), 0.25, -0.25]) for _ in range(dims)]
        rows.append((i * 3 - 5, v, rnd.choice([None, 0, 1, 2])))
    same = [0.5] * (dims - 1) + [-1e-9]
    rows += [(1000 + i, same, 4) for i in range(n)]
    rows += [(None, same, None), (1, same, 1), (1, same, 1), (2000, [float("nan")] + same[1:], 1), (2001, [None] + same[1:], 1), (2002, None, 1), (2003, [], 1), (2004, [math.inf] + same[1:], 1)]
    rows += [(2005, [30000.0] + same[1:], 0), (2006, [-20.0] * dims, 0)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 5, 3), (8, 16, 6), (16, 3, 2)])
def test_codes(spark, parts, entries, rounds):
    rows = some_vectors(60, 16)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = vector_codes.report(table, parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, parts, entries, rounds), key=repr)


def test_few_and_no_vectors(spark):
    rows = [(7, [1.0, 2.0], None), (8, [1.0, 2.5], 3)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = vector_codes.report(table, parts=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 16, 6)) and {r.error for r in got} == {0}
    assert vector_codes.report(table.limit(0)).count() == 0
    assert vector_codes.report(table.where("false").union(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA))).count() == 0
    other = vector_codes.report(table.union(spark.createDataFrame([(9, [1.0] * 4, 1, "", "")], SCHEMA)), parts=2).collect()
    assert sorted(map(tuple, other)) == sorted(map(tuple, got))


def test_large_and_small_components_agree():
    rnd = np.random.default_rng(2)
    x, book = rnd.integers(-(1 << 27), 1 << 27, (500, 8)), rnd.integers(-(1 << 27), 1 << 27, (16, 8))
    for scale in (1, 1 << 12):
        a, b = x // scale, book // scale
        code, error = vector_codes.nearest(a, b)
        exact = [[sum((int(s) - int(t)) ** 2 for s, t in zip(r, e)) for e in b] for r in a]
        assert code.tolist() == [min(range(16), key=lambda i: (d[i], i)) for d in exact] and error.tolist() == [min(d) for d in exact]


def test_parts_must_be_equal(spark):
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.report(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "", "")], SCHEMA), parts=2).collect()
