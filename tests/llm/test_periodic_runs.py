"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from framelark.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs: for every period the maximal stretches, the smallest period of each."""
    n, least = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p):
                least.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in least.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tailed(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def some_texts():
    rnd = random.Random(4)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " * 500, "a b " * 4, "a b " * 3, "A a " * 9, "é é é é é é é", "a\x0bb\x0ca\x0db a b a b", "a\x1cb " * 8, "n m " * 7]
    for size in (2, 3, 40):
        for n in (8, 30, 90, 200):
            out.append(" ".join(f"w{rnd.randrange(size)}" for _ in range(n)))
    fib = ["a", "a b"]
    while len(fib) < 13:
        fib.append(fib[-1] + " " + fib[-2])
    out.append(fib[-1])
    morse = "a"
    for _ in range(9):
        morse += morse.translate(str.maketrans("ab", "ba"))
    out.append(" ".join(morse))
    for _ in range(30):
        unit = [f"v{rnd.randrange(6)}" for _ in range(rnd.randint(1, 20))]
        body = unit * rnd.randint(3, 7) + unit[: rnd.randrange(len(unit))]
        out.append(" ".join([f"u{rnd.randrange(50)}" for _ in range(rnd.randrange(20))] + body * rnd.choice([1, 1, 4]) + ["end"] * rnd.randrange(9)))
    out.append(" ".join(["the cat sat on"] * 2000))
    return out


def test_runs_of_all_texts_at_once():
    texts = [t for t in some_texts() if t is not None]
    words = [WORD.findall(t) for t in texts]
    codes = {}
    numbers = np.array([codes.setdefault(w, len(codes)) for ws in words for w in ws], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    got = {}
    for t, *run in zip(*(c.tolist() for c in periodic_runs.runs_in(numbers, first))):
        got.setdefault(t, []).append(tuple(run))
    for k, ws in enumerate(words):
        assert got.get(k, []) == (brute(ws) if len(ws) < 3000 else [(0, 8000, 4)]), texts[k][:80]


def test_small_blocks_and_wrong_hashes(monkeypatch):
    rnd = random.Random(8)
    words = [[rnd.randrange(2) for _ in range(150)], [1, 2] * 40 + [3] * 30]
    first, numbers = np.array([0, 150, 260]), np.array(words[0] + words[1], np.int64)
    want = [(k, *r) for k, ws in enumerate(words) for r in brute(ws)]
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    assert list(zip(*(c.tolist() for c in periodic_runs.runs_in(numbers, first)))) == want
    monkeypatch.setattr(periodic_runs.PrefixHashes, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    assert list(zip(*(c.tolist() for c in periodic_runs.runs_in(numbers, first)))) == want


def test_a_long_text_has_few_pairs():
    numbers = np.zeros(300_000, np.int64)
    numbers[-1] = 1
    got = periodic_runs.runs_in(numbers, np.array([0, 300_000]))
    assert [c.tolist() for c in got] == [[0], [0], [299_999], [1]]


@pytest.mark.parametrize("extra", [False, True])
def test_documents(spark, extra):
    texts = some_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts * 3)] + [(5, "b c " * 30, "x"), (5, "b c " * 30, "x"), (None, "k " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string" if extra else "doc_id long, text string, source string")
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(docs))).collect()
    want = []
    for key, text, _ in rows:
        words = tailed(key, text)
        runs = brute(words) if len(words) < 3000 or words[:3] != ["the", "cat", "sat"] else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((key, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(), len(words)))
    have = [tuple(r) for r in got if r.n_words != 8000]
    assert sorted(have, key=repr) == sorted(want, key=repr) and len(got) == len(rows)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(empty))).count() == 0
