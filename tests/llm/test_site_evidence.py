"""The parts of the site classifier against plain computations."""

import math
import random

import numpy as np
import pytest

from framelark.llm import site_bayes


def test_word_weights_are_posterior_means():
    """A fine grid of log ratios instead of the quadrature, the share of telling words by direct search."""
    rnd = np.random.default_rng(3)
    n_toxic, n_clean = 200, 900
    t, c = rnd.binomial(n_toxic, 0.02, 400).astype(float), rnd.binomial(n_clean, 0.02, 400).astype(float)
    t[:20], c[:20] = rnd.binomial(n_toxic, 0.2, 20), 1
    got = site_bayes.word_weights(t, c, n_toxic, n_clean)
    theta = np.linspace(-18, 18, 4001)
    density = np.exp(-(theta**2) / (2 * site_bayes.SPREAD**2))
    density /= density.sum()
    factor, mean = [], []
    for a, b in zip(t, c):
        x = np.log(n_toxic / n_clean) + theta
        ratio = np.exp(a * -np.logaddexp(0, -x) + b * -np.logaddexp(0, x) - a * math.log(n_toxic / (n_toxic + n_clean)) - b * math.log(n_clean / (n_toxic + n_clean)))
        factor.append((density * ratio).sum())
        mean.append((density * ratio * theta).sum())
    factor, mean = np.array(factor), np.array(mean)
    shares = np.geomspace(1e-4, 0.9, 20000)
    share = max(shares, key=lambda s: np.log(1 - s + s * factor).sum())
    want = share * mean / (1 - share + share * factor)
    assert np.abs(got - want).max() < 0.05 and got[:20].min() > 1.5 and np.median(np.abs(got[20:])) < 0.1


def test_logistic_meets_the_sums():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=3000)
    y = (rnd.random(3000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = site_bayes.logistic(x, y)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((p - y).sum()) < 0.1 and abs(((p - y) * x).sum()) < 0.1 and abs(a + 1) < 0.2 and abs(b - 2) < 0.25


def test_near_copies_count_once(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    near = base[:70] + ["changed"] + base[71:]
    other = [f"w{rnd.randrange(400)}" for _ in range(150)]
    # all share the most frequent words, the first least word among them
    rows = [(0, base), (0, base), (0, near), (0, other), (1, base), (1, near), (0, []), (0, ["w1"]), (1, ["w1"])]
    table = spark.createDataFrame([(a, " ".join(b)) for a, b in rows] + [(0, None)], "_toxic int, text string").coalesce(1)
    got = sorted((r._toxic, len(r.ws)) for r in site_bayes.without_near_copies(table, "text").collect())
    assert got == sorted([(0, len(set(base))), (0, len(set(other))), (1, len(set(base))), (0, 1), (1, 1)])


def test_posteriors_of_sites_and_paths(spark):
    rnd = random.Random(2)
    rows = [(s, p, rnd.gauss(1 if s == "a" else -1, 1)) for s in ("a", "b", None) for p in ("x", None) for _ in range(rnd.randint(1, 60))] + [("tiny", "x", -9.0)]
    prior = 0.7
    got = {(r.site, r.path): (r.site_rate, r.rate) for r in site_bayes.site_posteriors(spark.createDataFrame(rows, "site string, path string, llr double"), prior).collect()}
    chance = {k: [1 / (1 + math.exp(-(x + math.log(prior / (1 - prior))))) for s, p, x in rows if (s, p) == k] for k in {(s, p) for s, p, _ in rows}}
    sites = {}
    for (s, _), ps in chance.items():
        sites.setdefault(s, []).extend(ps)
    n = len(rows)
    mean = sum(map(sum, sites.values())) / n
    between = sum(sum(ps) ** 2 / len(ps) for ps in sites.values()) / n - mean**2
    spread = between - mean * (1 - mean) * len(sites) / n
    strength = min(max(mean * (1 - mean) / spread - 1, 5), 1e4) if spread > 1e-9 else 1e4
    for (s, p), ps in chance.items():
        site = (sum(sites[s]) + strength * mean) / (len(sites[s]) + strength)
        assert got[s, p] == pytest.approx((site, (sum(ps) + strength * site) / (len(ps) + strength)))
