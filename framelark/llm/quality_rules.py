"""Quality rules: learned decision lists over document statistics.

Sequential covering: rules are conjunctions of threshold tests on ratios of the
statistics in `textstats`. A rule grows test by test by information gain on two
thirds of the labelled rows, is pruned from its end on the last third, and is
kept if it is right more often than wrong there; the rows it covers are then
taken out and the next rule grows. The list comes out as one ordered Spark
conditional expression (CASE WHEN rule 1 THEN reject ... ELSE keep), so applying
it needs no Python.

The labelled sample is the one bounded input: at most SAMPLE labelled documents,
chosen by hash of their id. Everything else reads all rows.

Edge cases: null and empty texts have zero statistics and fail the base rules
(fewer than 10 words). Without labels, or with labels of one class only, the
list is empty and base rules alone decide. Labels that are null, or of unknown
documents, are ignored; a document labelled twice counts with its lowest label.
Repeated documents are judged each for itself. Ratios have a denominator of at
least 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import bounded_batches
from framelark.llm.textstats import text_stats

SAMPLE = 20_000
MAX_RULES = 12
MAX_TESTS = 4
CUTS = 24  # candidate thresholds for each feature

#: feature -> (numerator, denominator) among the statistics
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "words": ("n_words", None),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    value = F.col(top).cast("double")
    return value / F.greatest(F.col(bottom), F.lit(1)) if bottom else value


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] < self.cut

    def column(self) -> Column:
        return feature(self.feature) >= F.lit(self.cut) if self.above else feature(self.feature) < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


def cover_of(rule: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        out &= t.mask(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_TESTS and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            steps = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(steps):
                continue
            if len(steps) > CUTS:
                edges = np.flatnonzero(y[1:] != y[:-1]) + 1
                steps = np.unique(np.concatenate([steps[np.linspace(0, len(steps) - 1, CUTS).astype(int)], np.intersect1d(steps, edges)[:: max(1, len(edges) // CUTS)]]))
            below = np.concatenate([[0], np.cumsum(y)])[steps]
            for above in (True, False):
                p = p0 - below if above else below
                n = (len(v) - steps if above else steps) - p
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Test(name, above, float((v[steps[k] - 1] + v[steps[k]]) / 2)), gain[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return rule


def _prune(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Test], float]:
    best, best_worth = rule, -1.0
    for n in range(len(rule), 0, -1):
        c = cover_of(rule[:n], x)
        p, q = int((c & bad).sum()), int((c & ~bad).sum())
        worth = (p - q) / (p + q) if p + q else -1.0
        if worth >= best_worth:
            best, best_worth = rule[:n], worth
    return best, best_worth


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[list[Test]]:
    """Rules for the rejected class. part: 0..2 for each row; rows of part 2 prune."""
    rules: list[list[Test]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, h = left & (part != 2), left & (part == 2)
        if not bad[g].any() or bad[g].all():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break
        if bad[h].any():
            rule, worth = _prune(rule, {k: v[h] for k, v in x.items()}, bad[h])
            if worth <= 0:
                break
        c = cover_of(rule, x) & left
        if (c & bad).sum() <= (c & ~bad).sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def as_case(rules: list[list[Test]]) -> Column:
    """True where no rule fires."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """At most `sample` labelled documents with text: the bounded set on which models are fitted."""
    picked = (
        labels.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
        .where("_quality is not null")
        .orderBy(F.xxhash64(key), key)
        .limit(sample)
    )
    return docs.select(key, text).join(F.broadcast(picked), key)  # bounded by `sample`


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[list[Test]]:
    rows = labelled_sample(docs, labels, key, text, sample).select(key, "_quality", text_stats(F.col(text)).alias("s"))
    got = rows.select("_quality", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(3)).alias("_part"), key, "s.*")
    got = got.select("_quality", "_part", *(feature(f).alias(f) for f in FEATURES)).orderBy(F.xxhash64(key), key).toPandas()
    if got.empty:
        return []
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["_quality"].to_numpy() == 0, got["_part"].to_numpy())


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rules: list[list[Test]] | None = None) -> DataFrame:
    """Per document: its statistics, the base verdict and the verdict of the learned list."""
    bounded_batches(docs.sparkSession)
    rules = learn_rules(docs, labels, key, text) if rules is None else rules
    rows = docs.select(F.col(key), text_stats(F.col(text)).alias("s")).select(key, "s.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & as_case(rules))
