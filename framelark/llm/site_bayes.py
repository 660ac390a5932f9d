"""Quality classifier with hierarchical empirical Bayes over sites and paths.

A document's evidence has two parts. Its statistics put it into a bucket of a
learned decision list (`quality_rules.learn`), and the share of low quality in the
bucket is its chance of low quality. Its words give, by naive Bayes over their presence,
its chance of being toxic: every word of the labelled sample has a log ratio of its
shares among toxic and other documents, shrunk by its counts. The shrinkage is
empirical Bayes with a spike and a slab: most words say nothing (the share of those that do is fitted to the counts), so
a word met once or twice weighs next to nothing and one met often keeps its ratio.
A good document is neither; the evidence is the log odds of
that, less the log odds of a good document at large.

A site (`source`) and a path in it (`source`, `lang`) have rates of good
documents. The rates of all sites come from a Beta prior fitted by moments to
the grouped sums; a path's rate is shrunk to its site's rate, the site's to the
global one, so a site with few documents says little and a large one speaks for
itself. The path's posterior replaces the global prior in the odds of each of
its documents.

Scale: fitting sees at most SAMPLE labelled documents (chosen by hash of id), which
bounds the table of words too. Texts are read once: the evidence of each document is
written beside the columns that the caller carries on, and sums of sites and paths read three columns of that.
Site and path sums cover all documents and are
grouped with map-side partial sums, so one site holding most rows is no burden.
The path table is broadcast only if it is counted small.

Edge cases: a text without words (null, empty) is rejected. Null source or lang
is a value of its own. Without labels of both classes everything with words is
kept. Labels that are null or of unknown documents are ignored. Repeated
documents are judged each for itself. An empty table gives an empty result. Other columns pass
through under their own names, whatever they are: helper columns take names that are free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches, fresh, small, stash
from framelark.llm.near_dedup import shingle_array, signature
from framelark.llm.quality_rules import FEATURES, Test, cover_of, labelled_sample, learn
from framelark.llm.textscan import ALNUM, LOWER, Index, Words, slices
from framelark.llm.textstats import FIELDS, stats_of, text_stats

SAMPLE = 20_000
NEAR = 75  # per cent of similarity from which labelled documents are near copies
FOLDS = 3
SPREAD = 3.0  # standard deviation of the log ratios of words that speak for or against toxicity


@dataclass
class Evidence:
    """What documents are judged by; small, and sent to the executors with the function."""

    rules: list[list[Test]]
    low: np.ndarray  # chance of low quality by first rule that fires; last: none does
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # shrunk log ratio of toxic over other documents for the presence of each
    toxic_prior: float  # log odds of a toxic document without any of them
    prior: float  # share of good documents among the labelled

    def of(self, buf: np.ndarray, offs: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """Words and log-likelihood ratio (good over bad) of each text; `index` is that of the words."""
        stats = dict(zip(FIELDS, stats_of(buf, offs), strict=True))
        low = self.low[first_rule(self.rules, ratios(stats))]
        toxic = np.full(len(low), self.toxic_prior)
        if len(self.words):
            w = Words(LOWER[buf], offs, ALNUM)
            h = w.hashes()
            at = index.find(h)
            hit = np.flatnonzero(at >= 0)
            pairs = np.unique(w.doc[hit] * len(self.words) + at[hit])
            toxic += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], len(low))
        good = np.clip((1 - low) / (1 + np.exp(np.clip(toxic, -500, 500))), 1e-12, 1 - 1e-12)
        return stats["n_words"], np.log(good / (1 - good)) - math.log(self.prior / (1 - self.prior))


def ratios(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: stats[a] / np.maximum(stats[b], 1) if b else stats[a].astype(float) for f, (a, b) in FEATURES.items()}


def first_rule(rules: list[list[Test]], x: dict[str, np.ndarray]) -> np.ndarray:
    """Index of the first rule that fires, len(rules) if none does."""
    out = np.full(len(next(iter(x.values()))), len(rules))
    for k in range(len(rules) - 1, -1, -1):
        out[cover_of(rules[k], x)] = k
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def distinct_words(texts: pa.Array) -> pa.Array:
    """Hashes of the distinct lower-cased words of each text."""
    sizes, values = [0], []
    for _, _, buf, offs in slices(texts):
        w = Words(LOWER[buf], offs, ALNUM)
        h = w.hashes()
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            values.append(np.unique(h[a:b]))
            sizes.append(len(values[-1]))
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Evidence | None:
    rows = stash(labelled_sample(docs, labels, key, text, sample).withColumn("_toxic", F.coalesce("_toxic", F.lit(0))))
    got = rows.select("_quality", "_toxic", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(3)).alias("_part"), key, text_stats(F.col(text)).alias("s"))
    got = got.select("_quality", "_toxic", "_part", key, "s.*").toPandas().sort_values([key, "n_words"])  # at most `sample` rows of numbers
    if got.empty:
        return None
    low, toxic = got["_quality"].to_numpy() == 0, got["_toxic"].to_numpy() == 1
    good = float((~low & ~toxic).mean())
    if not 0 < good < 1:
        return None
    x = ratios({f: got[f].to_numpy() for f in FIELDS})
    rules = learn(x, low, got["_part"].to_numpy())
    bucket = first_rule(rules, x)
    n, k = np.bincount(bucket, minlength=len(rules) + 1), np.bincount(bucket, low, len(rules) + 1)
    words, weights, base = toxic_words(rows, text)
    return Evidence(rules, (k + 0.5 * low.mean()) / (n + 0.5), words, weights, base, good)


def word_weights(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int, words: np.ndarray | None = None) -> np.ndarray:
    """Expected log ratio of the shares of toxic and other documents that hold a word, given that t and c of them do.

    `words`: how many words have each of the counts (default: one).

    Most words say nothing; the log ratios of the others are spread normally. Their share is what makes the counts of all words likeliest.
    """
    pairs, back = np.unique(np.stack([t, c]), axis=1, return_inverse=True)
    times = np.bincount(back.ravel(), words)
    t, c = pairs
    theta = np.linspace(-5, 5, 201) * SPREAD
    mass = np.exp(-((theta / SPREAD) ** 2) / 2)
    mass /= mass.sum()
    least = np.log(n_toxic / n_clean) + theta
    # a word's documents are toxic with a chance whose log odds are those of the sample plus theta
    log_p, log_q = -np.logaddexp(0, -least), -np.logaddexp(0, least)
    base = t * -np.log1p(n_clean / n_toxic) + c * -np.log1p(n_toxic / n_clean)
    factor, mean = np.zeros(len(t)), np.zeros(len(t))
    for k in range(len(theta)):
        f = mass[k] * np.exp(np.minimum(t * log_p[k] + c * log_q[k] - base, 600.0))
        factor += f
        mean += f * theta[k]
    share = 0.01  # where the search for the likeliest share begins
    for _ in range(5000):
        before, share = share, float(np.average(share * factor / (1 - share + share * factor), weights=times))
        if abs(share - before) < 1e-5 * share:
            break
    return (share * mean / (1 - share + share * factor))[back.ravel()]


def without_near_copies(rows: DataFrame, text: str) -> DataFrame:
    """`_toxic` and the distinct words `ws` of the labelled rows, without near copies of an earlier row with the same label.

    Near copies would make their words look frequent. Rows that share a bucket of their MinHash signatures are compared
    with the first one in it, on full sets of 5-word shingles; copies have a similarity of 0.75 or more. All other rows count in full.
    """
    signed = stash(
        rows.select(F.monotonically_increasing_id().alias("row"), "_toxic", F.col(text).alias("text")).select(
            "row", "_toxic", distinct_words(F.col("text")).alias("ws"), signature(F.col("text")).alias("s"), shingle_array(F.col("text")).alias("shingles")
        )
    )
    spread = signed.select("row", "_toxic", F.explode("s.buckets").alias("bucket"))
    first = spread.groupBy("bucket", "_toxic").agg(F.min("row").alias("first"))
    pairs = spread.join(first, ["bucket", "_toxic"]).where("row <> first").select("row", "first").distinct()
    sets = signed.select("row", "shingles")
    both = pairs.join(sets, "row").join(sets.select(F.col("row").alias("first"), F.col("shingles").alias("others")), "first")
    common = F.size(F.array_intersect("shingles", "others"))
    copies = both.where(100 * common >= NEAR * (F.size("shingles") + F.size("others") - common)).select("row").distinct()
    return signed.where(F.size("ws") > 0).join(copies, "row", "left_anti").select("_toxic", "ws")


def word_sums(words: np.ndarray, weights: list[np.ndarray]):
    """UDF: sum of the weights of a document's distinct words, those of its fold."""

    index: list[Index] = []
    table = np.stack(weights)

    @F.arrow_udf(T.DoubleType())
    def total(ws: pa.Array, fold: pa.Array) -> pa.Array:
        if not index:
            index.append(Index(words, 2))  # once for a task
        size = np.asarray(ws.value_lengths())
        at = index[0].find(ws.flatten().to_numpy().view(np.uint64))
        own = np.repeat(np.arange(len(ws)), size)
        f = np.asarray(fold)[own]
        values = np.where(at >= 0, table[f, at], 0.0)
        return pa.array(np.bincount(own, values, len(ws)))

    return total


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the log odds of y given x, by Newton's method with a weak prior on both."""
    design, beta = np.stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        step = np.linalg.solve((design * (p * (1 - p))) @ design.T + 1e-3 * np.eye(2), design @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxic_words(rows: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The words of the labelled sample, sorted by hash, their weights, and the log odds without any of them; near copies count once.

    Words of a document don't come by chance alone, so sums of their weights say too much. What they say is
    measured on documents of which the weights know nothing: each of FOLDS parts is scored with the weights of the others.
    """
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    each = stash(without_near_copies(rows, text).withColumn("fold", F.pmod(F.xxhash64("ws"), F.lit(FOLDS)).cast("int")))
    n = {(r._toxic, r.fold): r["count"] for r in each.groupBy("_toxic", "fold").count().collect()}  # 2 x FOLDS rows
    of = {k: np.array([n.get((k, f), 0) for f in range(FOLDS)]) for k in (0, 1)}
    if not of[0].sum() or not of[1].sum():
        return *nothing, math.log((of[1].sum() + 0.5) / (of[0].sum() + 0.5))
    names = [f"n{k}{f}" for k in (0, 1) for f in range(FOLDS)]
    per_fold = [F.count_if((F.col("_toxic") == k) & (F.col("fold") == f)).alias(f"n{k}{f}") for k in (0, 1) for f in range(FOLDS)]
    counted = stash(each.select("_toxic", "fold", F.explode("ws").alias("w")).groupBy("w").agg(*per_fold))
    kinds = counted.groupBy(*names).agg(F.count("*").alias("words")).toPandas()  # most words have one of a few counts
    counts, times = {k: kinds[[f"n{k}{f}" for f in range(FOLDS)]].to_numpy(float) for k in (0, 1)}, kinds["words"].to_numpy(float)

    def weights_without(f: int | None) -> np.ndarray:
        kept = np.arange(FOLDS) != f
        t, c = (counts[k][:, kept].sum(axis=1) for k in (1, 0))
        return word_weights(t, c, max(int(of[1][kept].sum()), 1), max(int(of[0][kept].sum()), 1), times)

    for f in range(FOLDS):
        kinds[f"x{f}"] = weights_without(f)
    kinds["x"] = weights_without(None)
    values = ["x", *(f"x{f}" for f in range(FOLDS))]
    table = counted.join(small(rows.sparkSession.createDataFrame(kinds[names + values])), names)
    # numbers of the words of at most `sample` documents: 8 bytes for a word, 4 for a weight
    got = table.select("w", *(F.col(c).cast("float").alias(c) for c in values)).toArrow()
    words = got["w"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, (final, *others) = words[order], [got[c].to_numpy()[order] for c in values]
    del got
    held = each.select("_toxic", word_sums(words, others)(F.col("ws"), F.col("fold")).alias("x")).toPandas()
    base, slope = logistic(held["x"].to_numpy(float), held["_toxic"].to_numpy(float))
    return words, final * np.float32(max(slope, 0.0)), base


SCORE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("llr", T.DoubleType())])


def evidence_of(text: Column, model: Evidence | None) -> Column:
    index: list[Index] = []

    @F.arrow_udf(SCORE)
    def score(texts: pa.Array) -> pa.Array:
        if model is not None and not index:
            index.append(Index(model.words, 2))  # once for a task
        n, llr = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, _, buf, offs in slices(texts):
            if model is None:
                n.append(Words(buf, offs, ALNUM).counts)
                llr.append(np.zeros(len(offs) - 1))
            else:
                a, b = model.of(buf, offs, index[0])
                n.append(a)
                llr.append(b)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(llr))], names=["n_words", "llr"])

    return score(text)


def site_posteriors(scored: DataFrame, prior: float) -> DataFrame:
    """Shrunk rate of good documents for each (site, path) of a table with columns site, path, llr."""
    odds = math.log(prior / (1 - prior))
    p = 1 / (1 + F.exp(-(F.col("llr") + F.lit(odds))))
    paths = scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"))
    got = sites.agg(
        F.count("*").alias("k"),
        F.sum("site_n").alias("n"),
        F.sum("site_s").alias("s"),
        F.sum(F.col("site_s") * F.col("site_s") / F.col("site_n")).alias("ss"),
    ).first()  # one row
    if not got.n:
        return paths.select("site", "path", F.lit(prior).alias("rate"), F.lit(prior).alias("site_rate"))
    mean = min(max(got.s / got.n, 1e-3), 1 - 1e-3)
    # moments: spread of site rates around the mean beyond what their own sampling gives
    between = max(got.ss / got.n - mean * mean, 0.0)
    noise = mean * (1 - mean) * got.k / got.n
    spread = between - noise
    strength = min(max(mean * (1 - mean) / spread - 1, 5.0), 1e4) if spread > 1e-9 else 1e4
    site_rate = (F.col("site_s") + F.lit(strength * mean)) / (F.col("site_n") + F.lit(strength))
    rate = (F.col("s") + F.lit(strength) * F.col("site_rate")) / (F.col("n") + F.lit(strength))
    sites = sites.select(F.col("site").alias("_site"), site_rate.alias("site_rate"))
    return paths.join(small(sites), F.col("site").eqNullSafe(F.col("_site"))).select("site", "path", rate.alias("rate"), "site_rate")


def judged(
    docs: DataFrame,
    labels: DataFrame,
    into: str,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    path: str = "lang",
    model: Evidence | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns `carry` of `docs` (default: all) and a struct `into` with n_words, llr, site_rate, path_rate, p_good and kept."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, key, text) if model is None else model
    prior = min(max(model.prior, 1e-3), 1 - 1e-3) if model else 0.5
    carry = docs.columns if carry is None else carry
    own = F.struct(*(F.col(c) for c in carry)).alias("own")  # a caller's column can have any name
    scored = stash(docs.select(F.col(site).alias("site"), F.col(path).alias("path"), evidence_of(F.col(text), model).alias("e"), own))
    rates = site_posteriors(scored.select("site", "path", F.col("e.llr").alias("llr")), prior)
    rates = small(rates.select(F.col("site").alias("s"), F.col("path").alias("p"), "site_rate", "rate"))
    p_good = 1 / (1 + F.exp(-(F.col("e.llr") + F.log(F.col("rate") / (1 - F.col("rate"))))))
    found = scored.join(rates, F.col("site").eqNullSafe(F.col("s")) & F.col("path").eqNullSafe(F.col("p")))
    kept = (F.col("e.n_words") > 0) & (p_good >= 0.5)
    verdict = F.struct(F.col("e.n_words").alias("n_words"), F.col("e.llr").alias("llr"), "site_rate", F.col("rate").alias("path_rate"), p_good.alias("p_good"), kept.alias("kept"))
    return found.select("own.*", verdict.alias(into))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", site: str = "source", path: str = "lang", **kw) -> DataFrame:
    """Per document: its id, site and path, with n_words, llr, site_rate, path_rate, p_good and kept."""
    return judged(docs, labels, "_verdict", key=key, site=site, path=path, carry=[key, site, path], **kw).select(key, site, path, "_verdict.*")


def without_bad(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """`docs` without the rejected documents."""
    into = fresh(docs, "_verdict")
    return judged(docs, labels, into, **kw).where(F.col(into)["kept"]).select(*docs.columns)
