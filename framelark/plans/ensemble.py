"""Queries of clause models, normalisation, fusion and ensemble calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.operators import ensemble as E
from framelark.operators import features as X
from framelark.operators import metrics as M
from framelark.operators import selection as S
from framelark.operators.quantiles import quantile_columns
from framelark.operators.sized import small
from framelark.plans.registry import query
from framelark.sources.adapters import features, scores, table, with_ctes

#: a fixed generated model: 60 clauses of 3 literals, weights -3..3 without 0 for 10 outputs
CLAUSES = """cl AS (SELECT DISTINCT c AS clause, ((c * 7 + j * 13) % 64 + CASE WHEN (c + j) % 3 = 0 THEN 64 ELSE 0 END)::INT AS literal FROM (SELECT unnest(range(0, 60))::INT AS c), (SELECT unnest([0, 1, 2])::INT AS j)),
wt AS (SELECT c AS clause, o AS output, CASE WHEN (c * 5 + o * 3) % 7 = 3 THEN 1 ELSE (c * 5 + o * 3) % 7 - 3 END AS weight FROM (SELECT unnest(range(0, 60))::INT AS c), (SELECT unnest(range(0, 10))::INT AS o)),
bits AS (SELECT frame, (d + CASE WHEN v >= 0 THEN 0 ELSE 64 END)::INT AS literal FROM longx),
fi AS (SELECT frame, clause FROM bits JOIN cl USING (literal) GROUP BY frame, clause HAVING count(*) = (SELECT count(*) FROM cl c2 WHERE c2.clause = cl.clause)),
cs AS (SELECT frame, output, coalesce(sum(weight), 0)::BIGINT AS score FROM (SELECT vec_id AS frame, unnest(range(0, 10))::INT AS output FROM embeddings) g LEFT JOIN (SELECT frame, output, weight FROM fi JOIN wt USING (clause)) s USING (frame, output) GROUP BY 1, 2)"""


def _model(spark):
    c = spark.range(60).select(F.col("id").cast("int").alias("c"))
    literal = F.pmod(F.col("c") * 7 + F.col("j") * 13, F.lit(64)) + F.when((F.col("c") + F.col("j")) % 3 == 0, 64).otherwise(0)
    clauses = c.select("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j")).select(F.col("c").alias("clause"), literal.cast("int").alias("literal")).distinct()
    m = F.pmod(F.col("c") * 5 + F.col("output") * 3, F.lit(7))
    weights = c.select("c", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("output")).select(F.col("c").alias("clause"), "output", F.when(m == 3, 1).otherwise(m - 3).alias("weight"))
    return clauses, weights


def _fired(spark, d):
    long = X.to_long(features(spark, d)).select("frame", (F.col("d") + F.when(F.col("v") >= 0, 0).otherwise(64)).alias("literal"))
    return E.firing(long, _model(spark)[0])


@query("o114_clause_inference", with_ctes("longx", body="," + CLAUSES + " SELECT frame, clause FROM fi"))
def o114(spark, d):
    return _fired(spark, d)


@query("o115_class_sums", with_ctes("longx", body="," + CLAUSES + " SELECT frame, output, score FROM cs"))
def o115(spark, d):
    return E.class_sums(_fired(spark, d), _model(spark)[1], features(spark, d).select("frame"), 10)


@query("o116_threshold_predict", with_ctes("longx", body="," + CLAUSES + " SELECT output, count(*) FILTER (WHERE score >= 2) AS predicted, count(*) AS frames FROM cs GROUP BY output"))
def o116(spark, d):
    return o115(spark, d).groupBy("output").agg(F.count_if(F.col("score") >= 2).alias("predicted"), F.count("*").alias("frames"))


@query(
    "o131_sparse_extraction",
    with_ctes("longx", body="SELECT frame AS clause, d AS feature, false AS negated FROM longx WHERE v >= 0.2 UNION ALL SELECT frame, d, true FROM longx WHERE v <= -0.2"),
)
def o131(spark, d):
    """The literals of clauses that are kept as bit masks: a clause for each vector, its strong components included."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("clause"), E.mask_of(x, lambda v: v >= 0.2).alias("own"), E.mask_of(x, lambda v: v <= -0.2).alias("negated"))
    return E.sparse_literals(rows, 64)


SCALE = """md AS (SELECT member, median(score) AS m, quantile_cont(score, [0.25, 0.75]) AS q, median(abs(score)) AS a FROM sc GROUP BY 1),
sl AS (SELECT md.member, CASE WHEN mad >= 1 THEN mad WHEN (q[2] - q[1]) / 1.349 >= 1 THEN (q[2] - q[1]) / 1.349 WHEN a >= 1 THEN a ELSE 1 END AS scale
  FROM md JOIN (SELECT sc.member, 1.4826 * median(abs(score - m)) AS mad FROM sc JOIN md USING (member) GROUP BY 1) USING (member)),
nz AS (SELECT member, frame, pitch, truth, ((score::FLOAT - 20::FLOAT)::FLOAT / round(scale, 4)::FLOAT)::FLOAT AS z FROM sc JOIN sl USING (member))"""


@query("o091_robust_scale", with_ctes("sc", body="," + SCALE + " SELECT member, round(scale, 6) AS scale FROM sl"))
def o091(spark, d):
    return E.robust_scale(scores(spark, d), "member").withColumn("scale", F.round("scale", 6))


@query("o092_tail_scale", with_ctes("sc", body=" SELECT member, round(greatest(quantile_cont(abs(score), 0.95), 1), 6) AS scale FROM sc GROUP BY 1"))
def o092(spark, d):
    return E.tail_scale(scores(spark, d), "member").withColumn("scale", F.round("scale", 6))


@query(
    "o093_ensemble_diversity",
    with_ctes("sc", body=" SELECT a.member AS m, b.member AS n, round(corr(a.score, b.score), 6) AS correlation, round(avg(((a.score >= 0) <> (b.score >= 0))::INT), 6) AS sign_difference FROM sc a JOIN sc b USING (frame, pitch) WHERE a.member < b.member GROUP BY 1, 2"),
)
def o093(spark, d):
    return E.diversity(scores(spark, d)).select("m", "n", F.round("correlation", 6).alias("correlation"), F.round("sign_difference", 6).alias("sign_difference"))


@query("o122_member_configs", "SELECT label AS head, i AS member, round(3.9 * (1 + 0.25 * (i % 3 - 1)), 6) AS s, round(frames / 7.5 * (1 - 0.2 * (i % 3 - 1)), 6) AS q, (42 + label + 9973 * i)::BIGINT AS seed FROM (SELECT label, count(*) AS frames FROM embeddings GROUP BY 1), (SELECT unnest(range(0, 10))::INT AS i)")
def o122(spark, d):
    """Ten members for each head; q goes by the number of the head's frames."""
    heads = table(spark, d, "embeddings").groupBy(F.col("label").alias("head")).agg(F.count("*").alias("frames"))
    return E.member_configs(heads.select("head", F.lit(3.9).alias("s"), (F.col("frames") / 7.5).alias("q"), (F.col("head") + 42).cast("long").alias("seed")), 10, "head")


def _z(spark, d):
    s = scores(spark, d)
    return s.join(small(E.robust_scale(s, "member")), "member").withColumn("z", E.normalised(F.col("score"), F.lit(20), F.round("scale", 4)))  # a row for each member


@query("o123_clipped_normalisation", with_ctes("sc", body="," + SCALE + " SELECT member, round(avg(greatest(least((score - 20) / scale, 4.0), -4.0)), 6) AS mean, count(*) FILTER (WHERE abs((score - 20) / scale) >= 4) AS clipped FROM sc JOIN sl USING (member) GROUP BY 1"))
def o123(spark, d):
    s = scores(spark, d)
    z = s.join(small(E.robust_scale(s, "member")), "member").withColumn("c", E.clipped(F.col("score"), F.lit(20), F.col("scale")))
    return z.groupBy("member").agg(F.round(F.avg("c"), 6).alias("mean"), F.count_if(F.abs("c") >= 4).alias("clipped"))


@query("o124_float_normalisation", with_ctes("sc", body="," + SCALE + " SELECT member, frame, pitch, round(z::DOUBLE, 5) AS z FROM nz"))
def o124(spark, d):
    return _z(spark, d).select("member", "frame", "pitch", F.round(F.col("z").cast("double"), 5).alias("z"))


FUSE = {
    "mean": "list_reduce(list(z ORDER BY member), lambda a, b: (a + b)::FLOAT) / 6::FLOAT",
    "max": "max(z)",
    "top2_mean": "list_reduce(list(z ORDER BY z DESC)[1:2], lambda a, b: (a + b)::FLOAT) / 2::FLOAT",
}
for _rule, _sql in FUSE.items():

    @query(f"o125_fusion_{_rule}", with_ctes("sc", body="," + SCALE + f" SELECT frame, pitch, round((({_sql})::FLOAT)::DOUBLE, 5) AS fused FROM nz GROUP BY 1, 2"))
    def _fusion(spark, d, rule=_rule):
        return E.fuse(_z(spark, d), rule).select("frame", "pitch", F.round(F.col("fused").cast("double"), 5).alias("fused"))


QUANT = "least(greatest(round_even(({})::FLOAT::DOUBLE * 1024, 0), -2147483648), 2147483646)::INT"


@query("o126_quantise", with_ctes("sc", body="," + SCALE + f" SELECT frame, pitch, {QUANT.format(FUSE['max'])} AS score FROM nz GROUP BY 1, 2"))
def o126(spark, d):
    return E.fuse(_z(spark, d), "max").select("frame", "pitch", E.quantise(F.col("fused")).alias("score"))


RULES = " UNION ALL ".join(f"SELECT '{r}' AS member, frame, pitch, max(truth) AS truth, {QUANT.format(q)} AS score FROM nz GROUP BY 2, 3" for r, q in FUSE.items())
FIT = """, rl AS ({rules}), cu AS (SELECT member, score, sum(n) OVER w AS predicted, sum(t) OVER w AS tp, sum(t) OVER (PARTITION BY member) AS target
  FROM (SELECT member, score, count(*) AS n, sum(truth) AS t FROM rl GROUP BY 1, 2) WINDOW w AS (PARTITION BY member ORDER BY score DESC)),
fc AS (SELECT *, 2.0::DOUBLE * tp / greatest(predicted + target, 1) AS f1 FROM cu WHERE predicted <= 1.5 * target)"""


def _rules(spark, d):
    z = _z(spark, d)
    truth = z.groupBy("frame", "pitch").agg(F.max("truth").alias("truth"))
    rules = None
    for rule in FUSE:
        one = E.fuse(z, rule).select(F.lit(rule).alias("member"), "frame", "pitch", E.quantise(F.col("fused")).alias("score"))
        rules = one if rules is None else rules.unionByName(one)
    return rules.join(truth, ["frame", "pitch"])


@query("o127_rule_calibration", with_ctes("sc", body="," + SCALE + FIT.format(rules=RULES) + " SELECT member, score AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY f1 DESC, score DESC) AS k FROM fc) WHERE k = 1"))
def o127_rules(spark, d):
    return S.calibrate(_rules(spark, d), 1.5, "member").select("member", "threshold", "f1")


def _per_head(rule: str, head: str, members: str, n: int) -> str:
    sql = FUSE[rule].replace("/ 6::FLOAT", f"/ {n}::FLOAT")
    return f"SELECT '{head}' AS head, '{rule}' AS rule, frame, pitch, max(truth) AS truth, {QUANT.format(sql)} AS score FROM nz WHERE {members} GROUP BY 3, 4"


HEADS = """, hd AS ({rows}),
hc AS (SELECT head, rule, score, sum(n) OVER w AS predicted, sum(t) OVER w AS tp, sum(t) OVER (PARTITION BY head, rule) AS target
  FROM (SELECT head, rule, score, count(*) AS n, sum(truth) AS t FROM hd GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY head, rule ORDER BY score DESC)),
hf AS (SELECT *, 2.0::DOUBLE * tp / greatest(predicted + target, 1) AS f1 FROM hc WHERE predicted <= CASE head WHEN 'activity' THEN 1.5 ELSE 4.0 END * target),
ft AS (SELECT head, rule, score AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY round(f1, 6) DESC, CASE rule WHEN 'mean' THEN 0 WHEN 'top2_mean' THEN 1 ELSE 2 END) AS k FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head, rule ORDER BY f1 DESC, score DESC) AS b FROM hf) WHERE b = 1)) WHERE k = 1)""".format(
    rows=" UNION ALL ".join([_per_head("mean", "activity", "member < 3", 3), *(_per_head(r, "onset", "member >= 3", 3) for r in E.RULES["onset"])])
)


def _heads(spark, d):
    return scores(spark, d).select("member", F.when(F.col("member") < 3, "activity").otherwise("onset").alias("head")).distinct()


@query("o127_fit_ensemble", with_ctes("sc", body="," + SCALE + HEADS + " SELECT head, rule, threshold, f1 FROM ft"))
def o127(spark, d):
    return E.fit(_z(spark, d), _heads(spark, d))


@query("o128_apply_ensemble", with_ctes("sc", body="," + SCALE + HEADS + " SELECT head, pitch, count(*) FILTER (WHERE score >= threshold) AS predicted, count(*) AS frames FROM hd JOIN ft USING (head, rule) GROUP BY 1, 2"))
def o128(spark, d):
    """The fitted rule and threshold of each head, applied: active cells by pitch."""
    on = E.apply_fitted(_z(spark, d), _heads(spark, d), o127(spark, d))
    return on.groupBy("head", "pitch").agg(F.sum("on").alias("predicted"), F.count("*").alias("frames"))


#: fixed values: members of each head over all banks, and the head's threshold
GLOBAL = {"activity": (0, 7, -169), "onset": (7, 17, -492)}
SC17 = """sc AS (SELECT c AS member, vec_id AS frame, p AS pitch, floor(embedding[(10 * c + p) % 64 + 1]::DOUBLE * 1000)::INT AS score, (label = p)::INT AS truth
  FROM (SELECT vec_id, label, embedding, unnest(range(0, 17))::INT AS c FROM embeddings), (SELECT unnest(range(0, 10))::INT AS p))"""


def _bank(spark, d):
    """Scores of 17 members: member m scores pitch p by feature (10m + p) mod 64."""
    x = table(spark, d, "embeddings")
    cell = F.explode(F.sequence(F.lit(0), F.lit(169))).alias("c")
    rows = x.select(F.col("vec_id").alias("frame"), "label", "embedding", cell)
    return rows.select(
        F.floor(F.col("c") / 10).cast("int").alias("member"), "frame", (F.col("c") % 10).cast("int").alias("pitch"),
        F.floor(F.element_at("embedding", F.col("c") % 64 + 1).cast("double") * 1000).cast("int").alias("score"), (F.col("label") == F.col("c") % 10).cast("int").alias("truth"),
    )


@query("o129_global_fusion", f"WITH {SC17},\n" + SCALE + """ SELECT head, pitch, count(*) FILTER (WHERE s >= CASE head WHEN 'activity' THEN -169 ELSE -492 END) AS predicted, count(*) AS frames FROM (
  SELECT CASE WHEN member < 7 THEN 'activity' ELSE 'onset' END AS head, frame, pitch, round_even((list_reduce(list(z ORDER BY member), lambda a, b: (a + b)::FLOAT) / count(*)::FLOAT)::FLOAT::DOUBLE * 1024, 0) AS s FROM nz GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def o129(spark, d):
    s = _bank(spark, d)
    z = s.join(small(E.robust_scale(s, "member")), "member").withColumn("z", E.normalised(F.col("score"), F.lit(20), F.round("scale", 4)))
    out = None
    for head, (first, last, cut) in GLOBAL.items():
        on = E.fuse(z.where((F.col("member") >= first) & (F.col("member") < last)), "mean").select(F.lit(head).alias("head"), "pitch", (E.quantise(F.col("fused")) >= cut).cast("int").alias("on"))
        out = on if out is None else out.unionByName(on)
    return out.groupBy("head", "pitch").agg(F.sum("on").alias("predicted"), F.count("*").alias("frames"))


PICK = """, tr AS (SELECT pitch, frame % 10 AS track, frame // 10 AS at FROM sc WHERE member = 0 AND truth = 1),
cut AS (SELECT member, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY f1 DESC, score DESC) AS k FROM fc) WHERE k = 1),
pr AS (SELECT rl.member, rl.pitch, frame % 10 AS track, frame // 10 AS at, truth FROM rl JOIN cut USING (member) WHERE score >= threshold),
ex AS (SELECT member, count(*) AS predicted, sum(truth) AS tp FROM pr GROUP BY 1),
tp AS (SELECT member, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM (SELECT member, EXISTS (SELECT 1 FROM tr WHERE tr.track = pr.track AND tr.pitch = pr.pitch AND abs(tr.at - pr.at) <= 2) AS hit FROM pr) GROUP BY 1),
fn AS (SELECT member, count(*) FILTER (WHERE NOT hit) AS fn FROM (SELECT cut.member, EXISTS (SELECT 1 FROM pr WHERE pr.member = cut.member AND tr.track = pr.track AND tr.pitch = pr.pitch AND abs(tr.at - pr.at) <= 2) AS hit FROM tr, cut) GROUP BY 1),
al AS (SELECT member, round(2 * tp.tp / greatest(2 * tp.tp + fp + fn, 1), 6) AS tolerant_f1, round(2 * ex.tp / greatest(predicted + (SELECT count(*) FROM tr), 1), 6) AS exact_f1, abs(predicted - (SELECT count(*) FROM tr)) AS off FROM ex JOIN tp USING (member) JOIN fn USING (member))"""


@query("o130_pick_fusion_rule", with_ctes("sc", body="," + SCALE + FIT.format(rules=RULES) + PICK + " SELECT member, tolerant_f1, exact_f1 FROM al ORDER BY tolerant_f1 DESC, exact_f1 DESC, off, member LIMIT 1"))
def o130(spark, d):
    """The rule with the best tolerant F1, then exact F1, then the count nearest to the targets'."""
    rules = _rules(spark, d)
    cuts = S.calibrate(rules, 1.5, "member").select("member", "threshold")
    cells = rules.join(small(cuts), "member").withColumn("p", (F.col("score") >= F.col("threshold")).cast("int"))
    place = (F.col("member").alias("rule"), F.pmod("frame", F.lit(10)).alias("track"), "pitch", F.floor(F.col("frame") / 10).alias("frame"))
    truth, predicted = cells.where("truth = 1").select(*place), cells.where("p = 1").select(*place)
    near = M.tolerant_presence(truth, predicted, 2, "rule", apart=("rule",)).withColumn("tolerant_f1", F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6))
    exact = cells.groupBy("member").agg(F.count_if((F.col("p") == 1) & (F.col("truth") == 1)).alias("tp"), F.sum("p").alias("predicted"), F.sum("truth").alias("target"))
    exact = exact.select(F.col("member").alias("rule"), F.round(S.f1(), 6).alias("exact_f1"), F.abs(F.col("predicted") - F.col("target")).alias("off"))
    ranked = near.select("rule", "tolerant_f1").join(exact, "rule")
    return E.pick(ranked, F.col("tolerant_f1").desc(), F.col("exact_f1").desc(), "off", "rule").select(F.col("rule").alias("member"), "tolerant_f1", "exact_f1")


@query("o095_ensemble_gain", with_ctes("sc", body="," + SCALE + FIT.format(rules=RULES) + """,
  mc AS (SELECT member, round(max(2.0::DOUBLE * tp / greatest(predicted + target, 1)), 6) AS f1 FROM (SELECT member, sum(n) OVER w AS predicted, sum(t) OVER w AS tp, sum(t) OVER (PARTITION BY member) AS target
    FROM (SELECT member, score, count(*) AS n, sum(truth) AS t FROM sc GROUP BY 1, 2) WINDOW w AS (PARTITION BY member ORDER BY score DESC)) WHERE predicted <= 1.5 * target GROUP BY 1)
  SELECT round(e - m, 5) AS over_mean, round(e - b, 5) AS over_best FROM (SELECT round(max(f1), 6) AS e FROM fc), (SELECT avg(f1) AS m, max(f1) AS b FROM mc)"""))
def o095(spark, d):
    return E.gain(S.calibrate(_rules(spark, d), 1.5, "member"), S.calibrate(scores(spark, d), 1.5, "member"))


@query("o113_distinct_thresholds", with_ctes("sc", body=" SELECT member, count(DISTINCT score) AS thresholds, count(*) - count(DISTINCT score) AS repeated FROM sc GROUP BY 1"))
def o113(spark, d):
    return scores(spark, d).groupBy("member").agg(F.count_distinct("score").alias("thresholds"), (F.count("*") - F.count_distinct("score")).alias("repeated"))


@query("o094_velocity_statistics", "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, median(value) AS median, count(DISTINCT value) AS different FROM events GROUP BY 1")
def o094(spark, d):
    v, rows = F.col("value"), table(spark, d, "events")
    rest = rows.groupBy("event_type").agg(F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.count_distinct(v).alias("different"))
    return rest.join(small(quantile_columns(rows, ("event_type",), v, median=0.5)), "event_type", "left")
