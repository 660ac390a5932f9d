"""Queries of joins with contracts, set operations and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.operators import confirmation as K
from framelark.operators import contracts as C
from framelark.operators import metrics as M
from framelark.operators import notes as N
from framelark.operators import selection as S
from framelark.plans.registry import query
from framelark.sources.adapters import FRAMES, corpus, note_events, predicted_events, scores, table, with_ctes
from framelark.operators.sized import small


@query("o068_manifest_join", "SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def o068(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("o069_must_match", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def o069(spark, d):
    return C.must_match(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("doc_id is not null"), ["doc_id"])


@query(
    "o070_scores_by_row",
    with_ctes("sc", body=""", pl AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS row FROM (SELECT DISTINCT frame FROM sc))
  SELECT member, pitch, count(*) AS rows, count(*) FILTER (WHERE score >= 0 AND truth = 1) AS tp, count(*) FILTER (WHERE score >= 0 AND truth = 0) AS fp, sum(row)::BIGINT AS places FROM sc JOIN pl USING (frame) GROUP BY member, pitch"""),
)
def o070(spark, d):
    """Scores against labels of another table that numbers its frames in another way: they meet by row position."""
    s = scores(spark, d)
    labels = table(spark, d, "embeddings").select((F.col("vec_id") * 3 + 7).alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pitch"), "label")
    rows = C.by_row(s.select("member", "frame", "pitch", "score"), labels.select("frame", "pitch", (F.col("label") == F.col("pitch")).cast("int").alias("truth")), "member")
    on, true = F.col("score") >= 0, F.col("truth") == 1
    return rows.groupBy("member", "pitch").agg(F.count("*").alias("rows"), F.count_if(on & true).alias("tp"), F.count_if(on & ~true).alias("fp"), F.sum("row").alias("places"))


@query(
    "o070_header_differences",
    with_ctes("sc", body=" SELECT 'outputs' AS field, '10' AS \"left\", (SELECT count(DISTINCT label) + 1 FROM embeddings)::VARCHAR AS \"right\" UNION ALL SELECT 'threshold', '0', NULL"),
)
def o070_headers(spark, d):
    s = scores(spark, d).agg(F.count_distinct("frame").alias("frames"), F.count_distinct("pitch").alias("outputs"), F.min("pitch").alias("midi_min"), F.lit(0).alias("threshold"))
    e = table(spark, d, "embeddings").agg(F.count_distinct("vec_id").alias("frames"), (F.count_distinct("label") + 1).alias("outputs"), F.lit(0).alias("midi_min"))
    return C.header_differences(s, e)


@query(
    "o071_range_join",
    """WITH t AS (SELECT source, count(*) AS rows FROM documents GROUP BY 1), r AS (SELECT source, sum(rows) OVER (ORDER BY source) - rows AS first, sum(rows) OVER (ORDER BY source) AS last FROM t)
    SELECT r.source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d JOIN r ON d.doc_id >= first AND d.doc_id < last GROUP BY 1""",
)
def o071(spark, d):
    docs = table(spark, d, "documents")
    ranges = C.row_ranges(docs.groupBy(F.col("source")).agg(F.count("*").alias("rows")).withColumn("place", F.col("source")))
    rows = docs.select(F.col("doc_id").alias("row"), "n_chars")
    return C.in_ranges(rows, ranges).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "o072_one_to_one",
    """SELECT coalesce(a.o, b.o) AS o_custkey, CASE WHEN a.n IS NULL THEN 'missing left' WHEN b.n IS NULL THEN 'missing right' ELSE 'repeated' END AS problem FROM
    (SELECT o_custkey AS o, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS o, count(*) AS n FROM customer GROUP BY 1) b ON a.o = b.o WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1 OR b.n > 1""",
)
def o072(spark, d):
    return C.one_to_one(table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


@query("o073_join_heads", with_ctes("sc", body=" SELECT a.frame, a.pitch, a.score AS activity, b.score AS onset FROM sc a JOIN sc b USING (frame, pitch) WHERE a.member = 0 AND b.member = 3"))
def o073(spark, d):
    s = scores(spark, d)
    a = s.where("member = 0").select("frame", "pitch", F.col("score").alias("activity"))
    return a.join(s.where("member = 3").select("frame", "pitch", F.col("score").alias("onset")), ["frame", "pitch"])


@query("o074_member_order", "SELECT n_nationkey AS ord, n_name AS got, r_name AS want FROM nation FULL JOIN region ON n_nationkey = r_regionkey WHERE n_name IS DISTINCT FROM r_name")
def o074(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("id"))
    return C.in_order(a, table(spark, d, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("id")))


@query("o075_request_set", with_ctes("corp", body=" SELECT DISTINCT source, grp, model FROM corp, (SELECT unnest(['activity', 'onset', 'activity']) AS model)"))
def o075(spark, d):
    models = F.explode(F.array(F.lit("activity"), F.lit("onset"), F.lit("activity"))).alias("model")
    return corpus(spark, d).select("source", "grp", models).distinct()


@query("o078_bank_lookup", with_ctes("sc", body=" SELECT bank, member, count(*) AS n FROM sc JOIN (SELECT unnest([0, 1, 2, 3, 4, 5])::INT AS member, unnest(['plain', 'plain', 'contrast', 'contrast', 'profile', 'attack']) AS bank) USING (member) GROUP BY ALL"))
def o078(spark, d):
    banks = spark.createDataFrame(list(enumerate(["plain", "plain", "contrast", "contrast", "profile", "attack"])), "member int, bank string")
    return scores(spark, d).join(small(banks), "member").groupBy("bank", "member").agg(F.count("*").alias("n"))  # a row for each member


@query("o110_concatenate", "SELECT 'supplier' AS kind, s_suppkey AS id, s_nationkey AS nation FROM supplier UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer")
def o110(spark, d):
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c)


@query("o111_domain_union", with_ctes("ne", "pe", body=" SELECT track, pitch FROM ne UNION SELECT track, pitch FROM pe"))
def o111(spark, d):
    return note_events(spark, d).select("track", "pitch").union(predicted_events(spark, d).select("track", "pitch")).distinct()


@query("o111_domain_intersection", with_ctes("ne", "pe", body=" SELECT track, pitch, start FROM ne INTERSECT SELECT track, pitch, start FROM pe"))
def o111_both(spark, d):
    return note_events(spark, d).select("track", "pitch", "start").intersect(predicted_events(spark, d).select("track", "pitch", "start"))


@query("o112_key_violations", "(SELECT n_name AS key, 'unknown' AS problem FROM nation EXCEPT SELECT r_name, 'unknown' FROM region) UNION ALL (SELECT r_name, 'missing' FROM region EXCEPT SELECT n_name, 'missing' FROM nation)")
def o112(spark, d):
    return C.key_violations(table(spark, d, "nation").select(F.col("n_name").alias("key")), table(spark, d, "region").select(F.col("r_name").alias("key")))


@query(
    "o133_fingerprint",
    """SELECT n_regionkey, sha256(concat_ws(',', """ + ", ".join(f"sum(('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT)::VARCHAR" for k in range(8)) + """, count(*)::VARCHAR)) AS digest, count(*) AS rows FROM
    (SELECT n_regionkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS h FROM nation) GROUP BY 1""",
)
def o133(spark, d):
    return C.fingerprint(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey")


@query("split_balance", with_ctes("corp", body=" SELECT a.grp, a.n AS train, b.n AS test, a.n >= 4 * b.n AS ok FROM (SELECT grp, count(*) AS n FROM corp WHERE split = 'train' GROUP BY 1) a JOIN (SELECT grp, count(*) AS n FROM corp WHERE split <> 'train' GROUP BY 1) b USING (grp)"))
def o134(spark, d):
    c = corpus(spark, d)
    a = c.where("split = 'train'").groupBy("grp").agg(F.count("*").alias("train"))
    b = c.where("split <> 'train'").groupBy("grp").agg(F.count("*").alias("test"))
    return a.join(b, "grp").withColumn("ok", F.col("train") >= 4 * F.col("test"))


@query("o139_pending_runs", with_ctes("corp", body=" SELECT source, grp FROM corp GROUP BY ALL HAVING count(*) FILTER (WHERE split = 'test') = 0 OR NOT bool_or(id % 3 = 0)"))
def o139(spark, d):
    plan = corpus(spark, d).groupBy("source", "grp").agg(F.count_if(F.col("split") == "test").alias("t"), F.bool_or(F.col("id") % 3 == 0).alias("b"))
    signature = F.sha2(F.to_json(F.struct("grp", "source")), 256)
    done = plan.where("t > 0 and b").select(signature.alias("signature"))
    return C.pending(plan.select("source", "grp"), done, "source", "grp").select("source", "grp")


@query("o140_inherited_parameters", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_size END, CASE WHEN p_retailprice > 1500 THEN 30 END, CASE WHEN p_brand LIKE '%1' THEN 20 END, 10)::INT AS clauses FROM part")
def o140(spark, d):
    v = C.inherit(F.when(F.col("p_size") > 40, F.col("p_size")), F.when(F.col("p_retailprice") > 1500, 30), F.when(F.col("p_brand").like("%1"), 20), F.lit(10))
    return table(spark, d, "part").select("p_partkey", v.cast("int").alias("clauses"))


@query("o022_content_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5 FROM documents")
def o022(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"))


@query("o003_posterior_slice", "SELECT vec_id, round(list_sum(embedding[11:30]::DOUBLE[]), 6) AS mass FROM embeddings")
def o003(spark, d):
    part = F.slice(F.col("embedding").cast("array<double>"), 11, 20)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(part, F.lit(0.0), lambda s, v: s + v), 6).alias("mass"))


@query("o019_valid_labels", with_ctes("ne", body=' SELECT event_id, pitch, start, "end", pitch - 40 AS channel FROM ne WHERE "end" > start'))
def o019(spark, d):
    return note_events(spark, d).where("`end` > start").select("event_id", "pitch", "start", "end", (F.col("pitch") - 40).alias("channel"))


@query("safe_names", "SELECT url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name, regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$') AS valid FROM pages")
def o123_names(spark, d):
    return table(spark, d, "pages").select("url", C.safe_name(F.col("url")).alias("name"), C.valid_id(F.col("url")).alias("valid"))


@query(
    "turn_audit",
    """SELECT conv_id, count(*) AS turns, sum((turn <> k)::INT)::BIGINT AS gaps, sum(coalesce(role = p, false)::INT)::BIGINT AS repeats FROM
    (SELECT conv_id, turn, role, row_number() OVER w - 1 + min(turn) OVER (PARTITION BY conv_id) AS k, lag(role) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY 1""",
)
def o066_turns(spark, d):
    w = N.W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("k", F.row_number().over(w) - 1 + F.min("turn").over(N.W.partitionBy("conv_id"))).withColumn("p", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("turn") != F.col("k")).alias("gaps"), F.count_if(F.col("role") == F.col("p")).alias("repeats"))


@query(
    "o134_contract_violations",
    with_ctes("corp", body=""", c AS (SELECT source, split = 'train' AS t, count(DISTINCT grp) AS groups, min(id) % 4 AS least, count(*) % 3 AS size FROM corp WHERE split <> 'test' GROUP BY 1, 2),
      l AS (SELECT source, t, unnest(['groups', 'least', 'size']) AS field, unnest([groups::VARCHAR, least::VARCHAR, size::VARCHAR]) AS v FROM c)
      SELECT source, field, a.v AS given, b.v AS wanted FROM (SELECT * FROM l WHERE t) a FULL JOIN (SELECT * FROM l WHERE NOT t) b USING (source, field) WHERE a.v IS DISTINCT FROM b.v"""),
)
def o134_violations(spark, d):
    c = corpus(spark, d)
    of = lambda split: c.where(F.col("split") == split).groupBy("source").agg(F.count_distinct("grp").alias("groups"), (F.min("id") % 4).alias("least"), (F.count("*") % 3).alias("size"))
    return C.contract_violations(of("train"), of("validation"), "source", ["groups", "least", "size"])


@query("o088_realtime_factor", """SELECT user_id AS track, round(count(*) * 256 / 22050.0::DOUBLE / greatest(sum(value) / 1000, 1e-9), 6) AS factor FROM events GROUP BY 1""")
def o088(spark, d):
    """A frame of 256 samples for each event, against its value as milliseconds."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("track")).agg(F.count("*").alias("n"), F.sum("value").alias("ms"))
    return e.select("track", F.round(C.realtime_factor(F.col("n") * 256 / F.lit(22050.0), F.col("ms") / 1000), 6).alias("factor"))


@query("o097_stable_seed")
def o097(spark, d):
    return corpus(spark, d).select("id", S.stable_seed(F.concat_ws("/", "source", "id"), 42).alias("seed"))


@query(
    "o141_leak_guard",
    with_ctes("corp", body=""", us AS (SELECT 'activity' AS fit, id FROM corp WHERE split = 'train' UNION ALL SELECT 'threshold', id FROM corp WHERE split = 'validation' OR id % 100 = 19 UNION ALL SELECT 'threshold', -1 - id FROM corp WHERE id % 500 = 7)
      SELECT fit, us.id, CASE WHEN corp.id IS NULL THEN 'unknown row' WHEN split = 'test' THEN 'held-out row' ELSE 'group of a held-out row' END AS problem
      FROM us LEFT JOIN corp ON corp.id = us.id WHERE corp.id IS NULL OR split = 'test' OR source || '/' || coalesce(grp, '') || '/' || us.id % 7 IN (SELECT source || '/' || coalesce(grp, '') || '/' || id % 7 FROM corp WHERE split = 'test' AND source IS NOT NULL)"""),
)
def o141(spark, d):
    """What two fits read, with some held-out rows among it: the rows that forbid a confirmation."""
    c = corpus(spark, d).withColumn("grp", F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", F.coalesce("grp", F.lit("")), F.col("id") % 7)))
    fit = lambda name, rows, ident="id": rows.select(F.lit(name).alias("fit"), F.expr(ident).alias("id"))
    used = fit("activity", c.where("split = 'train'")).unionByName(fit("threshold", c.where("split = 'validation' or id % 100 = 19"))).unionByName(fit("threshold", c.where("id % 500 = 7"), "-1 - id"))
    return K.leaks(used, c)
