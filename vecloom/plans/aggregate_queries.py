"""Aggregations, audits and consolidation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import aggregate as A
from ..operators import consolidate as C
from ..operators import recall as R
from ..sources.tables import records, table
from .registry import query
from .vector_queries import _EASED, _RK4, REC


@query(
    f"""WITH {REC}, p AS (SELECT label, unnest(range(1, 65)) AS i, unnest(q) AS x FROM rec), sm AS (SELECT label, i, sum(x) AS x, count(*) AS n FROM p GROUP BY ALL),
    g AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS v FROM sm GROUP BY label)
    SELECT label, n, round(v[1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS last FROM g"""
)
def bundle_by_label(spark, sf_dir):
    b = A.bundle(records(spark, sf_dir), "label")
    r6 = lambda i: F.round(F.get("v", F.lit(i)), 6) + 0.0
    return b.select("label", "n", r6(0).alias("first"), r6(63).alias("last"))


@query(f"WITH {REC} SELECT count(*) AS n, sum((reliability >= 1)::INT)::BIGINT AS pinned, round(avg(reliability), 6) AS mean_reliability FROM rec")
def store_stats(spark, sf_dir):
    return A.store_stats(records(spark, sf_dir))


@query(
    f"""WITH {REC}, o AS (SELECT concept, reliability, q, (row_number() OVER (ORDER BY reliability DESC, concept) - 1) AS rn FROM rec WHERE reliability >= 0.5), c AS (SELECT *, rn // 8 AS chunk FROM o),
    p AS (SELECT chunk, unnest(range(1, 65)) AS i, unnest(q) AS x FROM c), sm AS (SELECT chunk, i, sum(x) AS x FROM p GROUP BY ALL), v AS (SELECT chunk, list(x ORDER BY i) AS v FROM sm GROUP BY chunk),
    g AS (SELECT chunk, count(*) AS n, round(avg(reliability), 6) AS mean, list(concept ORDER BY rn)[1:3] AS names FROM c GROUP BY chunk HAVING count(*) >= 2)
    SELECT chunk, n, mean, names, round(v[1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS first FROM g JOIN v USING (chunk)"""
)
def distill_chunks(spark, sf_dir):
    d = A.distill(records(spark, sf_dir), 0.5, 8)
    return d.select("chunk", "n", "mean", "names", (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("first"))


@query(
    f"""WITH RECURSIVE {REC}, {_RK4}, {_EASED}, r AS (SELECT rec.vec_id, rec.q, query, c, c < 0.30 AS rub FROM s AS rec WHERE reliability >= 0.85),
    j AS (SELECT r.*, w.q AS pulled, z.q AS eased, greatest(-1.0, least(1.0, list_cosine_similarity(z.q, r.query))) >= 0.74 AS good FROM r JOIN w ON w.vec_id = r.vec_id AND w.s = 4 JOIN z ON z.vec_id = r.vec_id AND z.s = 12),
    k AS (SELECT rub, query, CASE WHEN NOT rub THEN pulled WHEN good THEN eased ELSE list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) END AS v, CASE WHEN rub AND NOT good THEN 0.1 ELSE 1.0 END AS weight FROM j),
    x AS (SELECT i, sum(v[i] * weight) AS x FROM k, range(1, 65) t(i) GROUP BY i), y AS (SELECT list(x ORDER BY i) AS y FROM x), u AS (SELECT list_transform(y, lambda a: a / sqrt(list_dot_product(y, y))) AS v FROM y)
    SELECT (SELECT count(*) FROM k) AS n, (SELECT sum(rub::INT)::BIGINT FROM k) AS friction, list_transform(range(1, 5), lambda i: round(v[i], 6) + 0.0) AS head, 1.0::DOUBLE AS momentum_norm FROM u"""
)
def weighted_centroid(spark, sf_dir):
    r = records(spark, sf_dir)
    out = C.consolidate(r, R.query_vector(r, 0, "centroid"))
    return out.select("n", "friction", F.transform(F.slice("v", 1, 4), lambda x: F.round(x, 6) + 0.0).alias("head"), F.round(V.norm(F.col("momentum")), 6).alias("momentum_norm"))


_TR = " t AS (SELECT 'trace:' || event_id AS concept, 'Fix the ' || event_type || '! now' AS decision, 'f' || user_id % 3 AS stem, 'tool' || event_id % 4 AS tools, event_type <> 'error' AS success, (event_id * 13 % 100) / 100.0::DOUBLE AS reliability FROM events)"


@query(
    f"""WITH {_TR}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(decision), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) || '|' || stem || '|' || tools AS cluster FROM t WHERE success AND reliability >= 0.7)
    SELECT cluster, count(*) AS n, list_sort(list(concept ORDER BY concept)[1:5]) AS examples FROM k GROUP BY cluster HAVING count(*) >= 3 ORDER BY n DESC, cluster LIMIT 50"""
)
def skill_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select(
        F.concat(F.lit("trace:"), "event_id").alias("concept"), F.concat(F.lit("Fix the "), "event_type", F.lit("! now")).alias("decision"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("stem"),
        F.concat(F.lit("tool"), F.col("event_id") % 4).alias("tools"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") * 13 % 100 / 100.0).alias("reliability"),
    )
    return A.skill_clusters(t)


@query(
    f"""WITH {REC}, pr AS (SELECT concept AS probe, q AS pq FROM rec ORDER BY reliability DESC, concept LIMIT 20), h AS (SELECT probe, concept, round(list_cosine_similarity(q, pq), 6) AS score FROM rec, pr),
    t AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, concept) AS r FROM h), e AS (SELECT probe, max((concept = probe)::INT) AS hit, max(score) AS best FROM t WHERE r <= 5 GROUP BY probe)
    SELECT count(*) AS probes, round(avg(hit), 6) AS accuracy, round(avg(best), 6) AS mean_top FROM e"""
)
def dream_accuracy(spark, sf_dir):
    r = records(spark, sf_dir)
    probes = r.orderBy(F.desc("reliability"), "concept").limit(20).select(F.col("concept").alias("probe"), F.col("q").alias("pq"))  # twenty anchors
    hits = r.crossJoin(F.broadcast(probes)).select("probe", "concept", F.round(V.cosine(F.col("q"), F.col("pq")), 6).alias("score"))
    return A.recall_evaluation(hits, 5)


_CNT = " c AS (SELECT user_id, (event_type = 'view')::INT AS recalls, (event_type = 'view' AND value < 5)::INT AS empty_recalls, (event_type IN ('purchase', 'signup'))::INT AS writes, (event_type = 'error')::INT AS violations, (event_type = 'signup')::INT AS mints, (event_type = 'purchase')::INT AS updates FROM events)"


@query(
    f"""WITH {_CNT}, s AS (SELECT user_id, sum(recalls)::BIGINT AS recalls, sum(empty_recalls)::BIGINT AS empty_recalls, sum(writes)::BIGINT AS writes, sum(violations)::BIGINT AS violations, sum(mints)::BIGINT AS mints, sum(updates)::BIGINT AS updates FROM c GROUP BY user_id)
    SELECT *, round(CASE WHEN recalls = 0 THEN CASE WHEN writes = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE writes / recalls END, 6) AS writes_per_recall, round(CASE WHEN recalls = 0 THEN 0 ELSE empty_recalls / recalls END, 6) AS empty_rate,
      round(CASE WHEN updates = 0 THEN CASE WHEN mints = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE mints / updates END, 6) AS mint_update_ratio,
      CASE WHEN violations > 0 THEN 'recall_first' WHEN mints > updates AND mints > 0 THEN 'prefer_updates' WHEN recalls = 0 AND writes > 0 THEN 'plan_first' ELSE 'nominal' END AS advice FROM s"""
)
def trajectory_review(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    one = lambda c: c.cast("int")
    c = e.select("user_id", one(t == "view").alias("recalls"), one((t == "view") & (F.col("value") < 5)).alias("empty_recalls"), one(t.isin("purchase", "signup")).alias("writes"), one(t == "error").alias("violations"), one(t == "signup").alias("mints"), one(t == "purchase").alias("updates"))
    out = A.trajectory(c, "user_id")
    return out.withColumns({n: F.round(n, 6) for n in ("writes_per_recall", "empty_rate", "mint_update_ratio")})


@query(f"WITH {REC}, t AS (SELECT CASE WHEN reliability >= 0.85 THEN 'hot' WHEN reliability >= 0.5 THEN 'warm' ELSE 'cold' END AS tier FROM rec) SELECT count(*) AS n, round(avg((tier = 'hot')::INT), 6) AS hot, round(avg((tier = 'warm')::INT), 6) AS warm, round(avg((tier = 'cold')::INT), 6) AS cold FROM t")
def hit_rates(spark, sf_dir):
    r = F.col("reliability")
    return A.hit_rates(records(spark, sf_dir).select(F.when(r >= 0.85, "hot").when(r >= 0.5, "warm").otherwise("cold").alias("tier")))


_GOALS = " g AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'done' ELSE 'paused' END AS status, epoch(o_orderdate)::BIGINT AS last_ts FROM orders), n AS (SELECT max(last_ts) AS now FROM g)"


@query(f"WITH {_GOALS}, c AS (SELECT status, count(*) AS n, sum((status = 'active' AND now - last_ts > 72 * 3600)::INT)::BIGINT AS stale FROM g, n GROUP BY status) SELECT *, status = 'active' AND n > 5 AS sprawl FROM c")
def goal_hygiene_audit(spark, sf_dir):
    s = F.col("o_orderstatus")
    g = table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "O", "active").when(s == "F", "done").otherwise("paused").alias("status"), F.unix_timestamp("o_orderdate").alias("last_ts"))
    now = g.agg(F.max("last_ts").alias("now"))  # one row
    return A.goal_audit(g.crossJoin(F.broadcast(now)), F.col("now"))


_GATE = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH k AS (SELECT *, CASE WHEN event_type = 'view' THEN 'recall' WHEN event_type IN ('purchase', 'signup') THEN 'write' END AS kind FROM events), l AS (SELECT *, last_value(kind IGNORE NULLS) OVER {_GATE} AS last FROM k)
    SELECT user_id, event_id FROM l WHERE kind = 'write' AND last IS DISTINCT FROM 'recall'"""
)
def recall_gate_violations(spark, sf_dir):
    t = F.col("event_type")
    v = A.gate_violations(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], t == "view", t.isin("purchase", "signup"))
    return v.select("user_id", "event_id")


@query("SELECT o_orderpriority AS source, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def source_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, 1 + floor(value)::BIGINT AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    w AS (SELECT user_id, rn, CASE WHEN cost <= 40 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 40 THEN 1 ELSE 0 END AS kept FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.rn, CASE WHEN used + cost <= 40 THEN used + cost ELSE used END, CASE WHEN used + cost <= 40 THEN kept + 1 ELSE kept END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT user_id, arg_max(used, rn) AS used, arg_max(kept, rn)::INT AS kept FROM w GROUP BY user_id"""
)
def slot_packing(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("priority"), F.col("event_type").alias("name"), (1 + F.floor("value")).alias("cost"))
    return A.packed_slots(s, "user_id", 40).select("user_id", "used", F.size("kept").alias("kept"))


@query("""WITH h AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN h ON c_custkey = o_custkey),
    i AS (SELECT c_custkey, n, unnest(list_filter([CASE WHEN n > 14 THEN 'serving_sprawl' END, CASE WHEN n > 18 THEN 'trace_sprawl' END, CASE WHEN n = 0 THEN 'missing_demotion' END], lambda x: x IS NOT NULL)) AS issue FROM r) SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def hygiene_rules(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    r = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
    c = F.col("n")
    issues = F.array_compact(F.array(F.when(c > 14, F.lit("serving_sprawl")), F.when(c > 18, F.lit("trace_sprawl")), F.when(c == 0, F.lit("missing_demotion"))))
    return r.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 5")
def recent_curated(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_id", "user_id", "ts")
