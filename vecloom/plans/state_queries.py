"""Folds over ordered histories, streams, packs and wire rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import mutate as M
from ..operators.aggregate import beside
from ..sources import packs as P
from ..sources.tables import records, table
from ..streaming import feed as S
from ..streaming.ordered import stateful_session
from .registry import query
from .vector_queries import REC

_EV = " e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


_ORDER = ["ts", "event_id"]


@query(f"WITH RECURSIVE {_EV}, w AS (SELECT user_id, rn, value::DOUBLE AS m FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, m * 0.8 + value * 0.2 FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) SELECT user_id, round(arg_max(m, rn), 6) AS mean, max(rn) AS n FROM w GROUP BY user_id")
def ema_update_fold(spark, sf_dir):
    return M.ema(table(spark, sf_dir, "events"), "user_id", _ORDER, "value").select("user_id", F.round("mean", 6).alias("mean"), "n")


@query(
    f"""WITH RECURSIVE {_EV}, w AS (SELECT user_id, 0 AS rn, 0.0::DOUBLE AS s, 0.0::DOUBLE AS d, 0 AS k, false AS c FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT e.user_id, e.rn, CASE WHEN ok THEN least(s + 0.25, 2.0) ELSE s END, CASE WHEN ok THEN d ELSE least(d + 0.25, 2.0) END, CASE WHEN ok THEN 0 ELSE k + 1 END,
        c OR (CASE WHEN ok THEN least(s + 0.25, 2.0) ELSE s END) - (CASE WHEN ok THEN d ELSE least(d + 0.25, 2.0) END) >= 1
      FROM w JOIN (SELECT *, event_type <> 'error' AS ok FROM e) e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT user_id, arg_max(s, rn) AS support, arg_max(d, rn) AS denial, arg_max(k, rn) AS streak, arg_max(c, rn) AS confirmed FROM w GROUP BY user_id"""
)
def hypothesis_fold(spark, sf_dir):
    return M.hypothesis(table(spark, sf_dir, "events"), "user_id", _ORDER, F.col("event_type") != "error")


@query(
    f"""WITH RECURSIVE {_EV}, g AS (SELECT *, least(value / 100.0, 1.5) AS g, (rn % 10) / 10.0::DOUBLE AS m FROM e),
    w AS (SELECT user_id, 0 AS rn, 0.0::DOUBLE AS a, 0.0::DOUBLE AS d, 0.0::DOUBLE AS r FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT g.user_id, g.rn, (1 - 0.034) * a + 0.12 * greatest(1 - g, 0.0), (1 - 0.034) * d + 0.12 * least(g, 1.0), (1 - 0.034) * r + 0.12 * (1 - least(m, 1.0)) FROM w JOIN g ON g.user_id = w.user_id AND g.rn = w.rn + 1),
    f AS (SELECT user_id, arg_max(a, rn) AS a, arg_max(d, rn) AS d, arg_max(r, rn) AS r FROM w GROUP BY user_id)
    SELECT user_id, round(a, 6) AS a, round(d, 6) AS d, round(r, 6) AS r, round((0.4 * a * a + 0.3 * d * d + 0.3 * r * r) / pow(greatest(a + d + r, 1e-6), 2), 6) AS phi FROM f"""
)
def stability_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("m", F.row_number().over(w) % 10 / 10.0)
    out = M.stability(e, "user_id", _ORDER, F.least(F.col("value") / 100.0, F.lit(1.5)), F.col("m"))
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in "adr"], F.round(M.lyapunov(F.col("a"), F.col("d"), F.col("r")), 6).alias("phi"))


@query(f"WITH {REC}, l AS (SELECT label, vec_id, q, lag(q) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM rec) SELECT vec_id, round(1 - greatest(-1.0, least(1.0, list_cosine_similarity(q, p))), 6) AS drift FROM l WHERE p IS NOT NULL")
def drift_lag(spark, sf_dir):
    r = beside(records(spark, sf_dir).select("label", "vec_id", "q"), "label", [F.asc("vec_id")], -1, p="q").where("p is not null")
    return r.select("vec_id", F.round(1 - V.cosine(F.col("q"), F.col("p")), 6).alias("drift"))


@query(
    f"""WITH {REC}, o AS (SELECT concept, q, drift, mass FROM rec), n AS (SELECT 'rec:' || (vec_id * 2) AS concept, q AS nq FROM rec),
    j AS (SELECT coalesce(o.concept, n.concept) AS concept, q, nq, drift, mass, list_transform(range(1, 65), lambda i: 0.8 * q[i] + 0.2 * nq[i]) AS b FROM o FULL JOIN n ON o.concept = n.concept)
    SELECT concept, round(CASE WHEN q IS NOT NULL AND nq IS NOT NULL THEN b[1] / sqrt(list_dot_product(b, b)) ELSE coalesce(q, nq)[1] END, 6) + 0.0 AS first,
      round(CASE WHEN q IS NOT NULL AND nq IS NOT NULL THEN greatest(0.0, least(1.0, 1 - list_cosine_similarity(q, nq))) ELSE coalesce(drift, 0.0) END, 6) AS drift, coalesce(mass, 0) + (nq IS NOT NULL)::INT AS mass FROM j"""
)
def blended_update(spark, sf_dir):
    """All records are old; the new vectors carry doubled ids: even ones blend, those past the end are inserts, odd ones stay."""
    r = records(spark, sf_dir)
    new = r.select(F.concat(F.lit("rec:"), F.col("vec_id") * 2).alias("concept"), "q")
    out = M.blended(r.select("concept", "q", "drift", "mass"), new)
    return out.select("concept", (F.round(F.get("q", F.lit(0)), 6) + 0.0).alias("first"), F.round("drift", 6).alias("drift"), "mass")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT -c_custkey, 'NEW' FROM customer WHERE c_custkey < 5")
def upsert_forget(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    kept = M.forget(c, c.where(k % 7 == 0), "c_custkey")
    new = kept.where(k % 10 == 3).select("c_custkey", F.lit("NEW").alias("c_mktsegment")).union(c.where(k < 5).select(-k, F.lit("NEW")))
    return M.upsert(kept, new, "c_custkey")


@query(f"WITH {REC} SELECT concept FROM rec WHERE reliability >= 0.3")
def forget_old(spark, sf_dir):
    return M.forget_old(records(spark, sf_dir), 0.3).select("concept")


@query("WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT o_custkey, o_totalprice FROM p WHERE r = 1")
def federated_lookup(spark, sf_dir):
    return M.first_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey").select("o_custkey", "o_totalprice")


@query("SELECT ts, event_type, user_id FROM (SELECT DISTINCT ts, event_type, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15') ORDER BY ts DESC, event_type, user_id LIMIT 80")
def activity_feed_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type", "user_id")
    twice = e.union(e)
    return S.poll(twice, F.lit("2024-01-15").cast("timestamp"), 500, ["event_type", "user_id", "ts"])


_SESS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s"""


@query(_SESS)
def turn_window(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), "user_id")


@query("SELECT event_id, event_type FROM events")
def stream_feed_dedup(spark, sf_dir):
    s = S.read_table(spark, sf_dir, "events")
    return S.replay(S.deduplicated(s, ["event_id"]).select("event_id", "event_type"), "dedup")


@query(f"SELECT * FROM ({_SESS}) WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_session_turns(spark, sf_dir):
    """Closed sessions; those the watermark has not passed at the end of the input stay open."""
    return S.replay(S.sessions(S.read_table(spark, sf_dir, "events"), "user_id"), "sessions")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return S.windows(table(spark, sf_dir, "events"), "event_type", "1 day")


@query(
    """WITH RECURSIVE r AS (SELECT event_type AS resource, user_id AS holder, epoch_us(ts) AS moment, event_id AS "order", row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT resource, rn, "order", holder, true AS granted, holder AS own, moment + 3600000000 AS until FROM r WHERE rn = 1
      UNION ALL SELECT r.resource, r.rn, r."order", r.holder, until <= moment OR own = r.holder, CASE WHEN until <= moment OR own = r.holder THEN r.holder ELSE own END, CASE WHEN until <= moment OR own = r.holder THEN moment + 3600000000 ELSE until END FROM w JOIN r ON r.resource = w.resource AND r.rn = w.rn + 1)
    SELECT resource, "order", holder, granted FROM w"""
)
def stream_lease_ttl(spark, sf_dir):
    """Leases of an hour on event types, asked for by users; the state store keeps one lease a resource."""
    e = S.read_table(stateful_session(spark), sf_dir, "events")
    req = e.select(F.col("event_type").alias("resource"), F.col("user_id").alias("holder"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("order"))
    return S.replay(S.leases(req, 3_600_000_000), "leases")


@query("WITH a AS (SELECT o_custkey AS branch, o_orderdate AS ts, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'merged' WHEN o_orderpriority LIKE '5%' THEN 'abandoned' ELSE 'open' END AS action FROM orders), t AS (SELECT branch, epoch_us(ts) * 1000000 + o_orderkey AS ts, action FROM a) SELECT branch, coalesce(arg_min(action, ts) FILTER (WHERE action <> 'open'), arg_max(action, ts)) AS state FROM t GROUP BY branch".replace("epoch_us(ts) * 1000000", "(epoch_us(ts) // 1000000)::HUGEINT * 10000000"))
def branch_states(spark, sf_dir):
    p = F.col("o_orderpriority")
    action = F.when(p.startswith("1"), "merged").when(p.startswith("5"), "abandoned").otherwise("open")
    return S.branch_states(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("branch"), F.struct("o_orderdate", "o_orderkey").alias("ts"), action.alias("action")))


@query("SELECT 'doc:' || doc_id AS concept, sha256(text) AS body, 0.8::DOUBLE AS reliability, 'doc' AS kind, (SELECT count(*) FROM documents) AS n, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes FROM documents")
def pack_round_trip(spark, sf_dir):
    """Every record as it comes back from the pack, with its manifest's counts."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("concept"), F.col("text").alias("body"), F.lit(0.8).alias("reliability"), F.lit("doc").alias("kind"))
    path = P.pack_path(spark)
    P.write_pack(d, path)
    P.check_manifest(spark, path)
    back = P.read_pack(spark, path)
    counts = P.manifest(back).select("n", "bytes")  # one row
    return back.select("concept", F.sha2("body", 256).alias("body"), "reliability", "kind").crossJoin(F.broadcast(counts))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'sync:doc:' || doc_id ELSE 'doc:' || doc_id END AS concept, least((doc_id * 37 % 100) / 100.0::DOUBLE, 0.6)::DOUBLE AS reliability FROM documents")
def sync_quarantine(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("concept"), F.col("text").alias("body"), (F.col("doc_id") * 37 % 100 / 100.0).alias("reliability"), F.lit("doc").alias("kind"), "doc_id")
    return P.quarantined(d.drop("doc_id"), d.where("doc_id % 3 = 0")).select("concept", "reliability")


@query(f"WITH {REC} SELECT concept, reliability, (vec_id % 100)::INT AS tag, round(q[1], 6) + 0.0 AS first, len(q) AS n FROM rec")
def wire_round_trip(spark, sf_dir):
    r = records(spark, sf_dir)
    w = r.select(P.wire_encode()("concept", "reliability", (F.col("vec_id") % 100).cast("int"), F.col("q").cast("array<float>"), F.lit("body")).alias("w"))
    return w.select(P.wire_decode()("w").alias("x")).select("x.concept", "x.reliability", "x.tag", (F.round(F.get("x.q", F.lit(0)).cast("double"), 6) + 0.0).alias("first"), F.size("x.q").cast("long").alias("n"))


@query("SELECT 'external:web:' || regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g')[1:48] || ':1700000000' AS concept, 0.55::DOUBLE AS reliability FROM pages")
def external_ingest(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("body"))
    return P.external(p, "web", 1_700_000_000).select("concept", "reliability")
