"""Wake digests, leases, coherence, ranked actions and receipts over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vector as V
from ..operators import continuity as C
from ..operators import encode as E
from ..operators import recall as R
from ..shared import cut
from ..sources.tables import edges, records, table
from .graph_queries import EDGES
from .registry import query
from .report_queries import NAMED, named
from .text_queries import _TOK, _sql_scrub
from .vector_queries import REC

_OV = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_SESSION = """ss AS (SELECT conv_id AS session, arg_min(text, turn) AS intent FROM conversations GROUP BY conv_id),
    gl AS (SELECT item_id, 'goal:' || text AS goal FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
    s AS (SELECT session, intent, goal, ['sampled_bounded', 'linear', 'indexed'][session % 3 + 1] AS mode, session % 2 = 0 AS large FROM ss, n JOIN gl ON item_id = session % n)"""


def _sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.min_by("text", "turn").alias("intent"))
    g = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("goal:"), "text").alias("goal"))
    n = g.agg(F.count("*").alias("n"))
    s = c.crossJoin(F.broadcast(n))  # one row
    s = s.join(g, F.col("item_id") == F.col("session") % F.col("n"))
    mode = F.get(F.array(F.lit("sampled_bounded"), F.lit("linear"), F.lit("indexed")), (F.col("session") % 3).cast("int"))
    return s.select("session", "intent", "goal", mode.alias("mode"), (F.col("session") % 2 == 0).alias("large"))


_AL = f"""t AS (SELECT *, {_TOK.format(t='intent')} AS ti, {_TOK.format(t='goal')} AS tg FROM s),
    a AS (SELECT *, intent = '' OR goal = '' OR {_OV.format(a='ti', b='tg')} >= 0.08 OR contains(lower(intent), lower(goal)) OR contains(lower(intent), string_split(lower(goal), ':')[-1]) AS aligned FROM t)"""
_ACTIONS = ["read_handoff", "recall_goal", "open_trace", "review_scars"]


@query(
    f"""WITH {NAMED}, {_SESSION}, {_AL},
    sc AS (SELECT concept, left(body, 140) AS preview FROM c WHERE starts_with(concept, 'scar:') ORDER BY doc_id LIMIT 5),
    p AS (SELECT session, concept, CASE WHEN intent = '' THEN 1.0 ELSE {_OV.format(a='ti', b='ts')} END AS k FROM a, (SELECT concept, {_TOK.format(t="concept || ' ' || preview")} AS ts FROM sc)),
    r AS (SELECT session, concept, row_number() OVER (PARTITION BY session ORDER BY k DESC, concept) AS r FROM p)
    SELECT a.session, aligned, list_filter([CASE WHEN NOT aligned THEN 'intent_differs_from_goal' END, CASE WHEN large AND mode <> 'indexed' THEN 'recall_' || mode END], lambda x: x IS NOT NULL) AS warnings,
      ['read_handoff', 'recall_goal', 'open_trace'] AS top_actions, list(concept ORDER BY r) AS top_scars FROM a JOIN r ON a.session = r.session AND r <= 2 GROUP BY ALL"""
)
def wake_digest(spark, sf_dir):
    scars = named(spark, sf_dir).where(F.col("concept").startswith("scar:")).orderBy("doc_id").limit(5).select("concept", F.substring("body", 1, 140).alias("preview"))
    actions = spark.createDataFrame([(n, k) for k, n in enumerate(_ACTIONS)], "name string, priority int")
    return C.wake_digest(_sessions(spark, sf_dir), scars, actions)


@query(
    f"""WITH {_SESSION}, h AS (SELECT *, ['off', 'auto', 'suggest', 'auto'][session % 4 + 1] AS how, CASE WHEN session % 5 = 0 THEN '' WHEN session % 5 = 1 THEN goal ELSE 'goal:' || left(intent, 60) END AS handoff FROM s),
    t AS (SELECT *, {_TOK.format(t='intent')} AS ti, {_TOK.format(t='goal')} AS tg, {_TOK.format(t='handoff')} AS th FROM h),
    o AS (SELECT *, {_OV.format(a='ti', b='tg')} AS og, {_OV.format(a='ti', b='th')} AS oh FROM t),
    a AS (SELECT *, intent = '' OR goal = '' OR og >= 0.08 OR contains(lower(intent), lower(goal)) OR contains(lower(intent), string_split(lower(goal), ':')[-1]) AS ag,
      intent = '' OR handoff = '' OR oh >= 0.08 OR contains(lower(intent), lower(handoff)) OR contains(lower(intent), string_split(lower(handoff), ':')[-1]) AS ah, handoff <> '' AND handoff <> goal AS other FROM o)
    SELECT session, CASE WHEN how = 'off' OR ag THEN 'none' WHEN how = 'auto' AND other AND ah AND oh > og THEN 'auto' ELSE 'suggest' END AS decision, CASE WHEN NOT (how = 'off' OR ag) AND other THEN handoff END AS goal FROM a"""
)
def goal_rebind(spark, sf_dir):
    s, i = _sessions(spark, sf_dir), F.col("session")
    how = F.get(F.array(*map(F.lit, ["off", "auto", "suggest", "auto"])), (i % 4).cast("int"))
    handoff = F.when(i % 5 == 0, "").when(i % 5 == 1, F.col("goal")).otherwise(F.concat(F.lit("goal:"), F.substring("intent", 1, 60)))
    return s.select("session", C.rebind(how, F.col("intent"), F.col("goal"), handoff).alias("r")).select("session", "r.*")


# ---- leases ---------------------------------------------------------------------------------

_LEASE = """ l AS (SELECT 'customer:' || c_custkey AS concept, c_nationkey AS holder, (c_custkey % 7) * 100 AS expires FROM customer WHERE c_custkey % 3 <> 0),
    r AS (SELECT o_orderkey, 'customer:' || o_custkey AS concept, o_orderkey % 25 AS agent, o_orderkey % 600 AS moment FROM orders),
    j AS (SELECT r.*, CASE WHEN expires > moment THEN holder END AS holder FROM r LEFT JOIN l USING (concept))"""


def _leases(spark, sf_dir):
    l = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"), F.col("c_nationkey").cast("long").alias("holder"), (F.col("c_custkey") % 7 * 100).alias("expires"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("customer:"), "o_custkey").alias("concept"), (F.col("o_orderkey") % 25).alias("agent"), (F.col("o_orderkey") % 600).alias("at"))
    return r, l


@query(f"WITH {_LEASE} SELECT o_orderkey, CASE WHEN holder IS NULL THEN 'no_lease' WHEN holder = agent THEN 'released' ELSE 'not_holder' END AS outcome FROM j")
def lease_release(spark, sf_dir):
    return C.released(*_leases(spark, sf_dir)).select("o_orderkey", "outcome")


@query(f"WITH {_LEASE} SELECT o_orderkey, holder IS NULL OR holder = agent AS allowed, CASE WHEN holder IS NOT NULL AND holder <> agent THEN 'conflict:' || concept || '-' || moment END AS conflict FROM j")
def lease_write_check(spark, sf_dir):
    return C.write_checks(*_leases(spark, sf_dir)).select("o_orderkey", "allowed", "conflict")


# ---- coherence and recall by text -----------------------------------------------------------

_D = 8
_LANES = """w{n} AS (SELECT {by}, unnest(list_filter(regexp_split_to_array(lower({t}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS w FROM {src}),
    a{n} AS (SELECT {by}, i, ('0x' || md5(w || '#' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS a FROM w{n}, range({d}) t(i)),
    s{n} AS (SELECT {by}, i, sum(cos(a)) AS re, sum(sin(a)) AS im FROM a{n} GROUP BY ALL), v{n} AS (SELECT {by}, list(re ORDER BY i) || list(im ORDER BY i) AS v FROM s{n} GROUP BY {by})"""


def _lanes(n, by, t, src):
    return _LANES.format(n=n, by=by, t=t, src=src, d=_D)


def _encoded(df, text, by):
    return E.encode_lanes(df, text, _D, by).select(by, F.concat("re", "im").alias("v"))


_TAIL = "text || chr(10) || '**recorded_at:** 7'"


@query(
    f"""WITH {_lanes(1, 'item_id', 'text', 'benchmark')}, {_lanes(2, 'item_id', "text || ' more words'", 'benchmark')}, {_lanes(3, 'item_id', "'more words'", 'benchmark')},
    x AS (SELECT v1.item_id, v1.v AS q, v2.v AS e, v3.v AS nw FROM v1 JOIN v2 USING (item_id) JOIN v3 USING (item_id)),
    y AS (SELECT *, list_transform(range(1, {2 * _D + 1}), lambda i: q[i] / sqrt(list_dot_product(q, q)) + nw[i] / sqrt(list_dot_product(nw, nw))) AS p FROM x)
    SELECT item_id, 1.0::DOUBLE AS own, round(greatest(0.0, list_cosine_similarity(q, e)), 6) AS replaced, round(greatest(0.0, list_cosine_similarity(p, e)), 6) AS appended FROM y"""
)
def text_coherence(spark, sf_dir):
    """Of each item: coherence with its own body less its footer, and with a longer one, before and after adding the new part."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    q = _encoded(b, "text", "item_id").withColumnRenamed("v", "q")
    bare = _encoded(b.select("item_id", T.without_footer(F.concat("text", F.lit("\n**recorded_at:** 7"))).alias("t")), "t", "item_id").withColumnRenamed("v", "own")
    e = _encoded(b.select("item_id", F.concat("text", F.lit(" more words")).alias("t")), "t", "item_id").withColumnRenamed("v", "e")
    n = _encoded(b.select("item_id", F.lit("more words").alias("t")), "t", "item_id").withColumnRenamed("v", "n")
    x = q.join(bare, "item_id").join(e, "item_id").join(n, "item_id")
    r = lambda c: F.round(c, 6)
    how = lambda m: r(C.update_coherence(F.lit(m), F.col("q"), F.col("n"), F.col("e")))
    return x.select("item_id", r(C.coherence(F.col("q"), F.col("own"))).alias("own"), how("replace").alias("replaced"), how("append").alias("appended"))


@query(
    f"""WITH {_lanes(1, 'item_id', 'text', 'benchmark')}, qt AS (SELECT 0 AS k, (SELECT string_agg(x, ' ') FROM (SELECT unnest(string_split(text, ' ')[1:12]) AS x FROM benchmark WHERE item_id = 3)) AS text), {_lanes(2, 'k', 'text', 'qt')}
    SELECT 'item:' || item_id AS concept, round(list_cosine_similarity(v1.v, v2.v), 6) AS score FROM v1, v2 ORDER BY score DESC, concept LIMIT 10"""
)
def text_recall(spark, sf_dir):
    """A question in words: encoded like the stored texts, then the ten nearest."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    ask = b.where("item_id = 3").select(F.lit(0).alias("k"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("text"))
    stored = _encoded(b, "text", "item_id").select(F.concat(F.lit("item:"), "item_id").alias("concept"), F.col("v").alias("q"))
    return R.recall(stored, _encoded(ask, "text", "k").select(F.col("v").alias("query")), 10)


@query(
    f"""WITH k AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'item:' || item_id ELSE 'unknown ' || item_id END AS concept FROM benchmark), {_lanes(1, 'item_id', 'text', 'benchmark')}, {_lanes(2, 'item_id', 'concept', 'k')}
    SELECT concept, round((CASE WHEN k.item_id % 2 = 0 THEN v1.v[1] / sqrt(list_dot_product(v1.v, v1.v)) ELSE v2.v[1] / sqrt(list_dot_product(v2.v, v2.v)) END), 6) + 0.0 AS first, k.item_id % 2 = 0 AS fetched FROM k JOIN v1 USING (item_id) JOIN v2 USING (item_id)"""
)
def fetch_or_encode(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = b.select(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("item:"), "item_id")).otherwise(F.concat(F.lit("unknown "), "item_id")).alias("concept"))
    stored = _encoded(b, "text", "item_id").select(F.concat(F.lit("item:"), "item_id").alias("concept"), F.col("v").alias("q"))
    names = _encoded(asked.withColumn("name", F.col("concept")), "name", "concept").withColumnRenamed("v", "q")
    return C.fetch_or_encode(asked, stored, names).select("concept", (F.round(F.get("q", F.lit(0)), 6) + 0.0).alias("first"), "fetched")


# ---- ranks ----------------------------------------------------------------------------------


@query(
    f"""WITH {NAMED}, a AS (SELECT source, concept AS name, doc_id % 11 = 0 AS nudge, ['read', 'portable rehydration manifest', 'manifest primary_goal', 'manifest trace_chain_head', 'momentum'][doc_id % 5 + 1] AS reason, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concept END AS co, doc_id % 9 AS prio, reliability FROM c),
    r AS (SELECT source, name, round(CASE WHEN nudge THEN 100.0 WHEN contains(reason, 'portable') THEN 95.0 WHEN contains(reason, 'primary_goal') THEN 90.0 WHEN contains(reason, 'trace_chain_head') THEN 85.0 WHEN co = '' THEN 0.05 + 1.0 / (1.0 + prio) ELSE reliability * 0.35 END, 6) AS rank FROM a)
    SELECT source, name, rank, row_number() OVER (PARTITION BY source ORDER BY rank DESC, name) AS priority FROM r"""
)
def action_ranking(spark, sf_dir):
    n, i = named(spark, sf_dir), F.col("doc_id")
    reason = F.get(F.array(*map(F.lit, ["read", "portable rehydration manifest", "manifest primary_goal", "manifest trace_chain_head", "momentum"])), (i % 5).cast("int"))
    rank = C.action_rank(i % 11 == 0, reason, F.when(i % 3 == 0, "").otherwise(F.col("concept")), i % 9, F.col("reliability") * 0.35)
    return C.ranked_actions(n.select("source", F.col("concept").alias("name"), F.round(rank, 6).alias("rank")), "source")


@query(
    f"""WITH {NAMED}, l AS (SELECT concept, ts FROM c ORDER BY ts DESC, concept LIMIT 96), o AS (SELECT concept, reliability FROM c WHERE starts_with(concept, 'scar:') AND reliability >= 0.5)
    SELECT concept, reliability, ts, 'recent' AS source FROM o JOIN l USING (concept) ORDER BY ts DESC, concept LIMIT 5"""
)
def open_scars(spark, sf_dir):
    n = named(spark, sf_dir)
    return C.open_scars(n.select("concept", "reliability"), n.select("concept", "ts"))


@query(
    f"""WITH {NAMED} SELECT source, (2 + max((starts_with(concept, 'helper:'))::INT) + max((starts_with(concept, 'trace:'))::INT) + (count(*) FILTER (WHERE starts_with(concept, 'tile:')) > 3)::INT) / 5.0 AS score,
      list_filter([CASE WHEN max((starts_with(concept, 'helper:'))::INT) = 0 THEN 'session_handoff' END, CASE WHEN max((starts_with(concept, 'trace:'))::INT) = 0 THEN 'trace_chain_head' END, CASE WHEN count(*) FILTER (WHERE starts_with(concept, 'tile:')) <= 3 THEN 'hot_tiles' END], lambda x: x IS NOT NULL) AS missing FROM c GROUP BY source"""
)
def injection_completeness(spark, sf_dir):
    has = lambda p: F.max(F.col("concept").startswith(p).cast("int"))
    g = named(spark, sf_dir).groupBy("source").agg(has("helper:").alias("h"), has("trace:").alias("t"), F.count_if(F.col("concept").startswith("tile:")).alias("n"))
    yes = F.lit(True)
    c = C.completeness({"primary_goal": yes, "session_handoff": F.col("h") == 1, "trace_chain_head": F.col("t") == 1, "open_scars_surfaced": yes, "hot_tiles": F.col("n") > 3})
    return g.select("source", c.alias("c")).select("source", "c.score", "c.missing")


_KEY = "greatest(0.40, least(0.97, 0.48 + len(regexp_extract_all(lower(b), 'reconcile:')) * 0.17 + len(regexp_extract_all(lower(b), 'reconcile ')) * 0.17 + CASE WHEN contains(lower(b), 'affirm:') THEN 0.06 ELSE 0 END + CASE WHEN contains(lower(b), 'deny:') THEN 0.06 ELSE 0 END + CASE WHEN regexp_matches(concept, '^(trace|tile|goal):') THEN 0.09 ELSE 0 END))::DOUBLE"
_KEYED = f"k AS (SELECT *, left(body, 50) || CASE doc_id % 4 WHEN 0 THEN ' Reconcile: a affirm: b' WHEN 1 THEN ' deny: c reconcile d reconcile: e' ELSE '' END AS b FROM c), f AS (SELECT concept, reliability, round({_KEY}, 6) AS score FROM k)"


def _keyed(spark, sf_dir):
    n, i = named(spark, sf_dir), F.col("doc_id")
    b = F.concat(F.substring("body", 1, 50), F.when(i % 4 == 0, " Reconcile: a affirm: b").when(i % 4 == 1, " deny: c reconcile d reconcile: e").otherwise(""))
    return n.select("concept", "reliability", F.round(S.keyword_score(b, F.col("concept")), 6).alias("score"))


@query(f"WITH {NAMED}, {_KEYED} SELECT concept, score, round(reliability * 0.55 + score * 0.45, 6) AS boosted FROM f")
def keyword_boost(spark, sf_dir):
    return _keyed(spark, sf_dir).select("concept", "score", F.round(C.boosted(F.col("reliability"), F.col("score")), 6).alias("boosted"))


@query(f"WITH {NAMED}, {_KEYED} SELECT count(*) FILTER (WHERE score > 0.7) AS high, round(avg(score), 6) AS mean, (SELECT list(concept ORDER BY score DESC, concept) FROM (SELECT * FROM f ORDER BY score DESC, concept LIMIT 4)) AS top FROM f")
def keyword_summary(spark, sf_dir):
    return C.score_summary(_keyed(spark, sf_dir)).select("high", F.round("mean", 6).alias("mean"), "top")


@query("SELECT user_id, round(least(1.0, coalesce(avg(v) FILTER (WHERE v > 0), 0.0) / 0.5), 6) AS surprise FROM (SELECT user_id, (event_id % 7 - 2) / 20.0::DOUBLE AS v FROM events) GROUP BY user_id")
def hub_surprise(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(C.surprise((F.col("event_id") % 7 - 2) / 20.0), 6).alias("surprise"))


@query(f"WITH {NAMED} SELECT concept, list_filter([CASE WHEN reliability < 0.74 THEN 'reliability' END, CASE WHEN doc_id % 3 > 0 THEN 'writes_without_prior_recall' END, CASE WHEN doc_id % 4 < 1 THEN 'no_recall' END], lambda x: x IS NOT NULL) AS reasons FROM c")
def scaffold_promotion(spark, sf_dir):
    return named(spark, sf_dir).select("concept", C.promotion_reasons(F.col("reliability"), F.col("doc_id") % 3, F.col("doc_id") % 4).alias("reasons"))


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'note:' || doc_id ELSE 'skill_draft:' || doc_id END AS draft FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_a_draft' WHEN doc_id % 3 = 0 THEN 'scarred' WHEN doc_id % 2 = 0 THEN 'pinned' ELSE 'promoted_pending_pin' END AS status,
      CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'scar:skill_draft_failed_' || doc_id ELSE 'receipt:skill_promote_' || doc_id END AS name FROM d"""
)
def promote_draft(spark, sf_dir):
    i = F.col("doc_id")
    draft = F.concat(F.when(i % 7 == 0, "note:").otherwise("skill_draft:"), i)
    return table(spark, sf_dir, "documents").select("doc_id", C.draft_outcome(draft, i % 3 != 0, i % 2 == 0).alias("o")).select("doc_id", "o.*")


# ---- derived rows ---------------------------------------------------------------------------


_DERIVED = "'# Scrubbed training derivative' || chr(10) || chr(10) || '**source:** ' || concept || chr(10) || '**sovereignty:** training_ok' || chr(10) || '**export_policy:** scrub_then_allow' || chr(10) || chr(10) || " + _sql_scrub("(left(body, 80) || ' me token=abc x')", T.SCRUB)


@query(f"WITH {NAMED} SELECT concept AS src, 'scrub_exported_to' AS label, 'pattern:export_' || sha256({_DERIVED})[1:16] AS dst FROM c")
def derivative_mint(spark, sf_dir):
    body = F.concat(F.substring("body", 1, 80), F.lit(" me token=abc x"))
    return C.derivatives(named(spark, sf_dir).select("concept", body.alias("body"), "reliability"))[1]


@query(f"WITH {REC} SELECT concept, 'body' || chr(10) || chr(10) || '[solid-tensor-consolidation OP_ADD p_drift=' || format('{{:.3f}}', drift) || ']' AS body, true AS promoted FROM rec WHERE drift >= 0.15")
def drift_consolidation(spark, sf_dir):
    return C.drift_notes(records(spark, sf_dir).select("concept", F.lit("body").alias("body"), "drift"))


@query(
    """WITH f AS (SELECT conv_id, turn, unnest(string_split(text, '. ')[1:3]) AS body, generate_subscripts(string_split(text, '. ')[1:3], 1) - 1 AS k FROM conversations)
    SELECT 'session:' || conv_id AS src, 'recorded' AS label, 'episodic:' || conv_id || '_' || turn || '_' || k AS dst, sha256(body) AS body FROM f"""
)
def turn_episodics(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    rows, links = C.episodics(t, F.slice(F.split("text", r"\. "), 1, 3))
    return links.join(rows, links["dst"] == rows["concept"]).select("src", "label", "dst", F.sha2("body", 256).alias("body"))


@query(
    f"""WITH {NAMED} SELECT 'primary_goal' AS src, 'documents' AS label, concept AS dst FROM c
    UNION ALL SELECT concept, 'same_file', dst FROM (SELECT concept, lead(concept) OVER (PARTITION BY source ORDER BY ts, concept) AS dst FROM c) WHERE dst IS NOT NULL"""
)
def write_relations(spark, sf_dir):
    """The edges that come with a write: from the goal, and along the items of one file."""
    n = named(spark, sf_dir)
    return C.auto_related(n).unionByName(C.glued(n.select("concept", F.col("source").alias("file"), F.col("ts").alias("start"))))


@query(f"WITH {REC}, x AS (SELECT concept, list_transform(q, lambda v, i: v + CASE WHEN i <= 16 THEN 0.25 ELSE 0.0 END) AS a, ((vec_id % 5)::INT << 24) | 3 AS version FROM rec) SELECT concept, round(a[1] / sqrt(list_dot_product(a, a)), 6) + 0.0 AS first, round(a[20] / sqrt(list_dot_product(a, a)), 6) + 0.0 AS twentieth, version FROM x")
def anchored_and_tiered(spark, sf_dir):
    a = C.anchored(F.col("q"), F.array_repeat(F.lit(0.25), 16))
    r = records(spark, sf_dir).select("concept", a.alias("a"), C.tiered(F.lit(3), F.col("vec_id") % 5).alias("version"))
    return r.select("concept", (F.round(F.get("a", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("a", F.lit(19)), 6) + 0.0).alias("twentieth"), "version")


@query("WITH r AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - (run > 0)::INT AS turns FROM r")
def sentinel_turns(spark, sf_dir):
    return C.sentinel_turns(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "turns")


@query(
    """WITH r AS (SELECT *, epoch_us(ts) AS us, sum((event_type = 'purchase')::INT) OVER w AS run, last_value(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - (run > 0)::INT AS turns, coalesce(greatest((us - last) // 60000000, 0), 0) AS minutes, least(1.0, 0.65 * least(1.0, value / 250.0) + 0.35 * (event_id % 10) / 10.0::DOUBLE) AS p FROM r),
    e AS (SELECT *, greatest(30 - round(p * 12)::INT, 8) AS most FROM t)
    SELECT event_id, turns, minutes, turns >= 30 OR minutes >= 120 AS due, CASE WHEN turns >= most AND p >= 0.5 AND turns < 30 THEN 'surprise' WHEN turns >= most THEN 'turns' WHEN minutes >= 120 THEN 'time' ELSE '' END AS nudge FROM e"""
)
def sentinel_clock(spark, sf_dir):
    """Turns and minutes since a user's last purchase, and what a session under some pressure is told."""
    out = C.sentinel_clock(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "purchase")
    p = S.pressure(F.col("value") / 250.0, F.col("event_id") % 10 / 10.0)
    return out.select("event_id", "turns", "minutes", "due", S.nudge(F.col("turns"), F.col("minutes"), p).alias("nudge"))


@query(
    """WITH c AS (SELECT 'customer:' || c_custkey AS concept FROM customer), h AS (SELECT concept, list_reduce(list_prepend(((3::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT)::HUGEINT, list_transform(string_split(concept, ''), lambda x: ascii(x)::HUGEINT)),
      lambda s, b: (s * 1099511628211::HUGEINT + b) % 18446744073709551616::HUGEINT) AS h FROM c)
    SELECT concept, round(sin((h % 628)::DOUBLE / 100 - pi() / 2) * 0.88, 6) AS lat, round(((h // 65536) % 628)::DOUBLE / 100 * 2 * pi() - pi(), 6) AS lng FROM h"""
)
def concept_places(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"))
    at = c.select("concept", C.place(F.col("concept"), 3).alias("p"))
    return at.select("concept", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


# ---- parsing --------------------------------------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tile:a-' || doc_id WHEN 1 THEN 'design:b_' || doc_id END AS pin, 'scout__' || doc_id || '__' || left(trim(regexp_replace(lower(source || '  ?' || lang), '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), 40) AS key, '--- etymology @ ' || doc_id || ' ---' || chr(10) || 'etymology: ' || lang AS segment FROM documents")
def names_from_text(spark, sf_dir):
    i = F.col("doc_id")
    q = F.when(i % 4 == 0, F.concat(F.lit("(tile:a-"), i, F.lit(") please"))).when(i % 4 == 1, F.concat(F.lit("see, design:b_"), i, F.lit("; tile:z"))).otherwise("nothing here")
    return table(spark, sf_dir, "documents").select("doc_id", C.pin_token(q).alias("pin"), C.scout_key(F.concat("source", F.lit("  ?"), "lang"), i).alias("key"), C.etymology(F.col("lang"), i).alias("segment"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '{"n": ' || (doc_id + 1) || '}' END AS packet, CASE WHEN doc_id % 2 = 0 THEN '{"version": "rehydration_manifest_v1", "metamemory": {"recalls": ' || doc_id || '}}' END AS manifest, CASE WHEN doc_id % 2 = 0 THEN '{"recalls":' || doc_id || '}' END AS metrics,
      CASE doc_id % 4 WHEN 0 THEN 'go on ' || doc_id WHEN 1 THEN 'step ' || doc_id WHEN 2 THEN 'then ' || doc_id END AS next FROM documents"""
)
def handoff_parsing(spark, sf_dir):
    i = F.col("doc_id")
    body = F.when(i % 4 == 3, "no packet").otherwise(F.concat(F.lit('SESSION HANDOFF PACKET {"n": '), i, F.lit('} x SESSION HANDOFF PACKET {"n": '), i + 1, F.lit("} tail")))
    man = F.when(i % 2 == 0, F.concat(F.lit('M {"version": "rehydration_manifest_v1", "metamemory": {"recalls": '), i, F.lit("}} end"))).otherwise('{"version": "other"}')
    told = F.when(i % 4 == 0, F.concat(F.lit('x "next_vector": "go on '), i, F.lit('", y'))).when(i % 4 == 1, F.concat(F.lit("a\n### next_vector\n\n- step "), i, F.lit("\nb"))).when(i % 4 == 2, F.concat(F.lit("a\n- **next_vector:** then "), i, F.lit("\nb"))).otherwise("accepts **next_vector:**, JSON")
    return table(spark, sf_dir, "documents").select("doc_id", C.packet(body).alias("packet"), C.rehydration(man).alias("manifest"), C.embedded_metrics(man).alias("metrics"), C.next_vector(told).alias("next"))


@query(f"WITH {EDGES}, sl AS (SELECT 'customer:' || c_custkey AS slot FROM customer ORDER BY c_custkey LIMIT 16), r AS (SELECT slot, label, dst AS other, row_number() OVER (PARTITION BY slot ORDER BY label, dst) AS k FROM (SELECT dst AS src, label, src AS dst FROM edges) x JOIN sl ON src = slot) SELECT slot, label, other FROM r WHERE k <= 8")
def context_relations(spark, sf_dir):
    back = edges(spark, sf_dir).select(F.col("dst").alias("src"), "label", F.col("src").alias("dst"))
    slots = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("slot"), F.col("c_custkey").alias("rank"))
    return C.few_neighbours(back, slots)


@query("SELECT event_id, user_id FROM events WHERE event_type NOT IN ('click', 'error')")
def actions_without_tools(spark, sf_dir):
    a = table(spark, sf_dir, "events").withColumnRenamed("event_type", "tool")
    return C.without_tools(a, ["click", "error"]).select("event_id", "user_id")


@query("WITH m AS (SELECT o_custkey, map_from_entries(list((o_orderpriority, n) ORDER BY o_orderpriority)) AS m FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey) SELECT o_custkey, list_sort(map_keys(m)) AS keys, list_sum(map_values(m))::BIGINT AS n, coalesce(m['1-URGENT'], 0) AS urgent FROM m")
def map_functions(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    m = g.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))  # five priorities at most
    return m.select("o_custkey", F.array_sort(F.map_keys("m")).alias("keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.coalesce(F.try_element_at("m", F.lit("1-URGENT")), F.lit(0)).alias("urgent"))


# ---- lists of a report ----------------------------------------------------------------------

_UNC = "un AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'uncertainty:d' || doc_id ELSE concept END AS concept, reliability, ts FROM c)"


def _doubted(spark, sf_dir):
    return named(spark, sf_dir).withColumn("concept", F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("uncertainty:d"), "doc_id")).otherwise(F.col("concept")))


@query(
    f"""WITH {NAMED}, {_UNC}, l AS (SELECT concept, ts FROM un WHERE doc_id % 3 = 0 ORDER BY ts DESC, concept LIMIT 200), o AS (SELECT * FROM un WHERE starts_with(concept, 'uncertainty:')),
    x AS (SELECT concept, reliability, 0 AS source, -l.ts::DOUBLE AS k FROM o JOIN l USING (concept) UNION ALL SELECT concept, reliability, 1, -(doc_id % 89)::DOUBLE FROM o WHERE doc_id % 2 = 1),
    f AS (SELECT concept, reliability, source, k, row_number() OVER (PARTITION BY concept ORDER BY source, k) AS r FROM x) SELECT concept, reliability, source FROM f WHERE r = 1 ORDER BY source, k, concept LIMIT 30"""
)
def uncertainty_receipts(spark, sf_dir):
    d = _doubted(spark, sf_dir)
    near = d.where("doc_id % 2 = 1").select("concept", (F.col("doc_id") % 89).alias("score"))
    return C.uncertainty_receipts(d.select("concept", "reliability"), d.where("doc_id % 3 = 0").select("concept", "ts"), near, 30)


@query(f"WITH {NAMED}, l AS (SELECT concept, ts FROM c ORDER BY ts DESC, concept LIMIT 25), k AS (SELECT *, CASE WHEN starts_with(concept, 'tile:') THEN 'tiles' WHEN starts_with(concept, 'trace:') THEN 'traces' WHEN starts_with(concept, 'goal:') THEN 'goals' END AS kind FROM l) SELECT kind, list(concept ORDER BY ts DESC, concept) AS concepts FROM k WHERE kind IS NOT NULL GROUP BY kind")
def active_groups(spark, sf_dir):
    n = named(spark, sf_dir)
    return C.active_groups(n, n.select("concept", "ts"))


@query(f"WITH {NAMED}, h AS (SELECT concept, CASE WHEN starts_with(concept, 'trace:') THEN 'trace' ELSE 'item' END AS kind, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source || '.py' END AS file, doc_id % 500 AS line, ts FROM c WHERE doc_id % 10 IN (1, 8)) SELECT * FROM h WHERE file <> '' ORDER BY ts DESC, concept LIMIT 24")
def spatial_hotspots(spark, sf_dir):
    n = named(spark, sf_dir).withColumn("file", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat("source", F.lit(".py")))).withColumn("line", F.col("doc_id") % 500)
    pick = lambda k: n.where(F.col("doc_id") % 10 == k).select("concept", "ts", "file", "line")
    return C.hotspots(pick(1), pick(8))


@query(f"""WITH {NAMED} SELECT '{{"concept":"' || concept || '","ts":' || ts || '}}' AS json FROM c""")
def rows_as_json(spark, sf_dir):
    return C.as_json(named(spark, sf_dir), "concept", "ts")


@query("SELECT 'pointer:' || regexp_replace(lower(left(string_split(url, '/')[-1], 48)), '[^a-z0-9-]', '-', 'g') AS concept, 'EXTERNAL_POINTER_V1' || chr(10) || 'uri: ' || url || chr(10) || 'content_hash: sha256:' || sha256(html) || chr(10) || 'size_bytes: ' || strlen(html) || chr(10) || 'metadata: {}' || chr(10) AS body, 0.91::DOUBLE AS reliability FROM pages")
def external_pointers(spark, sf_dir):
    p = C.external_pointer(F.col("url"), F.concat(F.lit("sha256:"), F.sha2("html", 256)), F.octet_length("html"), F.lit(""))
    return table(spark, sf_dir, "pages").select(p.alias("p")).select("p.concept", "p.body", F.col("p.reliability").cast("double").alias("reliability"))


# ---- words ----------------------------------------------------------------------------------


@query(
    f"""WITH {REC}, s2 AS (SELECT vec_id, list_transform(range(1, 65), lambda i: atan2(q[65 - i], q[i]) * (i - 1) + sqrt(q[i] * q[i] + q[65 - i] * q[65 - i])) AS p FROM rec)
    SELECT vec_id, round(cos(p[1]) / 8, 6) + 0.0 AS re_first, round(sin(p[64]) / 8, 6) + 0.0 AS im_last FROM s2"""
)
def vec_symbolic(spark, sf_dir):
    z = C.symbolic(V.Z(F.col("q"), F.reverse("q")))
    return records(spark, sf_dir).select("vec_id", (F.round(F.get(z.re, F.lit(0)), 6) + 0.0).alias("re_first"), (F.round(F.get(z.im, F.lit(63)), 6) + 0.0).alias("im_last"))


_WORDS = f"""w AS (SELECT item_id, unnest(string_split(text, ' ')[1:6]) AS w, generate_subscripts(string_split(text, ' ')[1:6], 1) AS k FROM benchmark),
    x AS (SELECT item_id, i, (k % 5 + i) / 10.0::DOUBLE AS c, ('0x' || md5(w || '#' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS a FROM w, range({_D}) t(i)),
    s AS (SELECT item_id, i, sum(c * cos(a) * 0.5) AS re, sum(c * sin(a) * 0.5) AS im FROM x GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(re * re + im * im)) AS n FROM s GROUP BY item_id)"""


@query(f"WITH {_WORDS}, v AS (SELECT item_id, list(re / n ORDER BY i) || list(im / n ORDER BY i) AS v FROM s JOIN n USING (item_id) GROUP BY item_id), f AS (SELECT v AS f FROM v WHERE item_id = (SELECT min(item_id) FROM benchmark)) SELECT item_id, round(v[1], 6) + 0.0 AS first, round(list_dot_product(v, f), 6) + 0.0 AS equivalence FROM v, f")
def word_compression(spark, sf_dir):
    """Bundles of words as one vector, and how far each says the same as the first."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.slice(F.split("text", " "), 1, 6)).alias("k", "w"))
    at = F.sequence(F.lit(0), F.lit(_D - 1))
    ws = b.select("item_id", F.transform(at, lambda i: ((F.col("k") + 1) % 5 + i) / 10.0).alias("c"), F.transform(at, lambda i: F.cos(E.lane(F.col("w"), i))).alias("re"), F.transform(at, lambda i: F.sin(E.lane(F.col("w"), i))).alias("im"))
    v = C.compressed(ws, "item_id", "c", "re", "im")
    first = v.orderBy("item_id").limit(1).select(F.col("re").alias("fr"), F.col("im").alias("fi"))
    e = C.equivalence(V.Z(F.col("re"), F.col("im")), V.Z(F.col("fr"), F.col("fi")))
    return v.crossJoin(F.broadcast(first)).select("item_id", (F.round(F.get("re", F.lit(0)), 6) + 0.0).alias("first"), (F.round(e, 6) + 0.0).alias("equivalence"))


@query(f"WITH a AS (SELECT doc_id, i, ('0x' || md5(lang || '#' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS x, ('0x' || md5(source || '#' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS y, ('0x' || md5('note' || '#' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS z FROM documents, range({_D}) t(i)) SELECT doc_id, round(max(CASE WHEN i = 0 THEN cos(x + y + z) END) / sqrt({_D}), 6) + 0.0 AS first, 1.0::DOUBLE AS recovered FROM a GROUP BY doc_id")
def lexicon_bind(spark, sf_dir):
    """Word, definition and note on the unit circle, bound; unbinding word and note gives the definition back."""
    at = F.sequence(F.lit(0), F.lit(_D - 1))
    phase = lambda t: V.Z(F.transform(at, lambda i: F.cos(E.lane(t, i))), F.transform(at, lambda i: F.sin(E.lane(t, i))))
    w, d, n = phase(F.col("lang")), phase(F.col("source")), phase(F.lit("note"))
    z = C.lexicon_entry(w, d, n)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    # each word and definition is bound once, however many documents have them
    rows = docs.select("lang", "source").distinct().select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[x.alias(k) for k, x in (("zr", z.re), ("zi", z.im), ("wr", w.re), ("wi", w.im), ("dr", d.re), ("di", d.im), ("nr", n.re), ("ni", n.im))])
    c = lambda k: V.Z(F.col(f"{k}r"), F.col(f"{k}i"))
    back = V.zunit(V.product(V.product(c("z"), V.conjugate(c("w"))), V.conjugate(c("n"))))
    own = V.zunit(c("d"))
    bound = cut(rows.select("_l", "_s", (F.round(F.get("zr", F.lit(0)), 6) + 0.0).alias("first"), F.round(C.equivalence(back, own), 6).alias("recovered")), "bound")
    return docs.join(bound, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").select("doc_id", "first", "recovered")


@query("SELECT 'w' || c_custkey AS word, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'old' || chr(10) || c_mktsegment WHEN c_custkey % 2 = 0 THEN 'old' ELSE c_mktsegment END AS body, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'updated' WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'minted' END AS status FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def lexicon_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("word", F.concat(F.lit("w"), "c_custkey"))
    return C.lexicon_upsert(c.where("c_custkey % 2 = 0").select("word", F.lit("old").alias("body")), c.where("c_custkey % 3 = 0").select("word", F.col("c_mktsegment").alias("body")))
