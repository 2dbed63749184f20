"""Reports over named records derived from the documents, and the graph of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import integrity as I
from ..operators import reports as P
from ..operators import structured as Q
from ..sources.tables import edges, table
from .graph_queries import EDGES
from .registry import query

_PRE = ["goal:", "trace:", "tile:", "helper:", "praxis:", "scar:", "metric:", "local:", "design:", ""]
NAMED = f""" c AS (SELECT doc_id, {_PRE}[doc_id % 10 + 1] || 'd' || doc_id AS concept, (doc_id * 31 % 100) / 100.0::DOUBLE AS reliability, doc_id * 7919 % 100000 AS ts, source, text AS body FROM documents)"""
SERVES = " sv AS (SELECT concept AS src, 'serves' AS label, 'goal:d' || (doc_id // 100 * 100) AS dst FROM c WHERE doc_id % 10 = 1)"


def named(spark, sf_dir):
    i = F.col("doc_id")
    pre = F.get(F.array(*map(F.lit, _PRE)), (i % 10).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(pre, F.lit("d"), i).alias("concept"), (i * 31 % 100 / 100.0).alias("reliability"), (i * 7919 % 100000).alias("ts"), "source", F.col("text").alias("body"))


def serves(spark, sf_dir):
    i = F.col("doc_id")
    return named(spark, sf_dir).where("doc_id % 10 = 1").select(F.col("concept").alias("src"), F.lit("serves").alias("label"), F.concat(F.lit("goal:d"), F.floor(i / 100) * 100).alias("dst"))


@query(
    f"""WITH {NAMED} SELECT concept, CASE doc_id % 10 WHEN 2 THEN 'tile' WHEN 1 THEN 'trace' WHEN 0 THEN 'goal' ELSE 'memory' END AS kind, CASE doc_id % 10 WHEN 1 THEN 'trace' WHEN 2 THEN 'tile' WHEN 4 THEN 'praxis' WHEN 5 THEN 'dead_end' ELSE 'other' END AS category,
    doc_id % 10 IN (2, 8) AS tensor, CASE WHEN doc_id % 10 = 9 THEN 'tensor:' || concept ELSE concept END AS name, doc_id % 10 NOT IN (6, 9) AS surface, [0, 1, 2, 3, 3, 2, 5, 6, 3, 3][doc_id % 10 + 1] AS distance, doc_id % 10 IN (0, 1, 2) AS valued FROM c"""
)
def name_classes(spark, sf_dir):
    c = F.col("concept")
    return named(spark, sf_dir).select("concept", P.node_kind(c).alias("kind"), P.category(c).alias("category"), P.tensor_eligible(c).alias("tensor"), P.tensor_name(c).alias("name"), Q.surface(c).alias("surface"), S.goal_distance(c).alias("distance"), P.high_value(c).alias("valued"))


@query(f"WITH {NAMED}, t AS (SELECT *, ['verified_sequence', 'state_machine', 'formal_spec', 'chain_summary', 'other'][doc_id // 10 % 5 + 1] AS type, doc_id // 10 % 5 AS r FROM c) SELECT concept, type, reliability FROM t WHERE doc_id % 10 = 2 AND reliability >= 0.85 AND r < 4 ORDER BY r, doc_id DESC, reliability DESC, concept LIMIT 6")
def trusted_ranking(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, ["verified_sequence", "state_machine", "formal_spec", "chain_summary", "other"])), (F.floor(F.col("doc_id") / 10) % 5).cast("int"))
    return P.trusted_summaries(named(spark, sf_dir).withColumn("type", t))


@query(
    f"""WITH {NAMED}, u AS (SELECT concept, ts, 0 AS source FROM c WHERE starts_with(concept, 'scar:') AND reliability >= 0.5 UNION ALL SELECT concept, ts, 1 FROM c WHERE reliability >= 0.9 UNION ALL SELECT concept, ts, 2 FROM c WHERE starts_with(concept, 'helper:')),
    m AS (SELECT concept, min(source) AS source, max(ts) AS ts FROM u GROUP BY concept) SELECT concept, source, ts FROM m ORDER BY source, ts DESC, concept LIMIT 40"""
)
def anchors_prioritised(spark, sf_dir):
    c = named(spark, sf_dir)
    return P.prioritised([c.where(F.col("concept").startswith("scar:") & (F.col("reliability") >= 0.5)), c.where("reliability >= 0.9"), c.where(F.col("concept").startswith("helper:"))], 40)


@query(f"WITH {NAMED}, {SERVES} SELECT concept, reliability FROM c WHERE concept IN (SELECT src FROM sv WHERE dst = 'goal:d100') ORDER BY reliability DESC, concept LIMIT 5")
def goal_serving_topk(spark, sf_dir):
    return P.serving(named(spark, sf_dir).select("concept", "reliability"), serves(spark, sf_dir), "goal:d100", 5)


@query(f"WITH {NAMED}, {SERVES}, n AS (SELECT dst AS goal, count(*) AS n FROM sv GROUP BY dst HAVING count(*) >= 6) SELECT goal, n FROM n WHERE goal NOT IN (SELECT 'goal:d' || (doc_id // 100 * 100) FROM c WHERE starts_with(concept, 'tile:') AND reliability > 0.95)")
def condensation_hint(spark, sf_dir):
    done = named(spark, sf_dir).where("concept like 'tile:%' and reliability > 0.95").select(F.concat(F.lit("goal:d"), F.floor(F.col("doc_id") / 100) * 100).alias("goal"))
    return P.condensation_due(serves(spark, sf_dir), done)


@query(f"WITH {NAMED} SELECT concept, ts FROM c ORDER BY (doc_id % 10 IN (0, 1, 2))::INT DESC, ts DESC, concept LIMIT 30")
def recent_valued(spark, sf_dir):
    return P.curated(named(spark, sf_dir).select("concept", "ts"), 30)


@query(f"WITH {NAMED} SELECT concept, round((1 - reliability) * 0.45 + least(ts / 86400.0, 1.0) * 0.35 + [0, 1, 2, 3, 3, 2, 5, 6, 3, 3][doc_id % 10 + 1] / 10.0 * 0.20, 6) AS priority FROM c ORDER BY priority DESC, concept LIMIT 32")
def hot_set_compression(spark, sf_dir):
    p = S.demote_priority(F.col("reliability"), F.col("ts"), S.goal_distance(F.col("concept")))
    return P.demoted(named(spark, sf_dir).select("concept", "reliability", "ts"), p, 32).select("concept", "priority")


@query(
    f"""WITH {EDGES}, n AS (SELECT 'nation:' || n_nationkey AS concept FROM nation),
    o AS (SELECT src AS concept, count(*) AS n_out, list_sort(list(label || '>' || dst)) AS "out" FROM edges GROUP BY src), i0 AS (SELECT dst AS concept, label, src, row_number() OVER (PARTITION BY dst ORDER BY label, src) AS r FROM edges),
    i AS (SELECT concept, count(*) AS n_in, list_sort(list(label || '>' || src) FILTER (WHERE r <= 5)) AS "in" FROM i0 GROUP BY concept)
    SELECT concept, coalesce(n_out, 0) AS n_out, coalesce("out", []) AS "out", coalesce(n_in, 0) AS n_in, coalesce("in", []) AS "in" FROM n LEFT JOIN o USING (concept) LEFT JOIN i USING (concept)"""
)
def record_detail(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("concept"))
    return P.detail(n, edges(spark, sf_dir))


_SP = " s AS (SELECT 'f' || p_partkey % 20 AS path, 'item:' || p_partkey AS concept, p_partkey % 300 AS lo, p_partkey % 300 + p_size AS hi FROM part), w AS (SELECT 'f' || s_suppkey % 20 AS path, s_suppkey AS wid, s_suppkey * 7 % 300 AS first, s_suppkey * 7 % 300 + 10 AS last FROM supplier)"


@query(f"WITH {_SP} SELECT wid, concept, min(CASE WHEN lo <= last AND hi >= first THEN 0 ELSE 1 END) AS tier FROM s JOIN w USING (path) GROUP BY wid, concept")
def locus_tiers(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    spans = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k % 20).alias("path"), F.concat(F.lit("item:"), k).alias("concept"), (k % 300).alias("lo"), (k % 300 + F.col("p_size")).alias("hi"))
    windows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), s % 20).alias("path"), s.alias("wid"), (s * 7 % 300).alias("first"), (s * 7 % 300 + 10).alias("last"))
    return P.locus_tiers(spans, windows)


@query(f"WITH {NAMED} SELECT concept, CASE WHEN contains(body, 'und') THEN 'src/und' WHEN contains(body, 'tion') THEN 'lib/tion' END AS file FROM c WHERE contains(body, 'und') OR contains(body, 'tion')")
def file_mentions(spark, sf_dir):
    return P.mentions(named(spark, sf_dir), ["src/und", "lib/tion"])


@query(f"WITH {NAMED} SELECT concept FROM c WHERE contains(lower(body), 'licensed under') ORDER BY concept LIMIT 50")
def text_containing(spark, sf_dir):
    return P.containing(named(spark, sf_dir), "Licensed under", 50).select("concept")


@query(
    f"""WITH {NAMED}, i AS (SELECT concept, list_filter([CASE WHEN reliability < 0.5 THEN 'unreliable' END, CASE WHEN doc_id % 7 = 0 THEN 'unsigned' END, CASE WHEN doc_id % 3 = 0 THEN 'no_predecessor' END], lambda x: x IS NOT NULL) AS issues FROM c) SELECT * FROM i"""
)
def edit_lineage(spark, sf_dir):
    c = named(spark, sf_dir)
    t = c.select("concept", "reliability", F.when(F.col("doc_id") % 7 != 0, F.sha2("body", 256)).alias("digest"))
    e = c.where("doc_id % 3 <> 0").select(F.col("concept").alias("src"), F.lit("prev_in_trace").alias("label"), F.lit("x").alias("dst"))
    return P.lineage_issues(t, e, 0.5)


@query(
    f"""WITH {NAMED}, a AS (SELECT concept, 0 AS k, reliability, body[1:20] AS preview FROM c WHERE reliability >= 0.74), b AS (SELECT concept, 1 AS k, reliability, '' AS preview FROM c WHERE starts_with(concept, 'goal:')),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT concept, arg_min(reliability, k) AS reliability, arg_min(preview, k) AS preview FROM u GROUP BY concept) SELECT concept, reliability, preview FROM m"""
)
def context_view_merge(spark, sf_dir):
    c = named(spark, sf_dir)
    a = c.where("reliability >= 0.74").select("concept", "reliability", F.substring("body", 1, 20).alias("preview"))
    b = c.where(F.col("concept").startswith("goal:")).select("concept", "reliability", F.lit("").alias("preview"))
    return P.merged_views([a, b])


@query(f"WITH {NAMED} SELECT count(*) AS n, round(least(max(reliability), 0.99), 6) AS reliability FROM c")
def context_view_reliability(spark, sf_dir):
    return P.view_reliability(named(spark, sf_dir))


@query(
    """WITH h AS (SELECT user_id AS head, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS depth, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type || event_id END AS body FROM events),
    k AS (SELECT * FROM h WHERE depth < 16 AND trim(body) <> ''), g AS (SELECT head, count(*)::INT AS n, list(body ORDER BY depth DESC) AS steps FROM k GROUP BY head)
    SELECT head, n, CASE WHEN n >= 4 THEN 'verified_sequence' WHEN n >= 2 THEN 'state_machine' ELSE 'research_offload' END AS kind, steps FROM g"""
)
def draft_from_chain(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("head"), (F.row_number().over(w) - 1).alias("depth"), F.when(F.col("event_type") == "view", " ").otherwise(F.concat("event_type", "event_id")).alias("body"))
    return P.chain_drafts(e)


@query(
    f"""WITH {NAMED}, t AS (SELECT concept, 'tensor:' || doc_id AS twin, CASE WHEN doc_id % 20 = 2 THEN 'goal:d0' END AS goal FROM c WHERE doc_id % 10 = 2)
    SELECT concept AS src, 'mirrors' AS label, twin AS dst FROM t UNION ALL SELECT twin, 'mirrored_by', concept FROM t UNION ALL SELECT concept, 'serves', goal FROM t WHERE goal IS NOT NULL UNION ALL SELECT concept, 'in_file', 'file:a' FROM t UNION ALL SELECT concept, 'refers_to', 'tile:b' FROM t"""
)
def mirror_bonds(spark, sf_dir):
    i = F.col("doc_id")
    t = named(spark, sf_dir).where("doc_id % 10 = 2").select("concept", F.concat(F.lit("tensor:"), i).alias("twin"), F.when(i % 20 == 2, "goal:d0").alias("goal"), F.array(F.lit("file:a"), F.lit("tile:b")).alias("refs"))
    return P.mirror_edges(t)


@query(f"WITH {NAMED} SELECT 'pillar:' || n AS concept FROM range(6) t(n) UNION ALL SELECT 'goal:new'")
def reference_frame_insert(spark, sf_dir):
    new = spark.range(6).select(F.concat(F.lit("pillar:"), "id").alias("concept")).union(spark.sql("SELECT 'goal:new' UNION ALL SELECT 'goal:d0'"))
    return P.inserted(named(spark, sf_dir), new)


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, 'filled') AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END FROM customer WHERE c_custkey % 2 = 1")
def turn_enrichment(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return P.enriched(t, t.where(k % 2 == 0).select("c_custkey", F.lit("filled").alias("c_mktsegment")), "c_custkey")


@query(f"WITH {NAMED} SELECT count(*) AS checked, sum((reliability >= 0.74)::INT)::BIGINT AS passed, sum((reliability < 0.74)::INT)::BIGINT AS failed, round(avg(reliability), 6) AS mean FROM c WHERE doc_id % 10 IN (4, 2)")
def corpus_homotopy(spark, sf_dir):
    return P.export_audit(named(spark, sf_dir).where("doc_id % 10 in (4, 2)").select(F.col("reliability").alias("coherence")))


@query(
    """WITH t AS (SELECT conv_id, turn, lower(text) AS l FROM conversations)
    SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(l, 'remember|recall|memory') THEN 'recall' END, CASE WHEN regexp_matches(l, 'edit|change|fix') THEN 'edit' END, CASE WHEN regexp_matches(l, 'test|verify|check') THEN 'test' END, CASE WHEN regexp_matches(l, 'find|search|where') THEN 'search' END], lambda x: x IS NOT NULL) AS hints,
    CASE WHEN regexp_matches(l, 'bug|error|fix') THEN 'debug' WHEN regexp_matches(l, 'design|plan|architecture') THEN 'design' WHEN regexp_matches(l, 'paper|study|compare') THEN 'research' ELSE 'general' END AS task FROM t"""
)
def turn_hints(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.tool_hints(t).alias("hints"), P.task_kind(t).alias("task"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ['not_json'] WHEN event_id % 5 = 1 THEN ['missing_k'] ELSE ['missing_name'] END AS issues FROM events")
def payload_validators(spark, sf_dir):
    i = F.col("event_id")
    body = F.when(i % 5 == 0, "nope{").when(i % 5 == 1, '{"k": "", "name": "x"}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", P.payload_issues(body, ["k", "name"]).alias("issues"))


@query(
    """WITH b AS (SELECT doc_id, [{'text': lang, 'coeff': [0.1, 0.2]}, {'text': source, 'coeff': [0.3, 0.4]}] AS w FROM documents)
    SELECT doc_id, list_transform(w, lambda x: 'd(' || x.text || ')') AS texts, round(w[1].coeff[1] * 0.618034 - 0.05, 6)::DOUBLE AS first, 4 AS joined, [1000] AS glue, ['sum', 'wrap'] AS steps FROM b"""
)
def word_bundles(spark, sf_dir):
    word = lambda c, a, b: F.struct(F.col(c).alias("text"), F.array(F.lit(a), F.lit(b)).alias("coeff"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(word("lang", 0.1, 0.2), word("source", 0.3, 0.4)).alias("w"))
    two = F.array(F.struct(F.col("w").alias("words")), F.struct(F.col("w").alias("words")))
    x = d.select("doc_id", P.differentiated(F.col("w")).alias("d"), P.integrated(two).alias("i"), P.composed(two, F.array(F.lit("sum"), F.lit("wrap"))).alias("c"))
    return x.select("doc_id", F.transform("d", lambda w: w["text"]).alias("texts"), F.round(x["d"][0]["coeff"][0], 6).alias("first"), F.size("i.words").alias("joined"), F.col("i.patches").alias("glue"), F.transform("c.patches", lambda p: p["morphism"]).alias("steps"))


@query(
    f"""WITH {NAMED} SELECT concept, sha256('1|' || CASE WHEN doc_id % 2 = 0 THEN '1|bind|add' ELSE '1|shift' END || '|' || printf('%.4f', reliability) || '|bind') AS attested, CASE WHEN doc_id % 2 = 0 THEN 'bound' ELSE 'kept' END AS result FROM c"""
)
def guarded_operations(spark, sf_dir):
    contract = F.when(F.col("doc_id") % 2 == 0, "1|bind|add").otherwise("1|shift")
    return named(spark, sf_dir).select("concept", P.attestation(F.lit(1), contract, F.col("reliability"), "bind").alias("attested"), P.guarded(I.allowed(contract, "bind"), F.lit("bound"), F.lit("kept")).alias("result"))


@query(
    """SELECT event_id, CASE WHEN value < 60 THEN floor(value)::BIGINT || 's ago' WHEN value < 3600 THEN floor(value / 60)::BIGINT || 'm ago' ELSE floor(value / 3600)::BIGINT || 'h ago' END AS age, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
    CASE WHEN value / 100 < 0.05 THEN 'converging' WHEN value / 100 < 0.15 THEN 'drifting' ELSE 'volatile' END AS label FROM events"""
)
def time_labels(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", T.age_label(F.when(v < 60, F.floor(v)).otherwise(v.cast("long"))).alias("age"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), P.drift_label(v / 100).alias("label"))


@query("WITH d AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, CASE WHEN len(v) < 2 OR abs(v[-2] - v[-1]) < 1e-9 THEN 'stable' WHEN v[-1] < v[-2] THEN 'converging' ELSE 'in_flux' END AS arc FROM d")
def arc_stability(spark, sf_dir):
    """Of each key the last two values, by a rank in its own window; histories are not gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 2")
    g = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), "value"))).alias("xs"))
    return g.select("user_id", P.arc_stability(F.transform("xs", lambda x: x["value"])).alias("arc"))
