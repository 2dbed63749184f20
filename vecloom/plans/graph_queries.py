"""Relation lookups, walks, bounded subgraphs and graph health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as G
from ..operators import structured as Q
from ..sources.tables import edges, nodes, table
from .registry import query

EDGES = """ edges AS (
  SELECT 'order:' || o_orderkey AS src, 'placed_by' AS label, 'customer:' || o_custkey AS dst, 0.7::DOUBLE AS volatility FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 0.12 FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, 0.12 FROM nation)"""
NODES = """ nodes AS (SELECT 'order:' || o_orderkey AS concept, false AS flagged FROM orders UNION ALL SELECT 'customer:' || c_custkey, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, false FROM nation UNION ALL SELECT 'region:' || r_regionkey, false FROM region)"""


def _seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "concept string")


@query(f"WITH {EDGES} SELECT src AS concept, label, dst AS other, volatility FROM edges WHERE src IN ('customer:1', 'nation:3', 'order:1')")
def edges_out(spark, sf_dir):
    return G.neighbours(edges(spark, sf_dir), _seeds(spark, "customer:1", "nation:3", "order:1"), "out")


@query(f"WITH {EDGES} SELECT dst AS concept, label, src AS other, volatility FROM edges WHERE dst IN ('customer:1', 'nation:3')")
def edges_in(spark, sf_dir):
    return G.neighbours(edges(spark, sf_dir), _seeds(spark, "customer:1", "nation:3"), "in")


@query(f"WITH {EDGES} SELECT src AS concept, label, dst AS other, volatility FROM edges WHERE src = 'customer:1' UNION ALL SELECT dst, label, src, volatility FROM edges WHERE dst = 'customer:1'")
def edges_both(spark, sf_dir):
    return G.neighbours(edges(spark, sf_dir), _seeds(spark, "customer:1"), "both")


@query(f"WITH {EDGES} SELECT 'customer:' || c_custkey AS concept, c_mktsegment FROM customer WHERE 'customer:' || c_custkey IN (SELECT dst FROM edges WHERE label = 'placed_by')")
def edges_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"), "c_mktsegment")
    return G.connected(c, edges(spark, sf_dir), "placed_by", "dst")


@query(f"WITH {EDGES}, {NODES} SELECT concept FROM nodes WHERE concept NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)")
def edges_anti(spark, sf_dir):
    return G.unconnected(nodes(spark, sf_dir).select("concept"), edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT concept, count(*) AS degree FROM (SELECT src AS concept FROM edges UNION ALL SELECT dst FROM edges) GROUP BY concept")
def edges_degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query(
    f"""WITH {EDGES}, {NODES}, d AS (SELECT concept, count(*) AS degree FROM (SELECT src AS concept FROM edges UNION ALL SELECT dst FROM edges) GROUP BY concept),
    n AS (SELECT count(*) AS nodes, sum(CASE WHEN degree IS NULL THEN 1 ELSE 0 END) AS orphans, sum(flagged::INT) AS flagged FROM nodes LEFT JOIN d USING (concept)),
    h AS (SELECT degree, concept AS hub FROM d ORDER BY degree DESC, concept DESC LIMIT 1), e AS (SELECT count(*) AS edges FROM edges),
    t AS (SELECT nodes, edges, orphans::BIGINT AS orphans, round(orphans / nodes, 6) AS orphan_rate, hub, degree AS hub_degree, round(degree / edges, 6) AS hub_dominance, round(flagged / nodes, 6) AS flagged_density FROM n, h, e)
    SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN orphan_rate > 0.4 THEN 'relate_orphans' END, CASE WHEN hub_dominance > 0.25 THEN 'fan_out_hub' END, CASE WHEN flagged_density > 0.15 THEN 'review_flagged' END), ''), 'nominal') AS suggestions FROM t"""
)
def topology_health(spark, sf_dir):
    return G.topology(nodes(spark, sf_dir), edges(spark, sf_dir))


_BFS = f"WITH RECURSIVE {EDGES}, w(concept, cost) AS (SELECT 'region:1', 0.0::DOUBLE UNION SELECT src, cost + {{hop}} FROM w JOIN edges ON dst = concept WHERE cost + {{hop}} <= {{budget}}) SELECT concept, round(min(cost), 6) AS cost FROM w GROUP BY concept"


@query(_BFS.format(hop="1", budget="2"))
def bfs_depth(spark, sf_dir):
    return G.expand(edges(spark, sf_dir), _seeds(spark, "region:1"), 2.0, weighted=False)


@query(_BFS.format(hop="(1 + volatility)", budget="4"))
def expand_budgeted(spark, sf_dir):
    return G.expand(edges(spark, sf_dir), _seeds(spark, "region:1"), 4.0).withColumn("cost", F.round("cost", 6))


_CHAIN = " links AS (SELECT event_id AS concept, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events), l AS (SELECT * FROM links WHERE previous IS NOT NULL)"


def _links(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_id").alias("concept"), F.lag("event_id").over(w).alias("previous")).where("previous is not null")


_TIPS = "tips AS (SELECT concept FROM l WHERE concept NOT IN (SELECT previous FROM l))"


@query(f"WITH {_CHAIN}, {_TIPS} SELECT concept FROM tips")
def chain_tip(spark, sf_dir):
    return G.chain_tips(_links(spark, sf_dir))


@query(f"WITH RECURSIVE {_CHAIN}, {_TIPS}, w(head, node, depth) AS (SELECT concept, concept, 0 FROM tips UNION ALL SELECT head, previous, depth + 1 FROM w JOIN l ON l.concept = w.node WHERE depth + 1 < 48) SELECT head, node, depth FROM w")
def trace_chain_walk(spark, sf_dir):
    links = G.settle(_links(spark, sf_dir))
    return G.walk(links, G.chain_tips(links), 48).withColumnRenamed("at", "node")


@query(f"WITH {EDGES}, k AS (SELECT 'customer:' || c_custkey AS concept FROM customer ORDER BY c_acctbal DESC, concept LIMIT 9), a AS (SELECT concept FROM k UNION ALL SELECT 'nation:' || n FROM range(3) t(n)) SELECT src, label, dst, volatility FROM edges WHERE src IN (SELECT concept FROM a) AND dst IN (SELECT concept FROM a) ORDER BY src, label, dst LIMIT 32")
def subgraph_bounded(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), F.concat(F.lit("customer:"), "c_custkey")).limit(9)
    entries = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"), F.lit(1).alias("rank")).union(spark.range(3).select(F.concat(F.lit("nation:"), "id"), F.lit(0)))
    return G.bounded_subgraph(edges(spark, sf_dir), entries)


@query(f"WITH {EDGES} SELECT src, coalesce(list_sort(list(dst) FILTER (WHERE label = 'located_in')), []) AS places, coalesce(list_sort(list(dst) FILTER (WHERE label = 'part_of')), []) AS parents FROM edges WHERE label IN ('located_in', 'part_of') GROUP BY src")
def lineage_gather(spark, sf_dir):
    return G.lineage(edges(spark, sf_dir), {"places": "located_in", "parents": "part_of"})


@query(
    f"""WITH {EDGES}, n AS (SELECT dst AS concept, label, src AS other, volatility FROM edges WHERE dst IN (SELECT 'nation:' || n_nationkey FROM nation)),
    r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY volatility, label, other) AS rank FROM n) SELECT concept, label, other, rank::INT AS rank FROM r WHERE rank <= 8"""
)
def neighbours_ranked(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("concept"))
    e = G.neighbours(G.volatility(edges(spark, sf_dir)), n, "in")
    w = Window.partitionBy("concept").orderBy("volatility", "label", "other")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("concept", "label", "other", "rank")


@query(f"WITH {EDGES} SELECT 'graph LR' || chr(10) || string_agg(src || ' -->|' || label || '| ' || dst, chr(10) ORDER BY src || ' -->|' || label || '| ' || dst) AS graph FROM edges WHERE label = 'part_of'")
def graph_mermaid(spark, sf_dir):
    return G.mermaid(edges(spark, sf_dir).where("label = 'part_of'"))


@query(
    f"""WITH {EDGES}, d AS (SELECT concept, count(*) AS degree FROM (SELECT src AS concept FROM edges UNION ALL SELECT dst FROM edges) GROUP BY concept),
    s AS (SELECT dst AS region, src AS nation FROM edges WHERE label = 'part_of')
    SELECT region, count(*) AS n_nations, sum(degree)::BIGINT AS links, max(degree) AS widest FROM s JOIN d ON d.concept = s.nation GROUP BY region"""
)
def relational_digest(spark, sf_dir):
    e = edges(spark, sf_dir)
    served = e.where("label = 'part_of'").select(F.col("dst").alias("region"), F.col("src").alias("concept"))
    return served.join(G.degrees(e), "concept").groupBy("region").agg(F.count("*").alias("n_nations"), F.sum("degree").alias("links"), F.max("degree").alias("widest"))


# ---- structured queries ---------------------------------------------------------------------

_ROWS = " r AS (SELECT lower(p_brand) || ':' || p_partkey AS concept, (p_partkey * 37 % 100) / 100.0::DOUBLE AS reliability, p_partkey * 7919 % 100000 AS recency, 'src/' || replace(lower(p_type), ' ', '/') || '.v' || p_size AS path FROM part)"


def _rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lower("p_brand"), F.lit(":"), "p_partkey").alias("concept"),
        (F.col("p_partkey") * 37 % 100 / 100.0).alias("reliability"),
        (F.col("p_partkey") * 7919 % 100000).alias("recency"),
        F.concat(F.lit("src/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit(".v"), "p_size").alias("path"),
    )


@query(f"WITH {_ROWS} SELECT * FROM r WHERE starts_with(concept, 'brand#1') AND reliability >= 0.5 AND reliability <= 0.9 ORDER BY reliability DESC, concept LIMIT 50")
def structured_prefix_range(spark, sf_dir):
    return Q.run(_rows(spark, sf_dir), Q.Query(prefix="brand#1", least=0.5, most=0.9, limit=50))


@query(f"WITH {_ROWS} SELECT * FROM r WHERE contains(path, '/') AND reliability >= 0.2 ORDER BY recency DESC, concept LIMIT 20")
def structured_recency(spark, sf_dir):
    return Q.run(_rows(spark, sf_dir), Q.Query.of({"path_contains": "/", "least": 0.2, "order": "recency", "limit": 20, "other": 1}))


@query(f"WITH {_ROWS} SELECT * FROM r WHERE (split_part(split_part(path, '/', -1), '.', 1) = 'economy' OR contains(concept, 'economy')) ORDER BY reliability DESC, concept LIMIT 200")
def structured_stem_path(spark, sf_dir):
    return Q.run(_rows(spark, sf_dir), Q.Query(stem="economy", limit=200))


@query(
    f"""WITH {EDGES}, c AS (SELECT 'customer:' || c_custkey AS concept, c_acctbal AS reliability FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 0.0 FROM nation)
    SELECT * FROM c WHERE concept = 'nation:7' OR concept IN (SELECT src FROM edges WHERE dst = 'nation:7' AND label = 'located_in') ORDER BY reliability DESC, concept LIMIT 40"""
)
def structured_related(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"), F.col("c_acctbal").alias("reliability"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey"), F.lit(0.0))
    return Q.run(c.union(n), Q.Query(related_to="nation:7", label="located_in", direction="in", limit=40), edges(spark, sf_dir))


@query(
    """WITH p AS (SELECT unnest(['brand#1*', '*#2*', 'brand*:1*9', 'brand#55:7']) AS pattern), c AS (SELECT lower(p_brand) || ':' || p_partkey AS concept FROM part)
    SELECT pattern, count(*) AS n FROM p, c WHERE regexp_matches(concept, '^' || replace(pattern, '*', '.*') || '$') GROUP BY pattern"""
)
def process_glob(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    found = [F.when(Q.glob(F.col("concept"), p), F.lit(p)) for p in ("brand#1*", "*#2*", "brand*:1*9", "brand#55:7")]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT 'customer:' || c_custkey AS concept, c_custkey FROM customer), f AS (SELECT concept FROM c WHERE c_custkey % 5 = 0), a AS (SELECT concept FROM c WHERE c_custkey % 10 = 0), t AS (SELECT concept, CASE WHEN c_custkey % 4 = 0 THEN 'side' ELSE 'main' END AS branch FROM c WHERE c_custkey % 2 = 0)
    SELECT c.concept FROM c LEFT JOIN t USING (concept) WHERE (branch IS NULL OR branch = 'main') AND NOT (concept IN (SELECT concept FROM f) AND concept NOT IN (SELECT concept FROM a))"""
)
def foreign_and_branch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"), "c_custkey")
    k = F.col("c_custkey")
    tags = c.where(k % 2 == 0).select("concept", F.when(k % 4 == 0, "side").otherwise("main").alias("branch"))
    seen = Q.visible_in_branch(c, tags, "main")
    return Q.foreign_filtered(seen, c.where(k % 5 == 0).select("concept"), c.where(k % 10 == 0).select("concept")).select("concept")
