"""The relation graph: lookups, degrees, expansion within a budget, chains, bounded subgraphs.

``edges``: src, label, dst, volatility. All lookups are equi-joins; walks are loops of joins whose
state is cut through the shared checkpoint folder, so lineage stays short and lost executors
only cost their tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.shared import cut

#: How volatile an edge is when it does not say.
LABEL_VOLATILITY = {"part_of": 0.12, "located_in": 0.12, "serves": 0.12, "decomposes_into": 0.12, "documents": 0.12, "prev_in_trace": 0.5, "next_in_trace": 0.5}


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    return cut(df, "walk")


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """``concept, label, other, volatility`` of the edges at ``seeds`` (concept)."""
    ends = {"out": ("src", "dst"), "in": ("dst", "src")}
    if direction == "both":
        return neighbours(edges, seeds, "out").unionByName(neighbours(edges, seeds, "in"))
    own, other = ends[direction]
    e = edges.select(F.col(own).alias("concept"), "label", F.col(other).alias("other"), "volatility")
    return e.join(seeds.select("concept").distinct(), "concept", "left_semi")


def volatility(e: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in LABEL_VOLATILITY.items() for x in kv])
    return e.withColumn("volatility", F.coalesce("volatility", known[F.col("label")], F.lit(0.3)))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("concept"))
    return ends.groupBy("concept").agg(F.count("*").alias("degree"))


def connected(rows: DataFrame, edges: DataFrame, label: str, end: str = "src") -> DataFrame:
    """Rows with an edge of this label at the given end."""
    return rows.join(edges.where(F.col("label") == label).select(F.col(end).alias("concept")), "concept", "left_semi")


def unconnected(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(degrees(edges).select("concept"), "concept", "left_anti")


def lineage(edges: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row per source with the targets of each label, from a single pass."""
    pick = [F.sort_array(F.collect_list(F.when(F.col("label") == l, F.col("dst")))).alias(n) for n, l in labels.items()]
    return edges.where(F.col("label").isin(*labels.values())).groupBy("src").agg(*pick)


def expand(edges: DataFrame, seeds: DataFrame, budget: float, label: str | None = None, direction: str = "in", weighted: bool = True, most: float = 8.0) -> DataFrame:
    """``concept, cost``: least cost of reaching each concept, within the budget, which counts as ``most`` where it is more.

    Each hop costs 1 + volatility (or 1). True minima: all cheaper ways are relaxed until none is
    left; a hop costs at least 1, so the budget bounds the rounds.
    """
    budget = min(budget, most)
    own, other = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges if label is None else edges.where(F.col("label") == label)
    hop = 1 + F.col("volatility") if weighted else F.lit(1.0)
    e = volatility(e).select(F.col(own).alias("at"), F.col(other).alias("to"), hop.alias("hop"))
    reached = settle(seeds.select("concept", F.lit(0.0).alias("cost")).distinct())
    front = reached
    for _ in range(int(budget)):
        step = front.join(e, F.col("concept") == F.col("at")).select(F.col("to").alias("concept"), (F.col("cost") + F.col("hop")).alias("cost")).where(F.col("cost") <= budget)
        step = step.groupBy("concept").agg(F.min("cost").alias("cost"))
        old = reached.select("concept", F.col("cost").alias("old"))
        front = settle(step.join(old, "concept", "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old"))).select("concept", "cost"))
        if front.isEmpty():
            break
        reached = settle(reached.union(front).groupBy("concept").agg(F.min("cost").alias("cost")))
    return reached


def walk(links: DataFrame, heads: DataFrame, most: int = 48) -> DataFrame:
    """``head, at, depth``: follow each node's least predecessor from ``heads`` (concept), without cycles.

    ``links``: concept, previous. Distances double, so a walk takes log2(most) joins rather than most.
    """
    step = settle(links.groupBy("concept").agg(F.min("previous").alias("previous")))
    out = heads.select(F.col("concept").alias("head"), F.col("concept").alias("at"), F.lit(0).alias("depth"))
    jump, k = step.select(F.col("concept").alias("c"), F.col("previous").alias("p")), 1
    while k < most:
        more = out.join(jump, out["at"] == jump["c"]).select("head", F.col("p").alias("at"), (F.col("depth") + k).alias("depth"))
        out = settle(out.union(more.where(F.col("depth") < most)))
        a, b = jump.select("c", F.col("p").alias("m")), jump.select(F.col("c").alias("m"), "p")
        jump, k = settle(a.join(b, "m").select("c", "p")), 2 * k
    return out.groupBy("head", "at").agg(F.min("depth").alias("depth"))


def chain_tips(links: DataFrame) -> DataFrame:
    """Members that nothing follows."""
    return links.select("concept").join(links.select(F.col("previous").alias("concept")), "concept", "left_anti")


def bounded_subgraph(edges: DataFrame, entries: DataFrame, most_nodes: int = 12, most_edges: int = 32) -> DataFrame:
    """At most so many entries (by rank), and only edges between them."""
    kept = entries.orderBy("rank", "concept").limit(most_nodes).select("concept")
    e = edges.join(kept.select(F.col("concept").alias("src")), "src", "left_semi").join(kept.select(F.col("concept").alias("dst")), "dst", "left_semi")
    return e.select("src", "label", "dst", "volatility").orderBy("src", "label", "dst").limit(most_edges)


def first_neighbours(edges: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """At most ``most`` neighbours a seed, the least volatile first."""
    w = Window.partitionBy("concept").orderBy("volatility", "label", "other")
    return neighbours(volatility(edges), seeds).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mermaid(edges: DataFrame) -> DataFrame:
    line = F.format_string("%s -->|%s| %s", "src", "label", "dst")
    return edges.groupBy().agg(F.concat(F.lit("graph LR\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("graph"))


def relate(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Append edges, the newest volatility of an edge wins."""
    key = ["src", "label", "dst"]
    return edges.join(new.select(*key), key, "left_anti").unionByName(new.dropDuplicates(key))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of graph health: orphans, hub dominance, density of flagged nodes, suggestions.

    Every node and edge counts. ``nodes``: concept, flagged.
    """
    d = degrees(edges)
    n = nodes.join(d, "concept", "left").agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("degree").isNull(), 1).otherwise(0)).alias("orphans"), F.sum(F.col("flagged").cast("int")).alias("flagged"))
    hub = d.agg(F.max(F.struct("degree", F.col("concept").alias("hub"))).alias("h")).select("h.degree", "h.hub")
    e = edges.agg(F.count("*").alias("edges"))
    one = n.crossJoin(hub).crossJoin(e)  # one row each
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    out = one.select("nodes", "edges", "orphans", share("orphans", "nodes").alias("orphan_rate"), "hub", F.col("degree").alias("hub_degree"), share("degree", "edges").alias("hub_dominance"), share("flagged", "nodes").alias("flagged_density"))
    told = F.array_compact(F.array(F.when(F.col("orphan_rate") > 0.4, F.lit("relate_orphans")), F.when(F.col("hub_dominance") > 0.25, F.lit("fan_out_hub")), F.when(F.col("flagged_density") > 0.15, F.lit("review_flagged"))))
    return out.withColumn("suggestions", F.when(F.size(told) == 0, F.lit("nominal")).otherwise(F.array_join(told, ",")))


def with_roots(edges: DataFrame, digests: DataFrame) -> DataFrame:
    """``edges`` plus ``expected``, the hash of both ends' digests. ``digests``: concept, digest."""
    d = digests.select("concept", "digest")
    out = edges.join(d.toDF("src", "_a"), "src", "left").join(d.toDF("dst", "_b"), "dst", "left")
    return out.withColumn("expected", F.sha2(F.concat("_a", "_b"), 256)).drop("_a", "_b")


def lineage_current() -> Column:
    """Whether an edge's stored ``root`` is that of its ends as they are now; both must exist."""
    return F.col("expected").isNotNull() & (F.col("root") == F.col("expected"))
