"""Chains of traces that grow by micro-batches: a linked list whose edges are written once.

A store (``sources.versions``) holds the traces, the edges and the head of each chain. A batch is one change of all three,
marked with the batch's number: a batch that comes again after a failure finds its mark and writes nothing, one
that died before its version was published left nothing. Cut anywhere, batches give the chain that one batch gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.aggregate import number_rows
from ..sources.versions import Store

TRACES = "name string, chain string, us long, seq long, body string, reliability double"
EDGES = "src string, label string, dst string"
HEADS = "chain string, name string, us long, seq long"
#: The labels of a link, and what a trace's body says.
FORWARD, BACK = "prev_in_trace", "next_in_trace"
RELIABILITY = 0.85


def chain_store(spark: SparkSession, parts: int = 8, name: str = "chains") -> Store:
    s = Store.fresh(spark, name)
    s.create(traces=(TRACES, ["name"], parts), edges=(EDGES, ["src", "label", "dst"], parts), heads=(HEADS, ["chain"], parts))
    return s


def minted(rows: DataFrame) -> DataFrame:
    """Traces of ``rows`` (chain, ts, seq, decision, why): ``trace:<second>_<slug of the decision>-<seq>``."""
    slug = T.slug(F.col("decision"), 48)
    name = F.concat(F.lit("trace:"), F.unix_timestamp("ts"), F.lit("_"), slug, F.lit("-"), F.col("seq"))
    body = F.concat(F.lit("REASONING TRACE SEGMENT (via safe_edit_and_verify)\n\n**decision_point:** "), "decision", F.lit("\n\n**justification:** "), F.coalesce("why", F.lit("")), F.lit("\n"))
    return rows.where("chain IS NOT NULL AND ts IS NOT NULL AND decision IS NOT NULL").select(name.alias("name"), "chain", F.unix_micros("ts").alias("us"), "seq", body.alias("body"), F.lit(RELIABILITY).alias("reliability"))


def append(store: Store, rows: DataFrame, batch: int) -> int:
    """One batch: its traces go behind the heads, in order of time. Returns the version, an older one if the batch is stored."""
    with store.change() as c:
        if int(c.manifest["marks"].get("batch", "-1")) >= batch:
            return c.base
        new = minted(rows).dropDuplicates(["name"])
        # a chain may hold a third of the rows: their order is a range sort, and each finds the row before it by number
        placed = number_rows(new.select("name", "chain", "us", "seq"), [F.asc("chain"), F.asc("us"), F.asc("seq"), F.asc("name")], "_n")
        before = placed.select((F.col("_n") + 1).alias("_m"), F.col("chain").alias("_chain"), F.col("name").alias("_before"))
        linked = placed.join(before, (F.col("_n") == F.col("_m")) & (F.col("chain") == F.col("_chain")), "left").drop("_m", "_chain")
        heads = c.read("heads").select(F.col("chain").alias("_c"), F.col("name").alias("_head"))
        linked = linked.join(heads, F.col("chain") == F.col("_c"), "left").withColumn("prev", F.coalesce("_before", "_head"))
        ties = linked.where(F.col("prev").isNotNull() & (F.col("prev") != F.col("name")))
        edges = ties.select(F.col("prev").alias("src"), F.lit(FORWARD).alias("label"), F.col("name").alias("dst"))
        edges = edges.unionByName(ties.select(F.col("name").alias("src"), F.lit(BACK).alias("label"), F.col("prev").alias("dst")))
        last = placed.groupBy("chain").agg(F.max_by(F.struct("name", "us", "seq"), "_n").alias("r")).select("chain", "r.*")
        c.upsert("traces", new)
        c.upsert("edges", edges)
        c.upsert("heads", last)
        c.mark("batch", str(batch))
    return store.versions()[-1]


def sink(store: Store) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""
    return lambda rows, batch: append(store, rows, batch) and None
