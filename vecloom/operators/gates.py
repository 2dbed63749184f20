"""Rules of order over a session's events, and over the runs of declared processes, as windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wake_queue_gate(events: DataFrame, by: str, order: list[str], kind: Column, queue: Column, hard: bool = False) -> DataFrame:
    """``events`` that ask for a context, with ``what`` and ``attempts``: before the queue that a session woke up with is acknowledged, they are refused (``hard``) or warned.

    Kinds: start (with the length of its ``queue``; an empty one needs no acknowledgement), ack, end, context. Without a session
    a context is unguarded. ``attempts`` counts a session's contexts before the acknowledgement.
    """
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("_kind", kind)
    edge = F.col("_kind").isin("start", "end")
    e = e.withColumn("_edge", F.last(F.when(edge, F.struct(F.col("_kind").alias("k"), queue.alias("n"))), True).over(so_far)).withColumn("_session", F.sum(edge.cast("int")).over(so_far))
    inner = Window.partitionBy(by, "_session").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    acked = (F.coalesce(F.col("_edge.n"), F.lit(0)) == 0) | (F.max((F.col("_kind") == "ack").cast("int")).over(inner) > 0)
    e = e.withColumn("_active", F.coalesce(F.col("_edge.k") == "start", F.lit(False))).withColumn("_acked", acked)
    early = F.col("_active") & ~F.col("_acked") & (F.col("_kind") == "context")
    e = e.withColumn("attempts", F.sum(early.cast("int")).over(inner)).where(F.col("_kind") == "context")
    what = F.when(~F.col("_active"), "unguarded").when(F.col("_acked"), "allowed").otherwise("blocked" if hard else "warned")
    return e.withColumn("what", what).withColumn("attempts", F.when(F.col("_active"), F.col("attempts")).otherwise(0)).drop("_kind", "_edge", "_session", "_active", "_acked")


DECLARED = "process string, starts string, products array<string>, timeout_us long"


def process_runs(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Runs of declared processes and how they came out: ``process, key, start_id, n_done, done_us, outcome``.

    ``events``: key, us, id, product. ``rules`` (a row for each process): the product that ``starts`` a run, the products
    that it declares, in order, and a timeout. Each event that starts a process is a run; it is ``complete`` if all
    declared products follow one another after it, the last no later than the timeout (earliest matches first, which
    finds an order wherever there is one), else ``partial`` or ``none``. A process without products is complete at once; one whose starting
    product never occurs has no runs. All rules advance together, one look-up for each place in the longest list.
    """
    longest = rules.agg(F.max(F.size("products"))).first()[0] or 0
    named = rules.where("process IS NOT NULL AND starts IS NOT NULL").select("process", "starts", F.coalesce("products", F.array().cast("array<string>")).alias("products"), "timeout_us")
    runs = events.join(F.broadcast(named) if rules.count() <= 10_000 else named, events["product"] == named["starts"])
    runs = runs.select("process", "key", F.col("id").alias("start_id"), F.col("us").alias("start_us"), "products", (F.col("us") + F.col("timeout_us")).alias("until"), F.lit(0).alias("n_done"), F.struct("us", "id").alias("at"))
    seen = events.select("key", "product", F.struct("us", "id").alias("next"))
    for k in range(longest):
        open_ = (F.size("products") > k) & (F.col("n_done") == k)
        asks = runs.withColumn("product", F.when(open_, F.get("products", F.lit(k)))).withColumn("next", F.lit(None).cast("struct<us:bigint,id:bigint>"))
        both = asks.unionByName(seen, allowMissingColumns=True).withColumn("_t", F.coalesce("next", "at"))
        # the first event of that product behind the run's place: an as-of join forwards, events before askers at equal places do not count
        ahead = Window.partitionBy("key", "product").orderBy(F.asc("_t"), F.asc(F.col("next").isNull())).rowsBetween(1, Window.unboundedFollowing)
        found = both.withColumn("_next", F.first("next", True).over(ahead)).where("process IS NOT NULL")
        hit = open_ & F.col("_next").isNotNull() & (F.col("_next.us") <= F.col("until"))
        runs = found.select("process", "key", "start_id", "start_us", "products", "until", (F.col("n_done") + hit.cast("int")).alias("n_done"), F.when(hit, F.col("_next")).otherwise(F.col("at")).alias("at"))
    n = F.size("products")
    outcome = F.when(F.col("n_done") == n, "complete").when(F.col("n_done") > 0, "partial").otherwise("none")
    return runs.select("process", "key", "start_id", "n_done", (F.col("at.us") - F.col("start_us")).alias("done_us"), outcome.alias("outcome"))


def process_metrics(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Per declared process: its runs by outcome, and the mean time of the complete ones; zeros for those without a run."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    counts = runs.groupBy("process").agg(F.count("*").alias("runs"), *map(n, ("complete", "partial", "none")), F.avg(F.when(F.col("outcome") == "complete", F.col("done_us"))).alias("mean_us"))
    both = rules.select("process").where("process IS NOT NULL").distinct().join(counts, "process", "left")
    return both.select("process", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "complete", "partial", "none")], F.round("mean_us", 3).alias("mean_us"))
