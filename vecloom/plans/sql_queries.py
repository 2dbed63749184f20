"""The relational ground the engine stands on: joins, sets, cubes, frames, percentiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.aggregate import quantiles
from ..sources.tables import table
from .registry import query


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def local_supplier_volume(spark, sf_dir):
    li, o, c, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    j = li.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return j.groupBy("s_nationkey").agg(F.sum("v").alias("v")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("SELECT e.event_id, o.o_orderkey FROM (SELECT *, user_id AS k FROM events WHERE event_type = 'purchase') e ASOF JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.k = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_join(spark, sf_dir):
    """The last order of the same customer before each purchase: one sort per key, no range join."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "ts", "event_id", F.lit(None).cast("long").alias("o_orderkey"), F.lit(1).alias("kind"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    o = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("long").alias("event_id"), "o_orderkey", F.lit(0).alias("kind"))
    w = Window.partitionBy("k").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = e.unionByName(o).withColumn("last", F.last("o_orderkey", ignorenulls=True).over(w))
    return out.where("kind = 1 and last is not null").select("event_id", F.col("last").alias("o_orderkey"))


@query("WITH r AS (SELECT vec_id * 8 AS lo, vec_id * 8 + 11 AS hi, vec_id FROM embeddings) SELECT vec_id, count(*) AS n FROM r JOIN events ON event_id BETWEEN lo AND hi GROUP BY vec_id")
def range_join(spark, sf_dir):
    """Interval join on buckets: each interval is repeated for the buckets it touches, then an equi-join."""
    width = 16
    i = F.col("vec_id")
    r = table(spark, sf_dir, "embeddings").select("vec_id", (i * 8).alias("lo"), (i * 8 + 11).alias("hi"))
    r = r.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / width).alias("b"))
    return r.join(e, "b").where("event_id between lo and hi").groupBy("vec_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT l_shipmode_year AS year, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS r FROM (SELECT *, year(l_shipdate) AS l_shipmode_year FROM lineitem) GROUP BY 1")
def pivot_returns(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.na.fill(0.0, ["A", "N", "R"]).select("year", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT 0 UNION ALL SELECT count(*)::INT FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).exceptAll(spark.sql("SELECT 0 AS k"))
    rest = c.select("c_custkey").subtract(o.select("o_custkey")).agg(F.count("*").cast("int").alias("k"))
    return both.union(rest)


@query("SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def rank_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("q"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    parts = t.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))
    q = quantiles(t, "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95})
    j = parts.join(q, F.col("l_returnflag").eqNullSafe(F.col("_by")), "left")
    return j.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "parts")


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k, year(ts) AS y, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events")
def json_and_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.year("ts").cast("long").alias("y"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("day"))
