"""Aggregations over records and events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions import vector as V


def bundle(records: DataFrame, by: str, vector: str = "q") -> DataFrame:
    """``by, n, v``: the sum of each group's vectors, at unit length.

    Sums run per component with a map-side part, so a group of any size costs one row a task and
    component; vectors are not gathered.
    """
    parts = records.select(by, F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(by, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    out = sums.groupBy(by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # one row per component
    return out.select(by, "n", V.normalise(F.transform("v", lambda p: p["x"])).alias("v"))


def store_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"), F.sum((F.col("reliability") >= 1).cast("int")).alias("pinned"), F.round(F.avg("reliability"), 6).alias("mean_reliability"))


def distill(records: DataFrame, least: float, size: int) -> DataFrame:
    """``chunk, n, mean, names, v``: reliable records in order, in chunks of ``size``, each bundled.

    Positions come from a range sort and per-partition counts, so no task sees all rows.
    """
    order = [F.desc("reliability"), F.asc("concept")]
    s = records.where(F.col("reliability") >= least).select("concept", "reliability", "q")
    s = number_rows(s, order, "_n").withColumn("chunk", F.floor(F.col("_n") / size))
    named = s.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.avg("reliability"), 6).alias("mean"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_n", "concept"))), lambda x: x["concept"]), 1, 3).alias("names"))
    return named.where("n >= 2").join(bundle(s, "chunk").select("chunk", "v"), "chunk")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 0 in a total order, without a window over all rows."""
    from .relations import settle

    s = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_at", 33))
    parts = s.groupBy("_part").agg(F.count("*").alias("_rows"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_before"))  # a row per partition
    return s.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``_by`` (the group) and for each ``name = share`` its exact quantile of ``value``, between neighbours in proportion; nulls do not count.

    Equal values are counted first; a range sort of the counts and their sums per partition place each value in its
    group, so that no group is gathered, whatever its share of all rows.
    """
    from .relations import settle

    n = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    s = settle(n.repartitionByRange("_by", "_v").withColumn("_part", F.spark_partition_id()))
    parts = s.groupBy("_by", "_part").agg(F.sum("_n").alias("_rows"))
    own = Window.partitionBy("_by")  # a row for each partition
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.select(F.col("_by").alias("_g"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_rows").over(own).alias("_all"))
    j = s.join(places, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    inside = F.sum("_n").over(Window.partitionBy("_by", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = j.withColumn("_end", F.col("_before") + inside)
    low = lambda x: F.floor(F.lit(x) * (F.col("_all") - 1))
    high = lambda x: F.ceil(F.lit(x) * (F.col("_all") - 1))
    holds = lambda place: (F.col("_end") - F.col("_n") <= place) & (place < F.col("_end"))
    met = F.lit(False)
    for x in shares.values():
        met = met | holds(low(x)) | holds(high(x))
    out = []
    for name, x in shares.items():
        at = F.lit(x) * (F.max("_all") - 1)
        a, b = F.max(F.when(holds(low(x)), F.col("_v"))), F.max(F.when(holds(high(x)), F.col("_v")))
        out.append((a + (b - a) * (at - F.floor(at))).alias(name))
    return j.where(met).groupBy("_by").agg(*out)


def beside(df: DataFrame, by: str, order: list[Column], step: int, **columns: str) -> DataFrame:
    """``df`` with columns of the row ``step`` places on in its group (null where there is none): ``new name = column``.

    Rows find one another by their number in a range sort; no group is gathered, whatever its share of all rows.
    """
    n = number_rows(df, [F.asc(by), *order], "_n")
    other = n.select((F.col("_n") - step).alias("_m"), F.col(by).alias("_by"), *[F.col(c).alias(name) for name, c in columns.items()])
    return n.join(other, (F.col("_n") == F.col("_m")) & F.col(by).eqNullSafe(F.col("_by")), "left").drop("_n", "_m", "_by")


def ranks_within(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in each group, from a range sort and the least number of each group."""
    n = number_rows(df, [F.asc(by), *order], "_n")
    first = n.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))
    return n.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, (F.col("_n") - F.col("_first") + 1).cast("int")).drop("_n", "_by", "_first")


def skill_clusters(traces: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """Successful reliable traces that repeat: same decision (normalised), file stem and tools."""
    key = F.concat_ws("|", T.normalised_decision(F.col("decision")), F.col("stem"), F.col("tools"))
    ok = traces.where("success and reliability >= 0.7").withColumn("cluster", key)
    w = Window.partitionBy("cluster").orderBy("concept")
    first = ok.withColumn("_r", F.row_number().over(w))
    g = first.groupBy("cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.col("concept")))).alias("examples"))
    return g.where(F.col("n") >= max(least, 2)).orderBy(F.desc("n"), "cluster").limit(min(max(most, 1), 50))


def recall_evaluation(hits: DataFrame, k: int) -> DataFrame:
    """``probes, accuracy, mean_top``: a probe is recalled if its concept is among its top k hits."""
    w = Window.partitionBy("probe").orderBy(F.desc("score"), "concept")
    top = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    each = top.groupBy("probe").agg(F.max((F.col("concept") == F.col("probe")).cast("int")).alias("hit"), F.max("score").alias("best"))
    return each.agg(F.count("*").alias("probes"), F.round(F.avg("hit"), 6).alias("accuracy"), F.round(F.avg("best"), 6).alias("mean_top"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.when(a == 0, 0.0).otherwise(float("inf"))).otherwise(a / b)


def trajectory(counters: DataFrame, by: str) -> DataFrame:
    """Sums of session counters and their ratios; nothing over nothing is 0, something over nothing infinite."""
    names = ["recalls", "empty_recalls", "writes", "violations", "mints", "updates"]
    s = counters.groupBy(by).agg(*[F.sum(n).alias(n) for n in names])
    c = {n: F.col(n) for n in names}
    return s.withColumns({
        "writes_per_recall": _ratio(c["writes"], c["recalls"]),
        "empty_rate": F.when(c["recalls"] == 0, 0.0).otherwise(c["empty_recalls"] / c["recalls"]),
        "mint_update_ratio": _ratio(c["mints"], c["updates"]),
        "advice": F.when(c["violations"] > 0, "recall_first").when((c["mints"] > c["updates"]) & (c["mints"] > 0), "prefer_updates").when((c["recalls"] == 0) & (c["writes"] > 0), "plan_first").otherwise("nominal"),
    })


def hit_rates(tiers: DataFrame) -> DataFrame:
    n = F.count("*")
    share = lambda t: F.round(F.sum((F.col("tier") == t).cast("int")) / n, 6).alias(t)
    return tiers.agg(n.alias("n"), share("hot"), share("warm"), share("cold"))


def goal_audit(goals: DataFrame, now: Column, stale_hours: int = 72) -> DataFrame:
    """Count by status, how many are stale, and whether too many are active."""
    stale = (F.col("status") == "active") & (now - F.col("last_ts") > stale_hours * 3600)
    return goals.groupBy("status").agg(F.count("*").alias("n"), F.sum(stale.cast("int")).alias("stale")).withColumn("sprawl", (F.col("status") == "active") & (F.col("n") > 5))


def gate_violations(events: DataFrame, by: str, order: list[str], recalls: Column, writes: Column) -> DataFrame:
    """Writes with no recall since the last write."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(recalls, "recall").when(writes, "write")
    last = F.last(kind, ignorenulls=True).over(w)
    return events.withColumn("_kind", kind).withColumn("_last", last).where((F.col("_kind") == "write") & ~F.col("_last").eqNullSafe("recall")).drop("_kind", "_last")


def packed_slots(slots: DataFrame, by: str, budget: int) -> DataFrame:
    """Greedy packing by priority: what does not fit is left out and later, smaller slots may still fit.

    ``slots``: by, priority, name, cost. A running sum would stop too early. Slots are sorted by report within partitions
    and read as a stream: a task keeps what it has kept of one report, not the report. Rows without a cost are left out.
    """
    kind = dict(slots.dtypes)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, used, kept, open_ = None, 0, [], False
        for b in batches:
            for k, name, cost in zip(*(b.column(c).to_pylist() for c in range(3))):
                if not open_ or k != key:
                    if open_:
                        out.append((key, used, kept))
                    key, used, kept, open_ = k, 0, [], True
                if cost is not None and used + cost <= budget:
                    used += cost
                    kept.append(name)
            if len(out) > 1024:
                yield batch(out)
                out = []
        yield batch([*out, (key, used, kept)] if open_ else out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (arrow, pa.int64(), pa.list_(pa.string())))], [by, "used", "kept"])

    rows = slots.select(by, F.col("name").cast("string").alias("name"), F.col("cost").cast("long").alias("cost"), "priority")
    arrow = to_arrow_type(slots.schema[by].dataType)
    ordered = rows.repartition(by).sortWithinPartitions(by, "priority", "name", "cost")
    return ordered.select(by, "name", "cost").mapInArrow(run, f"`{by}` {kind}, used long, kept array<string>")
