"""Consolidation of reliable records into one weighted centroid.

The weights and the friction rule are per record and run in parallel; each record is pulled towards
the previous centroid (not towards a running sum, which would order all records in one task), and
component sums with a map-side part make the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions import vector_udf as U


def kind_weight(concept: Column) -> Column:
    return F.when(concept.rlike("^(goal|serves):"), 2.5).when(concept.rlike("^(training|harmonic):"), 2.3).otherwise(1.0)


def consolidate(records: DataFrame, previous: DataFrame, gate: float = 0.85, low: float = 0.30, accept: float = 0.74) -> DataFrame:
    """``n, friction, v, momentum``. ``records``: concept, reliability, q; ``previous``: one row, column centroid."""
    r = records.where((F.col("reliability") >= gate) & ~F.col("concept").startswith("_")).crossJoin(F.broadcast(previous))
    r = r.withColumn("cos", V.cosine(F.col("q"), F.col("centroid"))).withColumn("rub", F.col("cos") < low)
    pulled, eased = U.rk4(steps=4)("q", "centroid"), U.reconcile(12)("q", "centroid")
    r = r.withColumn("pulled", pulled).withColumn("eased", eased)
    good = V.cosine(F.col("eased"), F.col("centroid")) >= accept
    v = F.when(~F.col("rub"), F.col("pulled")).when(good, F.col("eased")).otherwise(V.normalise(F.col("q")))
    w = kind_weight(F.col("concept")) * F.when(F.col("rub") & ~good, 0.1).otherwise(1.0)
    rows = r.select(v.alias("v"), w.alias("w"), "rub", "centroid")
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col("rub").cast("int")).alias("friction"))
    sums = rows.select("w", F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    one = sums.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))  # one row per component
    new = one.select(V.normalise(F.transform("s", lambda p: p["x"])).alias("v"))
    both = counts.crossJoin(new).crossJoin(F.broadcast(previous))
    return both.select("n", "friction", "v", V.normalise(V.subtract(F.col("v"), F.col("centroid"))).alias("momentum"))
