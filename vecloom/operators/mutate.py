"""Mutations as new frames: upsert, forget, blended updates, folds over an ordered history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V


def upsert(rows: DataFrame, new: DataFrame, key: str = "concept") -> DataFrame:
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def forget(rows: DataFrame, gone: DataFrame, key: str = "concept") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def forget_old(rows: DataFrame, below: float) -> DataFrame:
    """Drop what is not pinned and less reliable than the threshold."""
    return rows.where((F.col("reliability") >= below) | (F.col("reliability") >= 1))


def first_of(parts: DataFrame, key: str, order: str) -> DataFrame:
    """Federated lookup: of each key the row of the first namespace that has it."""
    rest = [c for c in parts.columns if c not in (key, order)]
    return parts.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def blended(old: DataFrame, new: DataFrame, share: float = 0.2) -> DataFrame:
    """Update with blend: unit(.8 old + .2 new), drift 1 - cosine, mass + 1; unknown keys are inserted."""
    # the inputs are renamed: inside a lambda, a name that the same select also gives would mean the new column
    n = new.select("concept", F.col("q").alias("_new"))
    both = old.withColumnsRenamed({"q": "_old", "drift": "_drift", "mass": "_mass"}).join(n, "concept", "full_outer")
    was, now = F.col("_old"), F.col("_new")
    hit = was.isNotNull() & now.isNotNull()
    drift = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - V.cosine(was, now)))
    return both.select(
        "concept",
        F.when(hit, V.blend(was, now, share)).otherwise(F.coalesce(was, now)).alias("q"),
        F.when(hit, drift).otherwise(F.coalesce("_drift", F.lit(0.0))).alias("drift"),
        (F.coalesce("_mass", F.lit(0)) + now.isNotNull().cast("int")).alias("mass"),
    )


def _running(by: str, order: list[str]) -> Window:
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _from_the_end(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``events`` with ``_first`` and ``_left``, the number of later events of the key. Sorted rows are streamed, none gathered."""
    w = Window.partitionBy(by).orderBy(*order)
    back = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_left", F.row_number().over(back) - 1).withColumn("_first", F.row_number().over(w) == 1)


def ema(events: DataFrame, by: str, order: list[str], value: str, share: float = 0.2) -> DataFrame:
    """``by, mean, n``: exponential mean from the first value on, as a sum of values weighted by their age."""
    x = _from_the_end(events, by, order)
    weight = F.pow(F.lit(1 - share), F.col("_left")) * F.when(F.col("_first"), 1.0).otherwise(share)
    return x.groupBy(by).agg(F.sum(F.col(value) * weight).alias("mean"), F.count("*").alias("n"))


def hypothesis(events: DataFrame, by: str, order: list[str], success: Column) -> DataFrame:
    """``by, support, denial, streak, confirmed``: support and denial grow by 0.25 to 2; a lead of 1 confirms for
    good; ``streak`` counts the failures since the last success."""
    w = _running(by, order)
    x = events.withColumn("_ok", F.sum(F.when(success, 1).otherwise(0)).over(w)).withColumn("_not", F.sum(F.when(success, 0).otherwise(1)).over(w))
    up = lambda c: F.least(F.col(c) * 0.25, F.lit(2.0))
    x = x.withColumn("_lead", up("_ok") - up("_not")).withColumn("_before", F.when(success, F.col("_not")))
    top = lambda c: F.max(c)
    return x.groupBy(by).agg(F.max(up("_ok")).alias("support"), F.max(up("_not")).alias("denial"), (top("_not") - F.coalesce(top("_before"), F.lit(0))).cast("int").alias("streak"), (F.max("_lead") >= 1).alias("confirmed"))


def lyapunov(a: Column, d: Column, r: Column) -> Column:
    total = F.greatest(a + d + r, F.lit(1e-6))
    return (0.4 * a * a + 0.3 * d * d + 0.3 * r * r) / (total * total)


def stability(events: DataFrame, by: str, order: list[str], gradient: Column, drift: Column, decay: float = 0.034, rate: float = 0.12) -> DataFrame:
    """``by, a, d, r``: three leaky integrators of affirmation, denial and reconciliation, as sums weighted by age."""
    x = _from_the_end(events.withColumn("_g", gradient).withColumn("_m", F.least(drift, F.lit(1.0))), by, order)
    grown = lambda v: F.sum(F.pow(F.lit(1 - decay), F.col("_left")) * rate * v)
    return x.groupBy(by).agg(grown(F.greatest(1 - F.col("_g"), F.lit(0.0))).alias("a"), grown(F.least("_g", F.lit(1.0))).alias("d"), grown(1 - F.col("_m")).alias("r"))
