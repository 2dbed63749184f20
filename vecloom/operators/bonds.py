"""Changes over entries and the bonds between them, and backfill of missing vectors: one version each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Change, Store
from .reports import tensor_name

ENTRIES = "concept string, text string, stub boolean"
BONDS = "src string, label string, dst string"
#: Fixed value: the text of an entry that only a bond asked for.
STUB = "tensor stub entry for bond anchor: "


def bonded_store(spark: SparkSession, parts: int, name: str = "bonds") -> Store:
    s = Store.fresh(spark, name)
    s.create(entries=(ENTRIES, ["concept"], parts), bonds=(BONDS, ["src", "label", "dst"], parts))
    return s


def upsert_with_bonds(change: Change, entries: DataFrame, bonds: DataFrame) -> dict[str, int]:
    """Entries (concept, text) and bonds (src, dst, label); ends that no entry has become stubs.

    Names and labels are trimmed, a name without a namespace gets one. Entries without a name or a text and bonds without an end or a label are left
    out; a stub never replaces an entry, an entry replaces a stub. Returns the parts rewritten of each table.
    """
    trim = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    name = lambda c: F.when(trim(c) != "", tensor_name(trim(c))).alias(c)
    named = entries.select(name("concept"), "text").where(F.col("concept").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    ties = bonds.select(name("src"), trim("label").alias("label"), name("dst")).where("src IS NOT NULL AND label <> '' AND dst IS NOT NULL")
    ends = ties.select(F.col("src").alias("concept")).union(ties.select("dst")).distinct()
    missing = ends.join(named, "concept", "left_anti").join(change.read("entries"), "concept", "left_anti")
    stubs = missing.select("concept", F.concat(F.lit(STUB), "concept").alias("text"), F.lit(True).alias("stub"))
    return {"entries": change.upsert("entries", named.withColumn("stub", F.lit(False)).unionByName(stubs)), "bonds": change.upsert("bonds", ties)}


VECTORS = "concept string, text string, vector array<double>"


def has_vector(v: Column) -> Column:
    """A vector counts as there if its first component is not near zero."""
    return F.coalesce(F.abs(F.get(v, F.lit(0))) > 1e-6, F.lit(False))


def backfill(store: Store, embed: Callable[[Column], Column], table: str = "vectors", force: bool = False) -> dict[str, int]:
    """Gives a vector to the rows that have a text and none yet (with ``force``, to all with a text), as one version.

    Only the parts with such rows are rewritten, and a vector that comes out as it is stored changes nothing:
    a second run writes no file and no version. Returns the parts rewritten.
    """
    with store.change() as c:
        due = F.coalesce(F.length("text"), F.lit(0)) > 0
        if not force:
            due = due & ~has_vector(F.col("vector"))
        n = c.update(table, "vector", F.coalesce(F.when(due, embed(F.col("text"))), F.col("vector")))
    return {"parts": n}
