"""Queries over versioned tables: changes of several tables at once, backfill, an index that is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bonds as B
from ..sources.tables import table
from ..sources.versions import Store
from .registry import query


@query(
    """WITH o AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders),
    named AS (SELECT 'customer:' || c_custkey AS concept, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' again' ELSE c_name END AS text FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0),
    ends AS (SELECT src AS concept FROM o UNION SELECT dst FROM o),
    rows AS (SELECT concept, text, false AS stub FROM named UNION ALL SELECT concept, 'tensor stub entry for bond anchor: ' || concept, true FROM ends ANTI JOIN named USING (concept)),
    n AS (SELECT concept, count(*) AS n_bonds FROM (SELECT src AS concept FROM o UNION ALL SELECT dst FROM o) GROUP BY 1)
    SELECT concept, text, stub, coalesce(n_bonds, 0) AS n_bonds FROM rows LEFT JOIN n USING (concept)"""
)
def tensor_upsert_bonds(spark, sf_dir):
    """Every third customer is stored; every second comes again, with all orders as bonds; other ends become stubs."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("concept"), F.col("c_name").alias("text"), "c_custkey")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.lit("placed_by").alias("label"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"))
    store = B.bonded_store(spark, 4)
    with store.change() as first:
        B.upsert_with_bonds(first, c.where("c_custkey % 3 = 0"), o.limit(0))
    with store.change() as second:
        B.upsert_with_bonds(second, c.where("c_custkey % 2 = 0").withColumn("text", F.concat("text", F.lit(" again"))), o)
    entries, bonds = store.read("entries"), store.read("bonds")
    n = bonds.select(F.col("src").alias("concept")).union(bonds.select("dst")).groupBy("concept").agg(F.count("*").alias("n_bonds"))
    return entries.join(n, "concept", "left").select("concept", "text", "stub", F.coalesce("n_bonds", F.lit(0)).alias("n_bonds"))


_LETTERS = "aeiot"
_COUNTS = "list_transform(['a', 'e', 'i', 'o', 't'], lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE)"


@query(
    f"""WITH d AS (SELECT 'doc:' || doc_id AS concept, coalesce(text, '') AS t, CASE WHEN doc_id % 3 = 0 THEN [0.6, 0.8, 0.0, 0.0, 0.0] WHEN doc_id % 3 = 1 THEN [0.0, 0.0, 0.0, 0.0, 0.0] END AS v FROM documents),
    e AS (SELECT concept, v, {_COUNTS} AS n FROM d), u AS (SELECT *, sqrt(list_dot_product(n, n)) AS norm FROM e)
    SELECT concept, round(CASE WHEN abs(coalesce(v[1], 0)) > 1e-6 OR norm = 0 THEN v[1] ELSE n[1] / norm END, 6) + 0.0 AS first, abs(coalesce(v[1], 0)) > 1e-6 AS had FROM u"""
)
def embedding_backfill(spark, sf_dir):
    """A third of the documents have vectors; the others get theirs from letter counts, a second run changes nothing."""
    low = F.col("doc_id") % 3
    fixed = F.when(low == 0, F.array(*map(F.lit, (0.6, 0.8, 0.0, 0.0, 0.0)))).when(low == 1, F.array(*[F.lit(0.0)] * 5))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("concept"), "text", fixed.alias("vector"))

    def letters(text):
        n = F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS])
        norm = F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm > 0, F.transform(n, lambda x: x / norm))

    store = Store.fresh(spark, "vectors")
    store.create(vectors=(B.VECTORS, ["concept"], 8))
    with store.change() as c:
        c.upsert("vectors", docs)
    before = store.read("vectors")
    B.backfill(store, letters)
    B.backfill(store, letters)
    had = before.select(F.col("concept").alias("_c"), B.has_vector(F.col("vector")).alias("had"))
    after = store.read("vectors")
    return after.join(had, after["concept"] == had["_c"]).select("concept", (F.round(F.get("vector", F.lit(0)), 6) + 0.0).alias("first"), "had")
