"""Table readers, and the records, edges and event chains that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records with deterministic scalars: reliability, drift and mass follow from the id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.concat(F.lit("rec:"), F.col("vec_id")).alias("concept"),
        "label",
        F.col("embedding").cast("array<double>").alias("q"),
        ((F.col("vec_id") * 37) % 100 / 100.0).alias("reliability"),
        ((F.col("vec_id") * 17) % 100 / 100.0).alias("drift"),
        (F.col("vec_id") % 12).alias("mass"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, label, dst, volatility``: orders, customers, nations and regions as a labelled graph."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col))
    parts = [
        o.select(name("order", "o_orderkey").alias("src"), F.lit("placed_by").alias("label"), name("customer", "o_custkey").alias("dst"), F.lit(0.7).alias("volatility")),
        c.select(name("customer", "c_custkey").alias("src"), F.lit("located_in").alias("label"), name("nation", "c_nationkey").alias("dst"), F.lit(0.12).alias("volatility")),
        n.select(name("nation", "n_nationkey").alias("src"), F.lit("part_of").alias("label"), name("region", "n_regionkey").alias("dst"), F.lit(0.12).alias("volatility")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``concept, flagged``: every end the graph may have; customers in debt are flagged."""
    pick = lambda t, kind, key, flag: table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("concept"), flag.alias("flagged"))
    no = F.lit(False)
    return (
        pick("orders", "order", "o_orderkey", no)
        .unionByName(pick("customer", "customer", "c_custkey", F.col("c_acctbal") < 0))
        .unionByName(pick("nation", "nation", "n_nationkey", no))
        .unionByName(pick("region", "region", "r_regionkey", no))
    )
