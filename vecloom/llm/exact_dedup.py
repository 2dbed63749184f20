"""Exact de-duplication through an extendible-hash index on shared files (DataFrame operations only).

1. Every row's text is normalised and hashed to a 64-bit key; keys are counted, with a map-side part.
2. The directory: occupancy is counted for the leading ``bits`` of the keys and doubled down from one
   bucket: a bucket that holds more than ``capacity`` keys splits on its next bit. A prefix's local
   depth is thus the least depth whose bucket is not overfull. It has 2**bits rows, about eight to
   sixteen for each bucket and at most 2**DEPTH, which is its proven size when it is broadcast.
3. Rows go to the owner task of their key's bucket. The owner chains the entries of a key and compares
   their bytes (a hash aggregate on key and text inside the bucket, with no further exchange); it
   alone decides who stays and counts. Keys met in more than 1 / 50,000 of all rows (at most 50,000
   keys, so they may be broadcast) are collapsed by key and text in their tasks before they travel.
4. The entries are written to shared files, a range of buckets to each, and every row looks itself up
   there by bucket, key and digest.

Edge cases: a null text counts as empty; an empty text is a text like any other; rows with a null
doc_id group by text but never stay before a row that has one; rows equal in both id and text all carry
the decision of ``exact_dedup``, and ``keep_first`` keeps one of them. Extra columns are ignored or, in
``keep_first``, kept. Ties cannot arise otherwise. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, left_join, pick, row_key, scratch, text_of

DEPTH = 20
CAPACITY = 1024
SHARE = 50_000


def normalised_of(text: Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def normalised(column: str = "text") -> Column:
    return normalised_of(F.col(column))


def prefix_bits(keys: int, capacity: int) -> int:
    """The bits a directory may look at: three or four beyond those an even spread needs."""
    return min(DEPTH, max(4, (keys // max(1, capacity)).bit_length() + 3))


def prefix_of(bits: int, key: str = "key") -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def directory(keys: DataFrame, capacity: int, bits: int) -> DataFrame:
    """``prefix, depth, bucket`` for each occupied prefix of ``bits`` bits; bucket numbers follow key order."""
    full = keys.groupBy(prefix_of(bits).alias("prefix")).agg(F.count("*").alias("n"))
    levels = full.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    top = lambda: F.expr(f"shiftrightunsigned(prefix, {bits} - depth)")
    load = levels.groupBy("depth", top().alias("top")).agg(F.sum("n").alias("load"))
    fits = levels.withColumn("top", top()).join(load, ["depth", "top"]).where((F.col("load") <= capacity) | (F.col("depth") == bits))
    local = fits.groupBy("prefix").agg(F.min("depth").alias("depth"))
    return local.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(prefix, {bits} - depth), {bits} - depth)"))


def _placed(rows: DataFrame, d: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with ``key``) and their ``bucket`` through the directory, of 2**bits rows at most."""
    return rows.withColumn("prefix", prefix_of(bits)).join(F.broadcast(d.select("prefix", "bucket")), "prefix").drop("prefix")


def _indexed(docs: DataFrame, capacity: int, id_col: str, text_col: str, spread=directory) -> tuple[DataFrame, DataFrame]:
    """The index ``bucket, key, text_sha256, keep_id, group_size`` on shared files, and ``doc_id, key, text_sha256, bucket`` of the rows."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"), row_key(F.col(text_col), F.col(id_col)).alias("row")).withColumn("key", F.xxhash64("norm"))
    digests = cut(norm.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), "row"), "digests")
    met = cut(digests.groupBy("key").agg(F.count("*").alias("n")), "keys")
    total, keys = met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = prefix_bits(keys, capacity)
    d = cut(spread(met, capacity, bits), "directory")
    hot = met.where(F.col("n") > max(1000, total // SHARE)).select("key", F.lit(True).alias("hot"))  # at most SHARE keys
    rows = _placed(norm.select("doc_id", "norm", "key"), d, bits).join(F.broadcast(hot), "key", "left")
    few = rows.where("hot").groupBy("bucket", "key", "norm").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    sent = rows.where("hot is null").select("bucket", "key", "norm", "doc_id", F.lit(1).cast("long").alias("n")).unionByName(few)
    chained = sent.repartition("bucket").groupBy("bucket", "key", "norm").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    index = cut(chained.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size").sortWithinPartitions("bucket", "key"), "index")
    return index, _placed(digests, d, bits)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", spread=directory) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, bucket`` and the key ``row`` of id and text."""
    with scratch(docs.sparkSession):
        index, rows = _indexed(docs, capacity, id_col, text_col, spread)
        out = left_join(rows, index, ["bucket", "key", "text_sha256"])
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return cut(out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "row"), "exact", stay=True)


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per distinct normalised text.

    Of rows with equal ids the one with the least key stays; of rows equal in id and text, one.
    """
    own = exact_dedup(docs, capacity).where("kept").groupBy("bucket", "text_sha256", "row").agg(F.count("*").alias("n"))
    stay = own.groupBy("bucket", "text_sha256").agg(F.min(F.struct("row", "n")).alias("x")).select(F.col("x.row").alias("key"), F.col("x.n").alias("n"))
    return pick(docs, cut(stay, "stay", stay=True), row_key(docs["text"], docs["doc_id"]))
