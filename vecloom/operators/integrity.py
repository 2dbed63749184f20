"""Seals, chains of digests, lineage and sealed bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns, nulls as empty, each ended by a separator that bodies do not hold."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def status(seal: Column, expected: Column, magic: Column) -> Column:
    return F.when(~magic, "structural").when(seal.isNull() | (seal == ""), "legacy_unsealed").when(seal == expected, "valid").otherwise("mismatch")


def overall(counts: DataFrame) -> DataFrame:
    """One row of seal tallies and a label. ``counts``: status."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    t = counts.agg(F.count("*").alias("checked"), n("valid"), n("legacy_unsealed"), n("mismatch"), n("structural"))
    return t.withColumn("health", F.when((F.col("mismatch") == 0) & (F.col("structural") == 0), "healthy").when(F.col("mismatch") + F.col("structural") > F.col("checked") / 10, "critical").otherwise("needs_review"))


def advance(slots: Column, new: Column, most: int = 5) -> Column:
    """The newest digest first; the oldest beyond ``most`` drops out."""
    return F.slice(F.concat(F.array(new), slots), 1, most)


def depth(slots: Column) -> Column:
    return F.size(F.filter(slots, lambda s: s.isNotNull() & (s != "")))


def plausible(slots: Column) -> Column:
    """No gap: after an empty slot all are empty."""
    filled = F.transform(slots, lambda s: F.when(s.isNotNull() & (s != ""), "1").otherwise("0"))
    return ~F.array_join(filled, "").contains("01")


def allowed(contract: Column, op: str) -> Column:
    """``version|name|name``: version 0 allows all, else the list names the operation or ``full``."""
    parts = F.transform(F.split(contract, r"\|"), lambda x: F.trim(x))
    return (F.element_at(parts, 1) == "0") | F.array_contains(parts, op) | F.array_contains(parts, "full")


def sealed(body: Column, key: Column, name: Column) -> Column:
    """AES-GCM with the name as additional data, as text."""
    return F.base64(F.aes_encrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), name))


def opened(body: Column, key: Column, name: Column) -> Column:
    """Null unless key and name are right."""
    return F.try_aes_decrypt(F.unbase64(body), key, F.lit("GCM"), F.lit("DEFAULT"), name).cast("string")


def window_around(text: Column, needle: Column, most: int) -> Column:
    """Up to ``most`` characters around the first hit, a quarter of them before it; the head without a hit."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - most // 4, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.lit(most))).otherwise(F.substring(text, 1, most))
