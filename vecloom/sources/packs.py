"""Folders of exported records: packs with a manifest, ingest of directories, wire rows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.shared import shared_path

SCHEMA = "concept string, body string, reliability double, kind string"
VERSION = "record-pack-1"
EXTENSIONS = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "cpp", "cc", "h", "md", "toml", "txt", "json", "yaml", "yml", "sql", "sh")


def write_pack(rows: DataFrame, path: str) -> DataFrame:
    """Write items as JSON lines and their manifest beside them; returns the manifest (one row)."""
    items = rows.select("concept", "body", "reliability", "kind")
    items.write.mode("overwrite").json(f"{path}/items")
    m = manifest(read_pack(rows.sparkSession, path))
    m.write.mode("overwrite").json(f"{path}/manifest")
    return m


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """Items with defaults: reliability 0.5, kind record."""
    return spark.read.schema(SCHEMA).json(f"{path}/items").na.fill({"reliability": 0.5, "kind": "record"})


def manifest(items: DataFrame) -> DataFrame:
    return items.agg(F.lit(VERSION).alias("version"), F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))


def check_manifest(spark: SparkSession, path: str) -> None:
    m = spark.read.json(f"{path}/manifest").first()
    now = manifest(read_pack(spark, path)).first()
    if m is None or m["version"] != VERSION or (m["n"], m["bytes"]) != (now["n"], now["bytes"]):
        raise ValueError(f"the manifest of {path} does not fit its items")


def quarantined(items: DataFrame, existing: DataFrame, cap: float = 0.6) -> DataFrame:
    """Imports: reliability at most ``cap``; a name that is taken becomes ``sync:name``."""
    taken = existing.select(F.col("concept").alias("_c")).distinct()
    j = items.join(taken, F.col("concept") == F.col("_c"), "left")
    name = F.when(F.col("_c").isNotNull(), F.concat(F.lit("sync:"), "concept")).otherwise(F.col("concept"))
    return j.select(name.alias("concept"), "body", F.least("reliability", F.lit(cap)).alias("reliability"), "kind")


def external(rows: DataFrame, source: str, ts: int) -> DataFrame:
    """Foreign texts: ``external:source:slug:ts``, moderate reliability, flagged. ``rows``: path, body."""
    base = F.substring_index("path", "/", -1)
    slug = F.substring(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), 1, 48)
    return rows.select(F.concat_ws(":", F.lit("external"), F.lit(source), slug, F.lit(ts)).alias("concept"), "body", F.lit(0.55).alias("reliability"), F.lit(True).alias("is_foreign"))


def ingest(spark: SparkSession, path: str, ignore: list[str] | None = None) -> DataFrame:
    """``path, extension, body`` of the known kinds of files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(path)
    rows = f.select("path", F.substring_index("path", ".", -1).alias("extension"), F.decode("content", "UTF-8").alias("body"))
    for p in ignore or []:
        rows = rows.where(~F.col("path").contains(p))
    return rows


def preferred(files: DataFrame) -> DataFrame:
    """Of each name the newer format. ``files``: name, extension."""
    return files.groupBy("name").agg(F.max("extension").alias("extension"))


# ---- wire rows ----------------------------------------------------------------------------


def wire_encode():
    """A Pandas UDF ``(concept, reliability, tag, q, body) -> binary``: magic, sizes, fields, little-endian."""

    @F.pandas_udf("binary")
    def run(concept: pd.Series, reliability: pd.Series, tag: pd.Series, q: pd.Series, body: pd.Series) -> pd.Series:
        out = []
        for c, r, t, v, b in zip(concept, reliability, tag, q, body):
            c, b, v = c.encode(), (b or "").encode(), np.asarray(v, "<f4")
            out.append(b"VLW1" + struct.pack("<dhIII", r, t, len(c), len(v), len(b)) + c + v.tobytes() + b)
        return pd.Series(out, dtype=object)

    return run


WIRE = "concept string, reliability double, tag int, q array<float>, body string"


def wire_decode():
    """The inverse, as a struct; unknown bytes give a row of nulls."""

    @F.pandas_udf(WIRE)
    def run(raw: pd.Series) -> pd.DataFrame:
        out = []
        for x in raw:
            if x is None or x[:4] != b"VLW1":
                out.append((None, None, None, None, None))
                continue
            r, t, nc, nv, nb = struct.unpack_from("<dhIII", x, 4)
            at = 4 + struct.calcsize("<dhIII")
            c, v = x[at : at + nc].decode(), np.frombuffer(x, "<f4", nv, at + nc)
            out.append((c, r, t, v.tolist(), x[at + nc + 4 * nv : at + nc + 4 * nv + nb].decode()))
        return pd.DataFrame(out, columns=["concept", "reliability", "tag", "q", "body"])

    return run


def pack_path(spark: SparkSession) -> str:
    return shared_path(spark, "pack")


def kind_label(concept: Column) -> Column:
    return F.when(concept.startswith("external:"), "external").when(concept.startswith("sync:"), "sync").otherwise("own")
