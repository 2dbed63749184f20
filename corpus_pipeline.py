"""The corpus pipeline: quality, exact copies, near copies, mixing, piece encoding.

Each stage works on all rows its predecessor kept. All stages but the last return the columns of
``documents``; the last returns one row per document it encodes.

Edge cases: null texts count as empty at every stage and null ids and sources are values like any other; of
rows with equal texts one stays (the least id; rows without an id last), of near copies too, ties going by the
row's key; documents without words are neither repeated nor dropped by the mix; very long texts pass whole; extra
columns, whatever their names, are carried to the last stage; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import exact_dedup, mixing, pieces, quality, simhash
from vecloom.llm.common import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs


#: Compression, SimHash and piece merging have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
