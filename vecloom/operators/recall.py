"""Similarity recall: score every record, keep the best k.

The query vector is a frame of one row and is broadcast as such; ``orderBy.limit`` plans as a
top-k per partition and a merge, so no record vector is ever shuffled. Ties go by ``concept``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vector as V
from ..functions.vector_udf import srht_rows
from .aggregate import number_rows


def query_vector(records: DataFrame, vec_id: int, name: str = "query") -> DataFrame:
    """The one row with this id, as a one-column frame."""
    return records.where(F.col("vec_id") == vec_id).limit(1).select(F.col("q").alias(name))


def with_query(records: DataFrame, query: DataFrame) -> DataFrame:
    return records.crossJoin(F.broadcast(query))  # one row


def top_k(scored: DataFrame, k: int, *columns: str) -> DataFrame:
    return scored.select("concept", *columns, "score").orderBy(F.desc("score"), "concept").limit(k)


def recall(records: DataFrame, query: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k records of highest ``score``, an expression over the record and ``query``; cosine by default."""
    expr = V.cosine(F.col("q"), F.col("query")) if score is None else score
    return top_k(with_query(records, query).withColumn("score", F.round(expr, 6)), k)


def ranked(precision: bool = True, bands: bool = False, frame: Column | None = None) -> Column:
    """The multi-factor score of a record against ``query``."""
    sim = V.cosine(F.col("q"), F.col("query"))
    weight = None
    if precision:
        weight = S.precision_weight(F.col("reliability"), 1 - F.col("drift"))
        if bands:
            d = V.subtract(F.col("q"), F.col("query"))
            weight = S.clamp(weight * S.banded_precision(F.slice(d, 1, 16), V.norm(d)), 0.05, 1.0)
    near = None if frame is None else V.cosine(F.col("q"), frame)
    return S.ranked_score(sim, F.col("reliability"), F.col("drift"), F.col("mass"), weight, near)


def federated(records: DataFrame, query: DataFrame, k: int, namespace: str = "label") -> DataFrame:
    """Top k over all namespaces, named ``namespace::concept``: one global top-k is the merge of all."""
    named = with_query(records, query).select(F.concat_ws("::", F.col(namespace), "concept").alias("concept"), F.round(V.cosine(F.col("q"), F.col("query")), 6).alias("score"))
    return top_k(named, k)


def momentum(records: DataFrame, query: DataFrame, k: int, first: int = 20) -> DataFrame:
    """Two stages: the best ``first`` by position, then 80/20 with the score of the momentum vector ``p``."""
    s = with_query(records, query).withColumn("q_score", V.cosine(F.col("q"), F.col("query")))
    best = s.orderBy(F.desc("q_score"), "concept").limit(first)
    blend = S.momentum_score(F.col("q_score"), V.cosine(F.col("p"), F.col("query")))
    return top_k(best.withColumn("score", F.round(blend, 6)), k)


def coded(records: DataFrame) -> DataFrame:
    """``concept, code``: an eighth of the vectors' bytes, to be stored beside them and read in a first phase."""
    return records.select("concept", V.int8_codes(F.col("q")).alias("code"))


def two_phase(records: DataFrame, query: DataFrame, k: int, widen: int = 8, codes: DataFrame | None = None) -> DataFrame:
    """Pre-score narrow int8 codes (stored ones, if given), keep ``widen`` x k, then read and rescore those exactly."""
    asked = query.withColumn("_asked", V.int8_codes(F.col("query")))  # one row
    wide = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    near = with_query(coded(records) if codes is None else codes, asked.select("_asked")).withColumn("_near", V.dot(wide("code"), wide("_asked")))
    best = near.orderBy(F.desc("_near"), "concept").limit(k * widen).select("concept")
    found = records.join(F.broadcast(best), "concept", "left_semi")  # k * widen rows
    return top_k(with_query(found, query).withColumn("score", F.round(V.cosine(F.col("q"), F.col("query")), 6)), k)


def srht_codes(width: int, seed: int = 7):
    """A Pandas UDF: sign flips, Walsh-Hadamard, then 16 levels per component."""
    @F.pandas_udf("array<tinyint>")
    def code(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = srht_rows(np.stack(v.to_numpy()).astype(np.float64), seed)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        return pd.Series(list(np.clip(np.rint(x * np.sqrt(width) * 2.5 + 7.5), 0, 15).astype(np.int8)))

    return code


def srht(records: DataFrame, query: DataFrame, k: int, width: int, widen: int = 8) -> DataFrame:
    """Two phases over rotated 4-bit codes."""
    code = srht_codes(width)
    level = lambda c: F.transform(F.col(c), lambda x: x - 7.5)
    asked = query.select("query", code("query").alias("_d"))  # the one row is coded before it meets the records
    near = with_query(records.withColumn("_c", code("q")), asked)
    best = near.withColumn("_near", V.cosine(level("_c"), level("_d"))).orderBy(F.desc("_near"), "concept").limit(k * widen)
    return top_k(best.withColumn("score", F.round(V.cosine(F.col("q"), F.col("query")), 6)), k)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def recency_ranks(access: DataFrame, key: str = "concept", ts: str = "ts") -> DataFrame:
    """Position of each key by last access, 0 the newest: a range sort of one row a key, and counts of its partitions."""
    last = access.groupBy(key).agg(F.max(ts).alias("last_ts"))
    return number_rows(last, [F.desc("last_ts"), F.asc(key)], "recency_rank")
