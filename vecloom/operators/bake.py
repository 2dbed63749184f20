"""Many queries at once: blocked products with a bounded list of the best per query, and a context baked from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector_udf import unit

#: Bytes of query vectors, and of the lists of their best, that a task holds at a time.
QUERY_BYTES = 32 << 20
BATCH = 2048
#: Scores that a task computes at a time: a batch meets as many queries at once as this allows.
SCORES = 1 << 20


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors with a direction and ``dim`` components, and which those are."""
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    ok = (sizes == dim) & ~np.asarray(column.is_null())
    flat = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(ok.sum()), dim)
    fine = np.isfinite(flat).all(axis=1) & (np.linalg.norm(flat, axis=1) > 0)
    ok[np.flatnonzero(ok)[~fine]] = False
    return unit(flat[fine]), ok


class Best:
    """Per query at most ``k`` names with their scores, by score and then name, in a few arrays."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.scores, self.at = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)  # by query; ``at`` is a place in ``names``
        self.names = pa.array([], pa.string())

    def offer(self, first: int, scores: np.ndarray) -> None:
        """``scores``: a row for each name of ``start``, a column for each query from ``first`` on."""
        floor = self.floor[first : first + scores.shape[1]]
        for j in np.flatnonzero((scores >= floor).any(axis=0)).tolist():
            s, q = scores[:, j], first + j
            new = np.flatnonzero(s >= floor[j])
            if len(new) > self.k:
                new = new[s[new] >= np.partition(s[new], -self.k)[-self.k]]  # with all ties of the last
            old = self.at[q][self.at[q] >= 0]
            own, at = np.concatenate((self.scores[q][: len(old)], s[new])), np.concatenate((old, self.base + new))
            order = np.argsort(-own, kind="stable")
            if len(order) > self.k and own[order[self.k - 1]] == own[order[self.k]]:  # names decide only where the last ties
                words = self.names.take(pa.array(at)).to_pylist()
                order = sorted(range(len(own)), key=lambda i: (-own[i], words[i]))
            order = order[: self.k]
            self.scores[q, : len(order)], self.at[q, : len(order)] = own[order], at[order]
            if len(order) == self.k:
                floor[j] = own[order[-1]]

    def start(self, names: pa.Array) -> None:
        """The next names to be offered join those that are kept."""
        self.base = len(self.names)
        self.names = pa.concat_arrays([self.names, names])

    def settle(self) -> None:
        """Forgets the names that no list holds."""
        used, at = np.unique(self.at, return_inverse=True)
        none = int(len(used) > 0 and used[0] < 0)
        self.at = at.reshape(self.at.shape).astype(np.int64) - none
        self.names = self.names.take(pa.array(used[none:]))


def recall_many(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, concept, score, rank``: the k records (concept, q) nearest to each query (query_id, query) by cosine.

    Records are read once for each ``QUERY_BYTES`` of queries, and never shuffled; a task multiplies batches of them with parts of
    the matrix of queries, ``SCORES`` products at a time, and hands on k names per query, which a window merges. Ties go by name. Vectors that are null, without a
    direction or of another length than most queries have no part. ``query_id`` must be a long.
    """
    known = queries.where(F.size("query") > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    most = known.groupBy(F.size("query").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, concept string, score double"
    if most is None:
        return records.sparkSession.createDataFrame([], schema + ", rank int")
    dim = most["d"]
    blocks = max(1, math.ceil(most["n"] * (dim * 8 + k * 16) / QUERY_BYTES))
    dealt = known.where(F.size("query") == dim).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    rows = records.select("concept", F.col("q").cast("array<double>").alias("q"))

    def passed(block: int) -> DataFrame:
        got = dealt.where(F.col("block") == block).select("query_id", "query").toArrow()  # about QUERY_BYTES
        column = got.column(1).combine_chunks()
        x, ok = _matrix(column, dim)
        shared = records.sparkSession.sparkContext.broadcast((got.column(0).to_numpy()[ok], x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best, wide = Best(len(ids), k), max(1, SCORES // BATCH)
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    part = b.slice(at, BATCH)
                    own, fine = _matrix(part.column(1), dim)
                    if not len(own):
                        continue
                    best.start(part.column(0).filter(pa.array(fine)))
                    for first in range(0, len(ids), wide):
                        scores = own @ asked[first : first + wide].T
                        np.clip(scores, -1.0, 1.0, out=scores)
                        scores *= 1e6
                        scores += 0.5
                        np.floor(scores, out=scores)
                        scores /= 1e6
                        best.offer(first, scores)
                    best.settle()
            for first in range(0, len(ids), wide):
                query, place = np.nonzero(best.at[first : first + wide] >= 0)
                query += first
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), best.names.take(pa.array(best.at[query, place])), pa.array(best.scores[query, place])], ["query_id", "concept", "score"])

        return rows.where("concept IS NOT NULL").mapInArrow(run, schema)

    found = passed(0)
    for n in range(1, blocks):
        found = found.unionByName(passed(n))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "concept")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context_bake(records: DataFrame, asked: DataFrame, fixed: list[str], most: int) -> DataFrame:
    """``section, position, concept, score``: what a context is made of.

    The ``fixed`` names that exist, in their order; the ``most`` records that any of the queries (query_id, query) finds best;
    the ``most`` of latest ``ts``. A record may stand in several sections. ``records``: concept, q, ts.
    """
    names = records.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(fixed)], "position int, concept string")
    first = F.broadcast(names).join(records.select("concept").distinct(), "concept")  # a fixed list
    top = recall_many(records, asked, most).groupBy("concept").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "concept").limit(most)
    recent = records.groupBy("concept").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "concept").limit(most)
    at = lambda *by: F.row_number().over(Window.orderBy(*by)).alias("position")
    none = F.lit(None).cast("double").alias("score")
    parts = [
        first.select(F.lit("fixed").alias("section"), "position", "concept", none),
        top.select(F.lit("top").alias("section"), at(F.desc("score"), "concept"), "concept", "score"),  # ``most`` rows
        recent.select(F.lit("recent").alias("section"), at(F.desc("ts"), "concept"), "concept", none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
