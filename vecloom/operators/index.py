"""A stored index of vectors: cells around centroids in two levels, of which a search reads the nearest.

About sqrt(n) cells: regions around centroids fitted on a bounded sample (``SAMPLE`` rows of least hash), and in
each region cells around centroids fitted on its own part of a second sample (``PER_CELL`` rows a cell), one task a
region. Every row with a direction is assigned and stored in the folder of its cell, with int8 codes beside the
vector. A search prunes to the folders it probes, reads codes alone there, and scores exactly the ``widen`` x k rows of
each query that the codes put first. Rows that come later join their cells by the stored centroids; what a
version of the index holds appears at once (``sources.versions``).

How many cells a search has to probe is measured, not assumed: ``calibrate`` stores the least number of cells that hold
the target's share of what ``ASKED`` stored rows find in all cells. Null, empty and zero vectors and those of another
length than the sample's are kept out of the index. A name that is stored already is not registered again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.vector_udf import unit
from ..shared import cut
from ..sources.versions import Store

SAMPLE = 4096
PER_CELL = 32
#: Bytes of centroids that tasks hold: bounds the number of cells.
CENTROIDS = 64 << 20
ASKED = 64
#: Scores of rows against centroids that a task computes at a time.
SCORES = 1 << 18
ENTRIES = "cell int, concept string, q array<double>, code array<tinyint>"
CELLS = "cell int, center array<double>"


def lloyd(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit rows, as many as there are different ones at most."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(cells, len(c))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1) if len(c) else np.zeros(0, int)
        for k in np.unique(near):
            c[k] = x[near == k].sum(axis=0)
        c = unit(c)
    return c


def _rows(q: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of those vectors that have a direction and the right length, and which those are."""
    ok = np.array([v is not None and len(v) == dim for v in q], bool)
    x = np.array([np.asarray(v, np.float64) for v in q[ok]]).reshape(int(ok.sum()), dim)
    fine = np.isfinite(x).all(axis=1) & (np.linalg.norm(x, axis=1) > 0)
    ok[np.flatnonzero(ok)[~fine]] = False
    return unit(x[fine]), ok


def nearest(centroids: np.ndarray, most: int):
    """A Pandas UDF: the ``most`` nearest centroids of each vector, the nearest first; null for one without a direction."""

    @F.pandas_udf("array<int>")
    def run(q: pd.Series) -> pd.Series:
        x, ok = _rows(q, centroids.shape[1])
        out: list = [None] * len(q)
        at, step = np.flatnonzero(ok), max(1, SCORES // len(centroids))
        for lo in range(0, len(x), step):  # a part of the batch at a time, so that memory does not grow with the cells
            near = x[lo : lo + step] @ centroids.T
            first = near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]
            for k, row in zip(at[lo : lo + step].tolist(), first.astype(np.int32)):
                out[k] = row
        return pd.Series(out, dtype=object)

    return run


def fit(records: DataFrame, cells: int | None = None) -> np.ndarray:
    """The centroids of all cells (rows of a matrix); ``cells`` is about sqrt(n) unless given."""
    known = records.where(F.size("q") > 0).select("concept", "q")
    dim = known.groupBy(F.size("q").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dim is None:
        return np.zeros((0, 0))
    known, d = known.where(F.size("q") == dim["d"]), dim["d"]
    cells = max(1, min(cells or math.isqrt(dim["n"]), CENTROIDS // (8 * d)))
    first = known.orderBy(F.xxhash64("concept"), "concept").limit(SAMPLE).select("q").toPandas()["q"]
    x, _ = _rows(first, d)
    regions = lloyd(x, math.isqrt(cells))
    if not len(regions):
        return regions
    per = -(-cells // len(regions))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        own, _ = _rows(rows["q"], d)
        return pd.DataFrame({"center": list(lloyd(own, per))})

    # the second sample, about PER_CELL rows a cell; a region has a bounded part of it, by hash
    share = min(1.0, PER_CELL * cells / dim["n"])
    part = known.where(F.pmod(F.xxhash64("concept", F.lit(1)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    part = part.withColumn("region", F.get(nearest(regions, 1)("q"), F.lit(0))).where("region IS NOT NULL")
    bounded = part.withColumn("_n", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("concept"), "concept"))).where(F.col("_n") <= 4 * PER_CELL * per)
    centers = bounded.groupBy("region").applyInPandas(split, "center array<double>").toPandas()["center"]  # CENTROIDS bytes at most
    return np.array([np.asarray(c) for c in centers]).reshape(len(centers), d) if len(centers) else regions


@dataclass
class Index:
    store: Store
    version: int

    @staticmethod
    def build(spark: SparkSession, records: DataFrame, cells: int | None = None, name: str = "index") -> Index:
        """``records``: concept, q."""
        centroids = fit(records, cells)
        store = Store.fresh(spark, name)
        # a part of the table for each cell, so that a cell is a folder
        store.create(entries=(ENTRIES, ["cell", "concept"], max(1, len(centroids))), cells=(CELLS, ["cell"], 1))
        with store.change() as c:
            c.upsert("cells", spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centroids)], CELLS))
        index = Index(store, store.versions()[-1])
        return index.register(records)

    @staticmethod
    def open(spark: SparkSession, root: str) -> Index:
        store = Store(spark, root)
        return Index(store, store.versions()[-1])

    def centroids(self) -> np.ndarray:
        got = self.store.read("cells", self.version).orderBy("cell").toPandas()["center"]
        return np.array([np.asarray(c) for c in got]) if len(got) else np.zeros((0, 0))

    def entries(self) -> DataFrame:
        return self.store.read("entries", self.version)

    def register(self, records: DataFrame) -> Index:
        """Adds the rows whose names are not stored, to the cells as they were fitted; only their cells' files change."""
        centroids = self.centroids()
        if not len(centroids):
            return self
        new = records.join(self.entries().select("concept"), "concept", "left_anti")
        new = new.withColumn("cell", F.get(nearest(centroids, 1)("q"), F.lit(0))).where("cell IS NOT NULL")
        with self.store.change() as c:
            c.put_parts("entries", new.select("cell", "concept", F.col("q").cast("array<double>").alias("q"), V.int8_codes(F.col("q")).alias("code")), "cell")
        return Index(self.store, self.store.versions()[-1])

    def probed(self, queries: DataFrame, probe: int) -> DataFrame:
        """``query_id, query, place, cell`` for the ``probe`` nearest cells of each query, the nearest in place 0."""
        return queries.select("query_id", "query", F.posexplode(nearest(self.centroids(), probe)("query")).alias("place", "cell"))

    def calibrate(self, k: int, target: float = 0.9) -> int:
        """The least number of cells to probe that finds ``target`` of the first ``k`` of stored rows; kept as a mark.

        One search through all cells tells in which place of a query's cells each of its best rows lies.
        """
        name, marks = f"probe:{self.version}:{k}:{target}", self.store.marks()
        if name not in marks:
            asked = self.entries().orderBy(F.xxhash64("concept", F.lit(2)), "concept").limit(ASKED).select(F.col("concept").alias("query_id"), F.col("q").alias("query"))
            asked = cut(asked, "asked", stay=True)
            places = self._best(asked, k, max(1, len(self.centroids())), 4).groupBy("place").count().orderBy("place").collect()  # a row for each cell at most
            hits = np.cumsum([r["count"] for r in places])
            probe = int(places[int(np.searchsorted(hits, target * hits[-1]))]["place"]) + 1 if len(hits) else 1
            with self.store.change() as c:
                c.mark(name, str(probe))
            return probe
        return int(marks[name])

    def search(self, queries: DataFrame, k: int, probe: int, widen: int = 4) -> DataFrame:
        """``query_id, concept, score, rank`` of the k best rows of each query (query_id, query) in the cells it probes."""
        return self._best(queries, k, probe, widen).drop("place")

    def _best(self, queries: DataFrame, k: int, probe: int, widen: int) -> DataFrame:
        if not len(self.centroids()):
            return queries.limit(0).select("query_id", F.lit("").alias("concept"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0).alias("place"))
        asked = cut(self.probed(queries, probe), "asked", stay=True)
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # as many as the index has at most
        met = self.store.read_parts("entries", cells, self.version)
        # queries travel to the cells; of most rows no more is read than their codes
        wide = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
        coded = asked.select("query_id", "place", "cell", V.int8_codes(F.col("query")).alias("asked"))
        near = met.select("concept", "code", "cell").join(coded, "cell").select("query_id", "place", "cell", "concept", V.dot(wide("code"), wide("asked")).alias("near"))
        by = Window.partitionBy("query_id")  # limited in every task before the exchange
        best = near.withColumn("_n", F.row_number().over(by.orderBy(F.desc("near"), "concept"))).where(F.col("_n") <= k * widen)
        found = best.select("query_id", "place", "cell", "concept").join(queries, "query_id").join(met.select("cell", "concept", "q"), ["cell", "concept"])
        scored = found.select("query_id", "concept", F.round(V.cosine(F.col("q"), F.col("query")), 6).alias("score"), "place")
        return scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "concept"))).where(F.col("rank") <= k).select("query_id", "concept", "score", "rank", "place")
