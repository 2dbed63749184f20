"""Best overlap of many token sets with a few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most tokens of the small side that tasks hold; beyond it the sets meet by a join.
HELD = 4_000_000


def best_overlap(many: DataFrame, few: DataFrame) -> DataFrame:
    """``many`` (doc_id, a) with ``overlap``: the greatest Jaccard overlap of ``a`` with any set ``b`` of ``few`` (item_id, b); 0 if none shares a token.

    The small side's index from tokens to sets goes to all tasks if it has ``HELD`` tokens at most (counted first): rows are then
    scored where they lie, one count per token and set. Sets without tokens overlap with nothing.
    """
    total = few.agg(F.sum(F.size("b"))).first()[0] or 0
    if total > HELD:
        n = many.withColumn("_row", F.monotonically_increasing_id()).select("doc_id", "_row", F.size("a").alias("na"), F.explode_outer("a").alias("w"))
        m = few.withColumn("_set", F.monotonically_increasing_id()).select("_set", F.size("b").alias("nb"), F.explode("b").alias("w"))
        both = n.join(m, "w", "left").groupBy("_row", "doc_id", "na", "_set", "nb").agg(F.count("_set").alias("n"))
        return both.groupBy("_row", "doc_id").agg(F.coalesce(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))), F.lit(0.0)).alias("overlap")).drop("_row")
    sets = [r["b"] or [] for r in few.select("b").collect()]  # HELD tokens at most
    sizes = np.array([len(b) for b in sets], np.int64)
    words = pa.array([w for b in sets for w in b], pa.string()).dictionary_encode()
    of, at = np.repeat(np.arange(len(sets)), sizes), words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(words.dictionary) + 1))
    shared = many.sparkSession.sparkContext.broadcast((words.dictionary, starts, of[order], sizes))
    kind = dict(many.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts, of, sizes = shared.value
        for b in batches:
            lists = b.column(1)
            place = pc.index_in(lists.flatten(), known)
            found = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            out, end = np.zeros(len(each)), np.cumsum(each)
            for k, (stop, n) in enumerate(zip(end.tolist(), each.tolist())):
                own = found[stop - n : stop]
                own = own[own >= 0]
                if len(own):
                    count = np.bincount(np.concatenate([of[starts[w] : starts[w + 1]] for w in own]), minlength=len(sizes))
                    out[k] = (count / np.maximum(n + sizes - count, 1)).max()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "overlap"])

    return many.select("doc_id", "a").mapInArrow(run, f"doc_id {kind}, overlap double")
