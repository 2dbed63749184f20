"""Event feeds: tailing with dedup, sessions, leases, gates; and sinks.

Streams are read with a schema, watermarked, and written with checkpoints under the shared folder;
``availableNow`` replays a finite input to the end, which makes the results testable in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vecloom.shared import shared_path

#: Rows that leases fold and hand on at a time.
SLICE = 10_000


def replay(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a finite stream to its end into Parquet and read the result."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    q = stream.writeStream.format("parquet").option("checkpointLocation", shared_path(spark, f"{name}-state")).outputMode(mode).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder (a file or a folder of files) as a stream; times without zone become instants."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    s = reader.parquet(path) if _is_dir(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return s.withColumns({c: F.col(c).cast("timestamp") for c, t in s.dtypes if t == "timestamp_ntz"})


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def deduplicated(feed: DataFrame, keys: list[str], ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: state is bounded by the delay, not by a count."""
    return feed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def poll(feed: DataFrame, since, limit: int, keys: list[str]) -> DataFrame:
    """Batch form: distinct events after a time, the newest first, 1 to 80 of them."""
    return feed.where(F.col("ts") > since).dropDuplicates(keys).orderBy(F.desc("ts"), *keys).limit(max(1, min(80, limit)))


def sessions(feed: DataFrame, by: str, gap: str = "30 minutes", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Turns: runs of a key's events with no gap longer than ``gap``."""
    s = feed.withWatermark(ts, delay) if feed.isStreaming else feed
    g = s.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return g.select(by, "first_ts", "last_ts", "n")


def windows(feed: DataFrame, by: str, width: str, slide: str | None = None, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    s = feed.withWatermark(ts, delay) if feed.isStreaming else feed
    g = s.groupBy(by, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(by, F.col("w.start").alias("start"), "n", "total")


class Leases(StatefulProcessor):
    """One lease per resource: a request is granted if none is live or the same holder asks again.

    Rows: resource, holder, ts (microseconds), order. A lease lives ``ttl`` microseconds from its grant.
    Each batch of a resource is taken in order of time; it waits as three numbers a row and is folded a slice at a time.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lease = handle.getValueState("lease", "holder long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        parts = [part[["ts", "order", "holder"]].to_numpy(np.int64) for part in rows]
        batch = np.concatenate(parts)
        del parts
        place = np.lexsort((batch[:, 1], batch[:, 0]))
        live = self.lease.get() if self.lease.exists() else None
        holder, until = live if live is not None else (0, None)
        for at in range(0, len(place), SLICE):
            part = batch[place[at : at + SLICE]]
            out = []
            for ts, _, asks in part.tolist():
                ok = until is None or until <= ts or holder == asks
                if ok:
                    holder, until = asks, ts + self.ttl
                out.append(ok)
            yield pd.DataFrame({"resource": key[0], "order": part[:, 1], "holder": part[:, 2], "granted": out})
        if until is not None:
            self.lease.update((holder, until))

    def close(self) -> None:
        pass


LEASE_ROWS = "resource string, order long, holder long, granted boolean"


def leases(requests: DataFrame, ttl_us: int) -> DataFrame:
    """``requests`` (a stream): resource, holder, ts, order."""
    return requests.groupBy("resource").transformWithStateInPandas(Leases(ttl_us), LEASE_ROWS, "Append", "None")


def lease_fold(rows: list[tuple[int, int, int]], ttl_us: int) -> list[bool]:
    """The same rule over ``(ts, order, holder)`` in a plain loop, for tests."""
    live, out = None, []
    for ts, _, holder in sorted(rows):
        ok = live is None or live[1] <= ts or live[0] == holder
        live = (holder, ts + ttl_us) if ok else live
        out.append(ok)
    return out


def branch_states(events: DataFrame) -> DataFrame:
    """``branch, state``: the last of open, merged and abandoned; nothing follows a merge or an abandonment.

    ``events``: branch, ts, action.
    """
    end = F.min(F.when(F.col("action").isin("merged", "abandoned"), F.struct("ts", "action")))
    return events.groupBy("branch").agg(F.coalesce(end["action"], F.max_by("action", "ts")).alias("state"))


def sink_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, every: str = "5 seconds"):
    """Start a query that hands each micro-batch to ``write``; its id makes rewrites idempotent."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(stream.sparkSession, name)).trigger(processingTime=every).start()


def watch_folder(spark: SparkSession, path: str, schema: str, pattern: str = "*.json", clean: str | None = None) -> DataFrame:
    """JSON requests dropped into a folder; with ``clean`` finished files go to that archive."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if clean:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", clean)
    return r.json(path)
