"""Event-time folds, gates, chains and declared processes over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..shared import shared_path
from ..sources.tables import table
from ..streaming import chains as C
from ..streaming import feed as S
from ..streaming import ordered as O
from .registry import query

DAY, HOUR = 86_400_000_000, 3_600_000_000


def _passed(slot: int) -> str:
    """SQL: slots of the events that the watermark has passed at the end of the input."""
    return f"p AS (SELECT {slot} AS slot, (max(epoch_us(ts)) // 1000) * 1000 AS wm FROM events), seen AS (SELECT *, epoch_us(ts) AS us FROM events, p WHERE (epoch_us(ts) // slot + 1) * slot <= wm)"


_KIND = "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'update' WHEN event_type <> 'error' THEN 'context' WHEN value > 100 THEN 'ack' ELSE 'end' END"


def _kind():
    t = F.col("event_type")
    return F.when(t == "signup", "start").when(t == "purchase", "update").when(t != "error", "context").when(F.col("value") > 100, "ack").otherwise("end")


@query(
    f"""WITH RECURSIVE {_passed(DAY)},
    e AS (SELECT user_id AS key, event_id AS seq, us, {_KIND} AS kind, CASE WHEN event_type <> 'error' THEN floor(value / 40)::BIGINT END AS locus, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM seen),
    w AS (SELECT DISTINCT key, 0::BIGINT AS rn, 0::BIGINT AS seq, 0::BIGINT AS us, 0::BIGINT AS locus, NULL::VARCHAR AS what, 0::BIGINT AS pending, 0::BIGINT AS attempts, false AS active, []::STRUCT(locus BIGINT, due BIGINT)[] AS debts FROM e
      UNION ALL SELECT key, rn, seq, us, locus, what, len(live)::BIGINT, CASE WHEN kind IN ('start', 'end') THEN 0 WHEN what = 'blocked' THEN attempts + 1 ELSE attempts END, CASE WHEN kind IN ('start', 'end') THEN kind = 'start' ELSE active END,
        CASE WHEN kind IN ('start', 'end', 'ack') THEN [] WHEN kind = 'update' THEN list_filter(live, lambda d: d.locus <> locus) WHEN what = 'allowed' THEN list_append(live, {{'locus': locus, 'due': us + {2 * DAY}}}) ELSE live END
      FROM (SELECT *, CASE WHEN kind <> 'context' THEN NULL WHEN NOT active THEN 'unguarded' WHEN list_contains(list_transform(live, lambda d: d.locus), locus) THEN 'blocked' ELSE 'allowed' END AS what
        FROM (SELECT e.key, e.rn, e.seq, e.us, e.locus, e.kind, w.active, w.attempts, list_filter(w.debts, lambda d: d.due > e.us) AS live FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1))),
    lapsed AS (SELECT o.key, o.seq FROM w o, p WHERE o.what = 'allowed' AND ((o.us + {2 * DAY} + slot - 1) // slot) * slot <= wm AND NOT EXISTS (
      SELECT 1 FROM e x WHERE x.key = o.key AND x.rn > o.rn AND x.us < o.us + {2 * DAY} AND (x.kind IN ('start', 'end', 'ack') OR (x.kind = 'update' AND x.locus = o.locus))))
    SELECT key, seq, what, pending, CASE WHEN what = 'unguarded' THEN 0 ELSE attempts END AS attempts FROM w WHERE what IS NOT NULL UNION ALL SELECT key, seq, 'lapsed', 0, 0 FROM lapsed"""
)
def stream_edit_gate(spark, sf_dir):
    """A user's views and clicks read a locus for an edit, purchases update it, signups start sessions; debts lapse after two days."""
    e = S.read_table(O.stateful_session(spark), sf_dir, "events")
    locus = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 40))
    rows = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), _kind().alias("kind"), locus.alias("locus"))
    out = S.replay(O.folded(rows, O.EditGate(2 * DAY), "1 day"), "gate")
    return spark.read.schema(out.schema).parquet(*out.inputFiles()) if out.inputFiles() else out


@query(
    f"""WITH {_passed(DAY)}, f AS (SELECT user_id AS key, min(us) AS first FROM seen GROUP BY 1), q AS (SELECT * FROM (VALUES ('12h', {12 * HOUR}), ('2d', {2 * DAY})) AS x(period, us)),
    t AS (SELECT key, period, unnest(generate_series((first // us + 1) * us, wm, us)) AS tick_us FROM f, q, p)
    SELECT key, period, tick_us FROM t, p WHERE ((tick_us + slot - 1) // slot) * slot <= wm"""
)
def stream_ticks(spark, sf_dir):
    """Every twelve hours and every two days for each user since the first event, whether others follow or not."""
    e = S.read_table(O.stateful_session(spark), sf_dir, "events")
    return S.replay(O.folded(e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq")), O.Ticks({"12h": 12 * HOUR, "2d": 2 * DAY}), "1 day"), "ticks")


@query(
    f"""WITH {_passed(HOUR)}, g AS (SELECT event_type AS key, us, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) <= 1500000 THEN 0 ELSE 1 END AS new, event_id FROM seen),
    b AS (SELECT key, us, sum(new) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS b FROM g), r AS (SELECT key, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM b GROUP BY key, b.b)
    SELECT r.* FROM r, p WHERE ((last_us + 1500001 + slot - 1) // slot) * slot <= wm"""
)
def stream_debounce(spark, sf_dir):
    """Events of a type within a second and a half of one another are one."""
    e = S.read_table(O.stateful_session(spark), sf_dir, "events")
    return S.replay(O.folded(e.select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq")), O.Debounce(1_500_000), "1 hour"), "bursts")


@query(
    """WITH t AS (SELECT user_id, ts, event_id, 'trace:' || (epoch_us(ts) // 1000000) || '_' || regexp_replace(lower((event_type || ' ' || event_id)[1:48]), '[^a-z0-9-]', '-', 'g') || '-' || event_id AS name FROM events),
    l AS (SELECT name, lag(name) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM t)
    SELECT prev AS src, 'prev_in_trace' AS label, name AS dst FROM l WHERE prev IS NOT NULL UNION ALL SELECT name, 'next_in_trace', prev FROM l WHERE prev IS NOT NULL"""
)
def stream_trace_chains(spark, sf_dir):
    """A chain of traces for each user, over micro-batches of a third of the time each."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    path = shared_path(spark, "arrivals")
    third = F.floor(3 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp"))) / F.greatest(F.unix_micros(F.lit(hi).cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp")), F.lit(1)))
    rows = e.select(F.concat(F.lit("user:"), "user_id").alias("chain"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "event_id").alias("decision"), F.lit(None).cast("string").alias("why"))
    for k in range(3):  # one file after the other, as they arrive
        rows.where(F.least(third, F.lit(2)) == k).coalesce(1).write.mode("append").parquet(path)
    store = C.chain_store(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.writeStream.foreachBatch(C.sink(store)).option("checkpointLocation", shared_path(spark, "chains-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read("edges")


@query(
    f"""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'ack' WHEN event_type <> 'error' THEN 'context' ELSE 'end' END AS kind, CASE WHEN event_type = 'signup' THEN floor(value)::BIGINT % 3 ELSE 0 END AS n FROM events),
    s AS (SELECT *, count(*) FILTER (kind IN ('start', 'end')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
    b AS (SELECT *, first_value(kind) OVER w = 'start' AS active, first_value(n) OVER w AS queue, count(*) FILTER (kind = 'ack') OVER (PARTITION BY user_id, s ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS acks FROM s WINDOW w AS (PARTITION BY user_id, s ORDER BY ts, event_id)),
    c AS (SELECT *, active AND s > 0 AS live, queue = 0 OR acks > 0 AS acked FROM b),
    r AS (SELECT *, count(*) FILTER (live AND NOT acked AND kind = 'context') OVER (PARTITION BY user_id, s ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS tries FROM c)
    SELECT user_id, event_id, CASE WHEN NOT live THEN 'unguarded' WHEN acked THEN 'allowed' ELSE 'blocked' END AS what, CASE WHEN live THEN tries ELSE 0 END AS attempts FROM r WHERE kind = 'context'"""
)
def wake_queue_gate(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "signup", "start").when(t == "purchase", "ack").when(t != "error", "context").otherwise("end")
    queue = F.when(t == "signup", F.floor("value") % 3).otherwise(0)
    return G.wake_queue_gate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind, queue, hard=True).select("user_id", "event_id", "what", "attempts")


#: Declared processes: name, starting product, products in order, timeout in hours.
PROCESSES = [
    ("process:sale", "signup", ["view", "purchase"], 72),
    ("process:care", "error", ["click", "view", "click"], 120),
    ("process:repeat", "purchase", ["purchase"], 24),
    ("process:note", "click", [], 1),
    ("process:unused", "refund", ["view"], 24),
]


def _process_sql() -> str:
    rules = ", ".join(f"('{n}', '{s}', {p}::VARCHAR[], {h * HOUR})" for n, s, p, h in PROCESSES)
    step = "coalesce((SELECT min((us, event_id)) FROM events_us e WHERE e.user_id = {r}.user_id AND e.event_type = {r}.products[{k}] AND (e.us, e.event_id) > {r}.pos AND e.us <= {r}.until), NULL)"
    out = f"WITH rules AS (SELECT * FROM (VALUES {rules}) AS x(process, starts, products, timeout)), events_us AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events), r0 AS (SELECT process, user_id, event_id AS start_id, us AS start_us, products, us + timeout AS until, 0 AS n_done, (us, event_id) AS pos FROM events_us JOIN rules ON event_type = starts)"
    for k in range(1, 4):
        r = f"r{k - 1}"
        out += f", n{k} AS (SELECT *, CASE WHEN len(products) >= {k} AND n_done = {k - 1} THEN {step.format(r=r, k=k)} END AS nx FROM {r}), r{k} AS (SELECT process, user_id, start_id, start_us, products, until, n_done + (nx IS NOT NULL)::INT AS n_done, coalesce(nx, pos) AS pos FROM n{k})"
    return out + ", d AS (SELECT process, start_id, n_done, pos[1] - start_us AS done_us, CASE WHEN n_done = len(products) THEN 'complete' WHEN n_done > 0 THEN 'partial' ELSE 'none' END AS outcome FROM r3)"


def _declared(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), F.col("event_type").alias("product"))
    rules = spark.createDataFrame([(n, s, p, h * HOUR) for n, s, p, h in PROCESSES], G.DECLARED)
    return G.process_runs(e, rules), rules


@query(f"{_process_sql()} SELECT process, start_id, n_done, done_us, outcome FROM d")
def process_runs(spark, sf_dir):
    return _declared(spark, sf_dir)[0].select("process", "start_id", "n_done", "done_us", "outcome")


@query(
    f"""{_process_sql()} SELECT process, count(start_id) AS runs, count(*) FILTER (outcome = 'complete') AS complete, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'none') AS none,
    round(avg(done_us) FILTER (outcome = 'complete'), 3) AS mean_us FROM rules LEFT JOIN d USING (process) GROUP BY process"""
)
def process_metrics(spark, sf_dir):
    return G.process_metrics(*_declared(spark, sf_dir))
