"""Event-time folds against plain loops, chains over batches cut anywhere, gates and declared processes on fixtures."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from vecloom.operators import gates as G
from vecloom.shared import shared_path
from vecloom.streaming import chains as C
from vecloom.streaming import feed as S
from vecloom.streaming import ordered as O

MINUTE = 60_000_000
START = 1_700_000_040_000_000  # a whole minute


def stream_of(spark, folder, batches, fields):
    """A stream of files, one for each batch of rows ``(key, us, seq, ...)``."""
    names = ["key", "us", "seq", *[f.split()[0] for f in fields]]
    for k, rows in enumerate(batches):
        lines = [json.dumps(dict(zip(names, r)) | {"ts": datetime.fromtimestamp(r[1] / 1e6, UTC).isoformat()}) for r in rows]
        (folder / f"{k:03}.json").write_text("\n".join(lines))
    own = O.stateful_session(spark)
    schema = ", ".join(["key long", "us long", "seq long", "ts timestamp", *fields])
    return own.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def plain(fold, rows, slot):
    """The fold of each key in a loop, up to where the watermark stands at the end."""
    upto, out = max(r[1] for r in rows) // 1000 * 1000, []
    for key in sorted({r[0] for r in rows}):
        out += [(key, *x) for x in fold.whole(key, [(r[1], r[2], list(r[3:])) for r in rows if r[0] == key], upto, slot)]
    return sorted(map(tuple, out), key=str)


def gate_rows(n, hot=0.6):
    rnd, rows, us = random.Random(11), [], START
    for k in range(n):
        us += rnd.randrange(40_000_000)
        kind = rnd.choices(["context", "update", "ack", "start", "end"], [10, 3, 1, 2, 1])[0]
        rows.append((0 if rnd.random() < hot else rnd.randrange(1, 5), us, k, kind, None if kind == "ack" and rnd.random() < 0.5 else rnd.randrange(4)))
    return rows


@pytest.mark.parametrize("cuts", [[0, 300], [0, 40, 100, 290, 300]])
def test_edit_debts_whatever_the_batches(spark, tmp_path, cuts):
    rows = gate_rows(300)
    batches = [random.Random(a).sample(rows[a:b], b - a) for a, b in zip(cuts, cuts[1:])]  # in no order within a batch
    fold = O.EditGate(5 * MINUTE)
    got = S.replay(O.folded(stream_of(spark, tmp_path, batches, ["kind string", "locus long"]), fold, "1 minute"), "gate")
    want = plain(fold, rows, MINUTE)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[2] for w in want} == {"allowed", "blocked", "unguarded", "lapsed"}


def run(fold, *rows):
    state, out = {}, []
    for k, (ts, kind, locus) in enumerate(rows):
        out += fold.row(1, state, ts, k, [kind, locus])
    return [(seq, what, attempts) for seq, what, _, attempts in out]


def test_rules_of_debts():
    g = O.EditGate(100)
    assert run(g, (0, "context", 1)) == [(0, "unguarded", 0)]
    assert run(g, (0, "start", None), (1, "context", 1), (2, "context", 1), (3, "context", 2), (4, "update", 1), (5, "context", 1)) == [(1, "allowed", 0), (2, "blocked", 1), (3, "allowed", 1), (5, "allowed", 1)]
    assert run(g, (0, "start", None), (1, "context", 1), (2, "ack", None), (3, "context", 1)) == [(1, "allowed", 0), (3, "allowed", 0)]
    assert run(g, (0, "start", None), (1, "context", 1), (101, "context", 1)) == [(1, "allowed", 0), (1, "lapsed", 0), (2, "allowed", 0)]
    assert run(O.EditGate(100, hard=False), (0, "start", None), (1, "context", 1), (2, "context", 1)) == [(1, "allowed", 0), (2, "warned", 1)]
    assert run(g, (0, "start", None), (1, "context", 1), (2, "end", None), (3, "context", 1)) == [(1, "allowed", 0), (3, "unguarded", 0)]


def test_bursts_and_ticks_of_quiet_keys(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "t").mkdir()
    s = 1_000_000
    rows = [(1, START, 0), (1, START + s, 1), (1, START + 2 * s + 400_000, 2), (1, START + 20 * s, 3), (2, START + 5 * s, 4), (1, START + 600 * s, 5)]
    fold = O.Debounce(1_500_000)
    fold.schema = fold.schema.replace("key string", "key long")
    got = S.replay(O.folded(stream_of(spark, tmp_path / "b", [rows[:1], rows[1:]], []), fold, "1 minute"), "bursts")
    assert sorted(map(tuple, got.collect())) == [(1, START, START + 2_400_000, 3), (1, START + 20 * s, START + 20 * s, 1), (2, START + 5 * s, START + 5 * s, 1)]
    ticks = O.Ticks({"2m": 2 * MINUTE, "5m": 5 * MINUTE})
    got = S.replay(O.folded(stream_of(spark, tmp_path / "t", [rows[:3], rows[3:5], rows[5:]], []), ticks, "1 minute"), "ticks")
    assert sorted(map(tuple, got.collect()), key=str) == plain(ticks, rows, MINUTE)
    assert got.where("key = 2").groupBy("period").count().count() == 2  # no row came for it in all that time


def test_a_restarted_stream_repeats_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, out, state = gate_rows(120), str(tmp_path / "out"), shared_path(spark, "restart")
    fold = O.EditGate(5 * MINUTE)
    for upto in (40, 40, 120):  # the second run has no input
        s = stream_of(spark, tmp_path / "in", [rows[:40], *([rows[40:]] if upto > 40 else [])], ["kind string", "locus long"])
        q = O.folded(s, fold, "1 minute").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(f"file://{out}")
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.schema(fold.schema).parquet(f"file://{out}").collect()), key=str) == plain(fold, rows, MINUTE)


def test_leases_in_event_time(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k % 3, START + rnd.randrange(40 * MINUTE), k, rnd.randrange(4)) for k in range(200)]
    fold = O.Lease(3 * MINUTE)
    fold.schema = fold.schema.replace("key string", "key long")
    got = S.replay(O.folded(stream_of(spark, tmp_path, [rows], ["holder long"]), fold, "1 minute"), "leases")
    upto = max(r[1] for r in rows) // MINUTE * MINUTE
    want = []
    for key in range(3):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key and r[1] < upto)
        want += [(key, seq, holder, ok) for (_, seq, holder), ok in zip(own, S.lease_fold(own, 3 * MINUTE))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


# ---- chains ---------------------------------------------------------------------------------

ROWS = "chain string, ts timestamp, seq long, decision string, why string"


def arrivals(spark, rows):
    return spark.createDataFrame([(c, datetime.fromtimestamp(1_700_000_000 + t, UTC), t, f"Fix {t}: é", None) for c, t in rows], ROWS)


def test_chains_are_the_same_however_batches_are_cut(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"c{rnd.randrange(4)}", t) for t in range(60)]
    edges = []
    for cuts in ([0, 60], [0, 1, 20, 20, 41, 60]):
        store = C.chain_store(spark, 3, "test-chains")
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            C.append(store, arrivals(spark, rows[a:b]), n)
        edges.append(sorted(map(tuple, store.read("edges").collect())))
        assert store.read("traces").count() == 60 and store.read("heads").count() == len({c for c, _ in rows})
    assert edges[0] == edges[1]
    name = lambda t: f"trace:{1_700_000_000 + t}_fix-{t}----{t}"
    last, want = {}, []
    for c, t in rows:
        if c in last:
            want += [(name(last[c]), "prev_in_trace", name(t)), (name(t), "next_in_trace", name(last[c]))]
        last[c] = t
    assert edges[0] == sorted(want)


def test_a_batch_that_comes_again_writes_nothing(spark, monkeypatch):
    store = C.chain_store(spark, 2, "test-chains")
    first = arrivals(spark, [("c", 1), ("c", 2)])
    v = C.append(store, first, 0)
    assert C.append(store, first, 0) == v and store.versions()[-1] == v
    from vecloom.sources.versions import Change

    whole = Change.upsert
    monkeypatch.setattr(Change, "upsert", lambda self, t, rows: (_ for _ in ()).throw(RuntimeError("killed")) if t == "heads" else whole(self, t, rows))
    with pytest.raises(RuntimeError, match="killed"):  # between edges and heads
        C.append(store, arrivals(spark, [("c", 3)]), 1)
    monkeypatch.undo()
    assert store.read("edges").count() == 2
    C.append(store, arrivals(spark, [("c", 3)]), 1)
    assert store.read("edges").count() == 4 and store.read("heads").first()["seq"] == 3
    C.append(store, arrivals(spark, [(None, 9)]), 2)
    assert store.read("traces").count() == 3 and store.marks() == {"batch": "2"}


# ---- gates and processes --------------------------------------------------------------------


def test_wake_queue_rules(spark):
    rows = [(1, 0, "context", 0), (1, 1, "start", 2), (1, 2, "context", 0), (1, 3, "context", 0), (1, 4, "ack", 0), (1, 5, "context", 0), (1, 6, "start", 0), (1, 7, "context", 0), (1, 8, "start", 1), (1, 9, "context", 0), (1, 10, "end", 0), (1, 11, "context", 0)]
    df = spark.createDataFrame(rows, "s long, t long, k string, n long")
    got = G.wake_queue_gate(df, "s", ["t"], F.col("k"), F.col("n"), hard=True).orderBy("t").select("t", "what", "attempts").collect()
    assert [tuple(r) for r in got] == [(0, "unguarded", 0), (2, "blocked", 1), (3, "blocked", 2), (5, "allowed", 2), (7, "allowed", 0), (9, "blocked", 1), (11, "unguarded", 0)]


def brute_runs(events, rules):
    out = []
    for process, starts, products, timeout in rules:
        for key, us, i, product in events:
            if product != starts:
                continue
            at, n = (us, i), 0
            for u, j, p in sorted((u, j, p) for k, u, j, p in events if k == key):
                if n < len(products) and (u, j) > at and p == products[n] and u <= us + timeout:
                    at, n = (u, j), n + 1
            out.append((process, key, i, n, at[0] - us, "complete" if n == len(products) else "partial" if n else "none"))
    return sorted(out)


def test_declared_processes_against_a_loop(spark):
    rnd = random.Random(2)
    events = [(0 if rnd.random() < 0.5 else rnd.randrange(1, 4), rnd.randrange(300), k, rnd.choice("abcd")) for k in range(150)]
    rules = [("p", "a", ["b", "c"], 60), ("same", "a", ["a", "a", "b"], 200), ("bare", "d", [], 1), ("never", "z", ["a"], 10), ("tight", "b", ["c"], 0)]
    e, r = spark.createDataFrame(events, "key long, us long, id long, product string"), spark.createDataFrame(rules, G.DECLARED)
    runs = G.process_runs(e, r)
    assert sorted(map(tuple, runs.collect())) == brute_runs(events, rules)
    m = {x["process"]: x for x in G.process_metrics(runs, r).collect()}
    assert m["never"]["runs"] == 0 and m["never"]["mean_us"] is None and m["bare"]["complete"] == m["bare"]["runs"] > 0
    none = r.limit(0)
    assert G.process_runs(e, none).count() == 0 and G.process_metrics(G.process_runs(e, none), none).count() == 0
    assert G.process_runs(e.limit(0), r).count() == 0
