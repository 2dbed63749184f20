"""Stateful operators in event time: rows wait until the watermark has passed them, then are folded in order.

How the input is cut into batches, and in what order rows of a batch come, thus makes no difference. Time is cut into slots;
the rows of a slot wait in a map by bucket of keys, and a timer at the slot's end folds them, key by key. Memory is bounded by a
slot of a bucket and the states of its keys, not by a key's history or by a batch. Timers fire as the watermark moves on, input for the key or none, and
fire once: state, timers and output advance together with the checkpoint.

Rows: ``key``, ``ts`` (the watermarked time), ``seq`` (breaks ties), and the columns that a fold asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that keys share. A task holds a slot of a bucket and the states of its keys.
BUCKETS = 1024


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for k, v in {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
        own.conf.set(k, v)
    return own


class Fold:
    """What is done with a key's rows in order. ``state`` is a dictionary of plain values, kept between slots."""

    columns: tuple[str, ...] = ()
    schema = ""

    def row(self, key, state: dict, ts: int, seq: int, values: list) -> Iterator[tuple]:
        """A row at ``ts`` (microseconds); yields output rows without the key."""
        raise NotImplementedError

    def passed(self, key, state: dict, upto: int) -> Iterator[tuple]:
        """All rows before ``upto`` are folded; yields what is due by then."""
        return iter(())

    def next_due(self, state: dict) -> int | None:
        """When something may be due though no row comes."""
        return None

    def whole(self, key, rows: list[tuple], upto: int, slot: int) -> list[tuple]:
        """The same over ``(ts, seq, values)`` in a plain loop, for slots that end by ``upto``."""
        state, out, ends = {}, [], sorted({(r[0] // slot + 1) * slot for r in rows if (r[0] // slot + 1) * slot <= upto})
        while ends:
            end = ends.pop(0)
            for ts, seq, values in sorted((r for r in rows if end - slot <= r[0] < end), key=lambda r: r[:2]):
                out += self.row(key, state, ts, seq, values)
            out += self.passed(key, state, end)
            due = self.next_due(state)
            if due is not None and -(-due // slot) * slot <= upto and -(-due // slot) * slot not in ends:
                ends = sorted([*ends, max(-(-due // slot) * slot, end + slot)])
                ends = [e for e in ends if e <= upto]
        return out


class Ordered(StatefulProcessor):
    """Keys share ``BUCKETS`` buckets, so that state is read and written, and timers are set, for a bucket and not for each key."""

    def __init__(self, fold: Fold, slot_us: int):
        self.fold, self.slot = fold, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part int", "rows string")
        # the parts of each slot that waits, and the state of each key
        self.parts = handle.getValueState("parts", "slots string")
        self.kept = handle.getValueState("kept", "states string")

    def _timer(self, end: int) -> None:
        self.handle.registerTimer(end // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = json.loads(self.parts.get()[0]) if self.parts.exists() else {}
        for frame in rows:
            slots, texts = frame["slot"].to_numpy(), frame["row"].to_numpy()
            order = np.argsort(slots, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1):
                slot = int(slots[own[0]])
                n = parts.get(str(slot), 0)
                if not n:
                    self._timer((slot + 1) * self.slot)
                self.waiting.updateValue((slot, n), ("[" + ",".join(texts[own]) + "]",))
                parts[str(slot)] = n + 1
        self.parts.update((json.dumps(parts),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        states = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        parts, out, by, slot = json.loads(self.parts.get()[0]), [], {}, end // self.slot - 1
        if n := parts.pop(str(slot), 0):
            for k in range(n):
                for r in json.loads(self.waiting.getValue((slot, k))[0]):
                    own, ts, seq, *values = r.values()
                    by.setdefault(json.dumps(own), []).append((ts, seq, values))
                self.waiting.removeKey((slot, k))
            self.parts.update((json.dumps(parts),))
        for name, rows in by.items():
            state, own = states.setdefault(name, {}), json.loads(name)
            for ts, seq, values in sorted(rows, key=lambda r: r[:2]):
                out += [(own, *x) for x in self.fold.row(own, state, ts, seq, values)]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = min(((int(s) + 1) * self.slot for s in parts), default=None)
        # what falls due by the watermark where no rows wait comes now: a timer set here for a time gone by would not fire in this batch
        while True:
            due = []
            for name, state in states.items():
                at = self.fold.next_due(state)
                if name in by or at is not None and at <= end:
                    own = json.loads(name)
                    out += [(own, *x) for x in self.fold.passed(own, state, end)]
                    at = self.fold.next_due(state)
                if at is not None:
                    due.append(at)
            by = {}
            if not due:
                break
            end = max(-(-min(due) // self.slot) * self.slot, end + self.slot)
            if end > passed or first is not None and first <= end:
                self._timer(end)
                break
        self.kept.update((json.dumps({k: v for k, v in states.items() if v}),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.fold.schema.split(", ")])

    def close(self) -> None:
        pass


def folded(feed: DataFrame, fold: Fold, slot: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """``feed`` is a stream with key, ts, seq and the fold's columns; a slot is folded once the watermark has passed its end."""
    n, unit = slot.split()
    us = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000
    at = F.unix_micros("ts")
    row = F.to_json(F.struct("key", at.alias("us"), "seq", *fold.columns), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    rows = feed.withWatermark("ts", delay).select(bucket, "ts", ((at - F.pmod(at, F.lit(us))) / us).cast("long").alias("slot"), row.alias("row"))
    return rows.groupBy("bucket").transformWithStateInPandas(Ordered(fold, us), fold.schema, "Append", "EventTime")


# ---- folds --------------------------------------------------------------------------------


class EditGate(Fold):
    """Edit debts of a session. Reading a locus for an edit opens a debt on it; an update of the locus or an acknowledgement clears it.

    While a locus has a debt, reading it again is refused (``hard``) or allowed with a warning, and counted. A debt that nothing
    clears lapses ``ttl`` microseconds after it was opened. Kinds: ``start`` and ``end`` (both forget everything; debts are
    kept only between them), ``context``, ``update``, ``ack`` (without a locus: of all). Reading without a session is allowed.

    Rows out: ``key, seq, what, pending, attempts``: allowed, warned, blocked or unguarded for each reading, lapsed
    for each debt (``seq`` of the reading that opened it); with the debts open before a reading and the refusals so far, 0 for lapses.
    """

    columns = ("kind", "locus")
    schema = "key long, seq long, what string, pending long, attempts long"

    def __init__(self, ttl: int, hard: bool = True):
        self.ttl, self.hard = ttl, hard

    def _lapse(self, state: dict, upto: int) -> Iterator[tuple]:
        debts = state.setdefault("debts", {})
        for due, seq, locus in sorted((d, s, k) for k, (d, s) in debts.items() if d <= upto):
            yield seq, "lapsed", 0, 0
            del debts[locus]

    def row(self, key, state, ts, seq, values):
        kind, locus = values
        yield from self._lapse(state, ts)
        debts = state["debts"]
        if kind in ("start", "end"):
            state.update(active=kind == "start", debts={}, attempts=0)
        elif kind == "update":
            debts.pop(str(locus), None)
        elif kind == "ack":
            state["debts"] = {} if locus is None else {k: v for k, v in debts.items() if k != str(locus)}
        elif kind == "context":
            pending = len(debts)
            if not state.get("active"):
                yield seq, "unguarded", pending, 0
                return
            what = "allowed"
            if str(locus) in debts:
                state["attempts"] += 1
                what = "blocked" if self.hard else "warned"
            yield seq, what, pending, state["attempts"]
            if what != "blocked" and locus is not None:
                debts[str(locus)] = (ts + self.ttl, seq)

    def passed(self, key, state, upto):
        return self._lapse(state, upto)

    def next_due(self, state):
        return min((d for d, _ in state.get("debts", {}).values()), default=None)


class Debounce(Fold):
    """Bursts: rows of a key no more than ``gap`` microseconds apart give one row once the key has been quiet for that long."""

    schema = "key string, first_us long, last_us long, n long"

    def __init__(self, gap: int):
        self.gap = gap

    def _close(self, state: dict) -> Iterator[tuple]:
        yield state["first"], state["last"], state["n"]
        state.clear()

    def row(self, key, state, ts, seq, values):
        if state and ts - state["last"] > self.gap:
            yield from self._close(state)
        state.setdefault("first", ts)
        state.update(last=ts, n=state.get("n", 0) + 1)

    def passed(self, key, state, upto):
        if state and state["last"] + self.gap < upto:
            yield from self._close(state)

    def next_due(self, state):
        return state["last"] + self.gap + 1 if state else None


class Ticks(Fold):
    """Ticks of several periods for each key, at the multiples of a period (microseconds) after its first row, rows or none."""

    schema = "key long, period string, tick_us long"

    def __init__(self, periods: dict[str, int]):
        self.periods = periods

    def row(self, key, state, ts, seq, values):
        if not state:
            state.update({p: ts // us + 1 for p, us in self.periods.items()})
        return iter(())

    def passed(self, key, state, upto):
        due = []
        for p, us in self.periods.items():
            while state and state[p] * us <= upto:
                due.append((state[p] * us, p))
                state[p] += 1
        for tick, p in sorted(due):
            yield p, tick

    def next_due(self, state):
        return min(k * self.periods[p] for p, k in state.items()) if state else None


class Lease(Fold):
    """One lease per resource: a request is granted if none is live or the same holder asks again; it lives ``ttl`` microseconds."""

    columns = ("holder",)
    schema = "key string, seq long, holder long, granted boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def row(self, key, state, ts, seq, values):
        holder = values[0]
        ok = not state or state["until"] <= ts or state["holder"] == holder
        if ok:
            state.update(holder=holder, until=ts + self.ttl)
        yield seq, holder, ok
