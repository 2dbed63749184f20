"""Removal of long repeated byte strings with suffix arrays.

A byte goes if it lies in a ``length``-byte string that also starts anywhere else in the corpus.

1. Every window of ``length`` bytes is assigned to its anchor, the k-gram in it with the least hash
   (leftmost on ties). Equal windows have equal anchors at equal places, so repeats can only lie between
   different contexts (the windows of one anchor in one place) of the same anchor hash, never in one.
2. Anchors met once are dropped. A context that is met again, byte for byte, is repeated as a whole, which
   its count tells; a passage in a third of all documents thus costs one row.
3. Only the windows of contexts met once remain open: they may still lie in another context of their anchor.
   For anchors with such a context and at least one other, one copy of each context is dealt into shards by
   anchor. Each shard's suffix array is built by induced sorting: suffixes are classified, the
   leftmost-smaller substrings are sorted by inducing, named and sorted recursively, and the order is induced
   for all suffixes, a bucket at a time in vector steps. Permuted common prefixes follow: irreducible positions
   are compared, the others derived.
4. Starts whose common prefix with a neighbour in the suffix array reaches ``length`` are repeated, and the
   documents' bytes are cut.

A shard is about ``SHARD`` bytes of whole anchors. An anchor with more than ``hot`` different contexts (some
3 MB of text) would make one shard large; its windows are counted one by one instead, as 128-bit digests,
with map-side sums. Both decide the same question, and the rule is the same at every size of the input.

Edge cases: null and empty texts have no bytes and the digest of nothing; texts shorter than
``length`` are never cut; repeated rows are copies of each other; long texts are anchored in
pieces that overlap by ``length`` - 1 bytes; extra columns are ignored; an empty table gives no rows.
Identity of contexts is that of their 128-bit XXH3 digests, that of rows of 128 bits over id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, row_key, scratch, text_of

LENGTH = 400
GRAM = 64
PIECE = 1 << 20
SHARD = 1 << 21
HOT = 4096


# ---- suffix arrays ------------------------------------------------------------------------


def _ranks_by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a large alphabet."""
    n, rank, k = len(t), t.astype(np.int64), 1
    while True:
        key = rank * (n + 1 + int(t.max() if k == 1 else 0)) + np.append(rank[k:] + 1, np.zeros(min(k, n), np.int64))
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class _Buckets:
    """Appends suffixes to the buckets of their first symbols, in the order given."""

    def __init__(self, t: np.ndarray, sa: np.ndarray, edge: np.ndarray, step: int):
        self.t, self.sa, self.edge, self.step = t, sa, edge.copy(), step

    def put(self, j: np.ndarray) -> None:
        if not len(j):
            return
        c = self.t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        size = np.diff(np.append(first, len(c)))
        within = np.arange(len(c)) - np.repeat(first, size)
        self.sa[np.repeat(self.edge[c[first]], size) + self.step * within] = j[order]
        self.edge[c[first]] += self.step * size


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of ``lms``."""
    n, heads = len(t), np.concatenate(([0], np.cumsum(size)[:-1]))
    tails = heads + size - 1
    sa = np.full(n, -1, np.int64)
    present = np.flatnonzero(size)
    by_char = lms[np.argsort(t[lms], kind="stable")]
    seeds = np.bincount(t[lms], minlength=len(size))
    at = np.concatenate(([0], np.cumsum(seeds)))
    left = _Buckets(t, sa, heads, 1)
    for c in present:  # larger suffixes, ascending: the bucket's own first, round by round, then its seeds
        done = heads[c]
        while done < left.edge[c]:
            now = sa[done : left.edge[c]]
            done = left.edge[c]
            j = now[now > 0] - 1
            left.put(j[~smaller[j]])
        seed = by_char[at[c] : at[c + 1]]
        left.put(seed[seed > 0] - 1)
    right = _Buckets(t, sa, tails, -1)
    for c in present[::-1]:  # smaller suffixes, descending
        done = tails[c]
        while done > right.edge[c]:
            now = sa[right.edge[c] + 1 : done + 1][::-1]
            done = right.edge[c]
            j = now[now > 0] - 1
            right.put(j[smaller[j]])
        now = sa[heads[c] : left.edge[c]][::-1]
        j = now[now > 0] - 1
        right.put(j[smaller[j]])
    sa[0] = n - 1
    return sa


def suffix_array(t: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Suffix array of an integer string that ends in a unique least symbol."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy() if n else np.zeros(0, np.int64)
    if int(t.max()) >= wide:  # a vector step per symbol no longer pays
        return _ranks_by_doubling(t)
    size = np.bincount(t)
    d = np.sign(t[1:].astype(np.int64) - t[:-1])
    change = np.flatnonzero(d)
    nxt = change[np.searchsorted(change, np.arange(n - 1))]
    smaller = np.append(d[nxt] > 0, True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(t, smaller, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = sa[is_lms[sa]]
    # names: neighbours in the order of leftmost-smaller substrings, equal or not
    stop = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = stop - lms
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        eq = t[a[live] + k] == t[b[live] + k]
        same[live[~eq]] = False
        live = live[eq & (length[a[live]] > k)]
        k += 1
    same[:1] = False  # the final symbol stands alone
    name = np.empty(n, np.int64)
    name[sorted_lms] = np.concatenate(([0], np.cumsum(~same)))
    reduced = name[lms]
    order = np.argsort(reduced, kind="stable") if reduced.max() == len(lms) - 1 else suffix_array(reduced, wide)
    return _induce(t, smaller, lms[order], size)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted: at position i, the common prefix of suffix i with its predecessor in the array."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[phi[reducible] - 1]
    own = np.flatnonzero(~reducible & (phi >= 0))
    pad = np.concatenate((t.astype(np.uint8), np.zeros(16, np.uint8)))
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= pad[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    lcp = np.zeros(n, np.int64)
    a, b, live = own, phi[own], own
    while len(live):
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        lcp[live] += np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        go = (x == 0) & (np.maximum(a, b) + 8 <= n)
        a, b, live = a[go] + 8, b[go] + 8, live[go]
    fixed = ~reducible
    last = np.maximum.accumulate(np.where(fixed, i, 0))
    return np.maximum(lcp[last] - (i - last), 0)


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which starts (with ``length`` bytes left) begin a string found at another start of the shard."""
    sizes = np.array([len(c) for c in contexts])
    t = np.frombuffer(b"".join(c + b"\xff" for c in contexts) + b"\xff", np.uint8).astype(np.int64) + 2
    t[np.append(np.cumsum(sizes + 1) - 1, len(t) - 1)] = 1  # UTF-8 has no byte above 0xF4
    t[-1] = 0
    sa = suffix_array(t)
    own = common_prefixes(t, sa)
    best = own.copy()
    np.maximum.at(best, sa[:-1], own[sa[1:]])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    return [best[s : s + max(0, n - length + 1)] >= length for s, n in zip(starts.tolist(), sizes.tolist())]


# ---- anchors ------------------------------------------------------------------------------


def _hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` (a power of two) bytes from each position."""
    h, k, m = b.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while k < gram:
        h = h[:-k] * m + h[k:]
        m = m * m + np.uint64(2)
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(buf: bytes, stops: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in texts laid end to end (at most PIECE + length bytes): first start, last start, anchor hash.

    ``stops``: the end of each text in ``buf``.
    """
    b = np.frombuffer(buf, np.uint8)
    windows = len(b) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    with np.errstate(over="ignore"):
        h = _hashes(b, gram)
    low = np.uint64((1 << 21) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, k = length - gram + 1, 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    if w > k:
        v = np.minimum(v[: len(v) - (w - k)], v[w - k :])
    at = (v[:windows] & low).astype(np.int64)
    stop = np.repeat(stops, np.diff(np.concatenate(([0], stops))))[:windows]
    valid = np.arange(windows) + length <= stop
    edge = np.flatnonzero((at[1:] != at[:-1]) | (stop[1:] != stop[:-1]) | (valid[1:] != valid[:-1])) + 1
    first, last = np.concatenate(([0], edge)), np.append(edge, windows) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    return first, last, h[at[first]].view(np.int64)


OCC = "anchor long, d0 long, d1 long, row binary, n int, starts array<long>"


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[bytes], offs: list[int], parts: list[bytes]) -> pa.RecordBatch:
        buf = b"".join(parts)
        sizes = np.array([len(p) for p in parts])
        stops = np.cumsum(sizes)
        first, last, key = anchors(buf, stops, length, gram)
        digest = xxhash.xxh3_128_digest
        d = np.frombuffer(b"".join([digest(buf[a:e]) for a, e in zip(first.tolist(), (last + length).tolist())]), "<i8").reshape(-1, 2)
        text = np.searchsorted(stops, first, side="right")
        own = np.unique(np.frombuffer(b"".join(rows), "S16"), return_inverse=True)[1].ravel()[text]  # pieces of one row meet again
        start = first - (stops - sizes)[text] + np.array(offs)[text]
        o = np.lexsort((start, d[:, 1], d[:, 0], own))
        own, text, d, key, start, n = own[o], text[o], d[o], key[o], start[o], (last - first + 1)[o]
        new = np.ones(len(o), bool)
        new[1:] = (own[1:] != own[:-1]) | (d[1:] != d[:-1]).any(axis=1)
        g = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(g, len(o)), pa.int32()), pa.array(start))
        row = pa.array([rows[k] for k in text[g].tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key[g]), pa.array(d[g, 0]), pa.array(d[g, 1]), row, pa.array(n[g], pa.int32()), lists], ["anchor", "d0", "d1", "row", "n", "starts"])

    rows, offs, parts, size = [], [], [], 0
    for b in batches:
        for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k in range(0, max(1, len(t) - length + 1), PIECE):
                p = t[k : k + PIECE + length - 1]
                if len(p) < length:
                    continue
                if size + len(p) > PIECE + length:
                    yield emit(rows, offs, parts)
                    rows, offs, parts, size = [], [], [], 0
                    release()
                rows.append(r)
                offs.append(k)
                parts.append(p)
                size += len(p)
    if parts:
        yield emit(rows, offs, parts)


# ---- shards -------------------------------------------------------------------------------

CTX = "anchor long, row binary, start long, open boolean, bytes binary, kinds long"
SPANS = "row binary, a long, b long"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the asked contexts out of the texts: columns row, text, asked array<struct<anchor,start,size,open,kinds>>."""
    for b in batches:
        out = ([], [], [], [], [], [])
        for r, t, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            t = memoryview(t.as_buffer())
            for x in asked:
                for c, v in zip(out, (x["anchor"], r, x["start"], x["open"], bytes(t[x["start"] : x["start"] + x["size"]]), x["kinds"])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()))], ["anchor", "row", "start", "open", "bytes", "kinds"])


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    e = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return e[::2].tolist(), e[1::2].tolist()


def _search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; a shard is as many whole anchors as fit. Spans of repeated starts of the open contexts."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        out = ([], [], [])
        for (_, row, start, open_, _), mask in zip(rows, repeated_starts([r[4] for r in rows], length)):
            if open_ and mask.any():
                for lo, hi in zip(*_runs(mask)):
                    for c, v in zip(out, (row, start + lo, start + hi)):
                        c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["row", "a", "b"])

    held, size = [], 0
    for b in batches:
        for r in zip(*[b.column(k).to_pylist() for k in range(5)]):
            if size >= SHARD and r[0] != held[-1][0]:
                yield shard(held)
                held, size = [], 0
                release()
            held.append(r)
            size += len(r[4])
    if held:
        yield shard(held)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, start, open_, t in zip(*[b.column(k).to_pylist() for k in (1, 2, 3, 4)]):
            n = len(t) - length + 1
            w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t[k : k + length]) for k in range(n)]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.binary()), pa.array(start + np.arange(n)), pa.array(np.full(n, open_)), pa.array(w[:, 0]), pa.array(w[:, 1])], ["row", "at", "open", "w0", "w1"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = ([], [], [], [])
        for t, spans in zip(b.column(1), b.column(2).to_pylist()):
            t = t.as_buffer().to_pybytes()
            if spans:
                d = np.zeros(len(t) + 1, np.int32)
                np.add.at(d, [x["a"] for x in spans], 1)
                np.add.at(d, [x["b"] + length - 1 for x in spans], -1)
                gone = np.cumsum(d[:-1]) > 0
                lo, hi = _runs(gone)
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            else:
                lo, kept = [], t
            for c, v in zip(out, (len(t), len(t) - len(kept), len(lo), hashlib.sha256(kept).hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``row, spans``: runs [a, b) of repeated starts. ``docs``: row, text (binary). Rests on cuts of the open scratch."""
    occ = cut(docs.select("row", "text").mapInArrow(lambda it: _occurrences(it, length, gram), OCC), "occurrences")
    which = F.struct("d0", "d1")
    met = occ.groupBy("anchor").agg(F.sum(F.size("starts")).alias("met"), F.min(which).alias("x"), F.max(which).alias("y")).where("met > 1")
    # both sides of these joins grow with the corpus: they are merged at every size
    cand = cut(occ.hint("merge").join(met.select("anchor", (F.col("x") == F.col("y")).alias("alike")), "anchor"), "candidates")
    # with one context for the anchor, all its places are repeated; else those of a context met again are
    mixed = cand.where(~F.col("alike"))
    kinds = mixed.groupBy("anchor", "d0", "d1").agg(F.min("n").alias("n"), F.min(F.struct("row", F.array_min("starts").alias("start"))).alias("at"), F.sum(F.size("starts")).alias("times"))
    kinds = cut(kinds, "kinds")
    again = mixed.hint("merge").join(kinds.where("times > 1").select("d0", "d1"), ["d0", "d1"])
    whole = cand.where("alike").select("row", "n", "starts").union(again.select("row", "n", "starts")).select("row", "n", F.explode("starts").alias("a")).select("row", "a", (F.col("a") + F.col("n")).alias("b"))

    load = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("open")).where("open > 0"), "load")
    x = F.struct("anchor", "at.start", (F.col("n") + length - 1).alias("size"), (F.col("times") == 1).alias("open"), "kinds")
    asked = kinds.hint("merge").join(load.select("anchor", "kinds"), "anchor").select(F.col("at.row").alias("_row"), x.alias("x"))
    asked = cut(asked.groupBy("_row").agg(F.collect_list("x").alias("asked")), "asked")  # a row's contexts: as many as its text has
    joined = docs.hint("merge").join(asked, docs["row"] == asked["_row"])
    ctx = cut(joined.select("row", "text", "asked").mapInArrow(_fetch, CTX), "contexts")
    dealt = ctx.where(F.col("kinds") <= hot).repartition("anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(lambda it: _search(it, length), SPANS)
    if not load.where(F.col("kinds") > hot).isEmpty():
        w = cut(ctx.where(F.col("kinds") > hot).mapInArrow(lambda it: _windows(it, length), "row binary, at long, open boolean, w0 long, w1 long"), "windows")
        twice = w.groupBy("w0", "w1").agg(F.count("*").alias("c")).where("c > 1").select("w0", "w1")
        found = found.union(w.where("open").join(twice, ["w0", "w1"]).select("row", F.col("at").alias("a"), (F.col("at") + 1).alias("b")))
    spans = whole.union(found)
    return spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), row_key(docs["text"], docs["doc_id"]).alias("row"))
    with scratch(docs.sparkSession):
        spans = cut(repeated_spans(rows, length, gram, hot).withColumnRenamed("row", "_row"), "spans", stay=True)
    out = rows.hint("merge").join(spans, rows["row"] == spans["_row"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(lambda it: _cut_out(it, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
