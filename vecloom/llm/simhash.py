"""SimHash near-duplicates with bit-sliced comparison.

1. Each whole text gives one 64-bit fingerprint; equal fingerprints collapse to one row (with a
   map-side part), so groups of copies of any size cost one row from here on.
2. Candidates: the 64 bits are cut into 6 blocks. Fingerprints within 4 bits agree on at least two
   whole blocks, so equality on one of the 15 pairs of blocks finds every link. A bucket with more
   than ``refine`` fingerprints is cut again in the same way on the bits it does not share yet.
3. Buckets are dealt out as cells of at most 2 x ``cell`` rows (a larger bucket is salted into
   parts, each pair of parts a cell), so no task ever holds an unbounded bucket. The copies this makes of a
   bucket's rows grow with the square of its size; the finer cut of step 2 keeps buckets small before.
4. In a cell the fingerprints are stored as 64 vertical bit planes. For each lag d, rows i and
   i + d of a bucket are compared 64 pairs to a machine word: differing bits are added into
   carry-save counters plane by plane, and words whose pairs all exceed the radius are abandoned.
   Links are reduced in the task to one edge per row; components are joined up across cells.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle: the whole sequence is hashed; rows with equal ids each get a result; a component's id is null only
if all its ids are; ``keep_one`` keeps one row of a component, whatever ids repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, left_join, pick, release, row_key, scratch, text_of

RADIUS = 4
SEED = 42


# ---- fingerprints -------------------------------------------------------------------------


def fingerprint(text: bytes, words: int = 4) -> int:
    """Majority vote over the XXH64 of all word shingles, repeats included."""
    ws = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ws) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    votes, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), 1 << 16):
        part = np.array([h(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, row, fp``: the key of id and text, and the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(2)], np.uint64).view(np.int64)  # one text at a time as a Python object
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "row", "fp"])
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs["text"], docs["doc_id"]).alias("row"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row binary, fp long")


# ---- candidate buckets --------------------------------------------------------------------


def _masks(bits: list[int], parts: int = 6, agree: int = 2) -> list[int]:
    """The masks of all choices of ``agree`` of ``parts`` blocks of the given bit positions."""
    blocks = [sum(1 << int(b) for b in x) for x in np.array_split(np.array(bits), parts)]
    return [sum(c) for c in combinations(blocks, agree)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(pairs).alias("k")).select("fp", "k.mask", "k.bits")


def _counted(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of buckets with at least two fingerprints, with the bucket's size ``n``."""
    n = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(n, keys)


def buckets(fps: DataFrame, refine: int) -> DataFrame:
    """``fp, bucket, n``: every two fingerprints within RADIUS bits share a bucket."""
    keys = ["mask", "bits"]
    first = cut(_counted(_keyed(fps, _masks(list(range(64)))), keys), "buckets")
    cool = first.where(F.col("n") <= refine).select("fp", F.xxhash64(*keys).alias("bucket"), *keys, "n")
    hot = first.where(F.col("n") > refine)
    if hot.isEmpty():
        return cool.drop(*keys)
    again = None
    for i, m in enumerate(_masks(list(range(64)))):
        rest = [b for b in range(64) if not m >> b & 1]
        x = _keyed(hot.where(F.col("mask") == i).select("fp"), [m | s for s in _masks(rest)]).withColumn("mask", F.col("mask") + 100 * (i + 1))
        again = x if again is None else again.union(x)
    finer = cut(_counted(again, keys), "buckets").select("fp", F.xxhash64(*keys).alias("bucket"), *keys, "n")
    return cool.union(finer).drop(*keys)


def cells(b: DataFrame, cell: int) -> DataFrame:
    """``fp, bucket, i, j``: a bucket of more than ``cell`` rows becomes all pairs of its parts."""
    parts = F.ceil(F.col("n") / cell)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts)
    others = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    return b.select("fp", "bucket", F.explode(others).alias("c")).select("fp", "bucket", "c.i", "c.j")


# ---- bit-sliced comparison ----------------------------------------------------------------


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    gt, eq = over.copy(), np.full_like(over, ~np.uint64(0))
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            eq &= counters[k]
        else:
            gt |= eq & counters[k]
            eq &= ~counters[k]
    return gt


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows in one group within ``radius`` bits, lag by lag.

    ``ends[i]`` is one past the last row of row i's group; groups are contiguous.
    """
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, (2 * words + 2) * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)  # a plane per bit, 64 rows to a word
    follow = ends - np.arange(n) - 1
    rows = np.flatnonzero(follow > 0)
    depth, lag = max(1, radius.bit_length()), 0
    while len(rows):
        lag += 1
        rows = rows[follow[rows] >= lag]
        if not len(rows):
            return
        valid = np.zeros(words * 64, np.uint8)
        valid[rows] = 1
        alive = np.packbits(valid, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        alive = alive[at]
        skip, shift = lag >> 6, np.uint64(lag & 63)
        counters, over = [np.zeros(len(at), np.uint64) for _ in range(depth)], np.zeros(len(at), np.uint64)
        for b in range(64):
            p = planes[b]
            other = p[at + skip] >> shift
            if shift:
                other |= p[at + skip + 1] << (np.uint64(64) - shift)
            carry = p[at] ^ other
            for c in counters:  # carry-save: the sum bit stays, the carry moves up
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
            if b % 8 == 7:
                left = alive & ~_exceeds(counters, over, radius)
                keep = left != 0
                if not keep.all():  # abandon blocks in which no pair can still be a link
                    at, alive, over, counters = at[keep], alive[keep], over[keep], [c[keep] for c in counters]
                    if not len(at):
                        break
        if len(at):
            hit = alive & ~_exceeds(counters, over, radius)
            k, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[k] * 64 + lane
            yield i, i + lag


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least connected row of each row."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _cell_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    def edges(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        stops = np.append(change, len(fp))
        ends = np.repeat(stops, np.diff(np.concatenate(([0], stops))))
        root = spanning(len(fp), close_pairs(fp.view(np.uint64), ends, radius))
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

    fp, key = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    for b in batches:
        fp = np.concatenate((fp, b.column(0).to_numpy()))
        key = np.concatenate((key, np.stack([b.column(k).to_numpy() for k in (1, 2, 3)], axis=1)))
        last = np.flatnonzero((key != key[-1]).any(axis=1))
        whole = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
        if whole:
            yield edges(fp[:whole], key[:whole])
            fp, key = fp[whole:], key[whole:]
    if len(fp):
        yield edges(fp, key)


def links(fps: DataFrame, radius: int = RADIUS, cell: int = 4096, refine: int = 65_536) -> DataFrame:
    """``a, b``: edges whose components are those of all links within ``radius`` (at most 4) bits."""
    c = cells(buckets(fps, refine), cell)
    dealt = c.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp").select("fp", "bucket", "i", "j")
    return dealt.mapInArrow(lambda it: _cell_edges(it, radius), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = RADIUS, cell: int = 4096, refine: int = 65_536) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp, component_id``, and ``row``, the key of its id and text."""
    with scratch(docs.sparkSession):
        rows = cut(fingerprints(docs, words), "fingerprints", stay=True)
        distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        comp = cut(components(links(distinct.select("fp"), radius, cell, refine)), "components")
        named = distinct.join(comp, distinct["fp"] == comp["v"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.min("fp").alias("least_fp"))
        by_fp = cut(named.select("fp", "root").join(least, "root").select("fp", "component_id", "least_fp"), "classes", stay=True)
    return left_join(rows, by_fp, ["fp"]).select("doc_id", "fp", "component_id", "row", "least_fp")


def hex_of(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component one row, of the least doc_id.

    Of rows with equal ids the one with the least key stays; of rows equal in id and text, one.
    """
    first = simhash_components(docs).where("doc_id <=> component_id").groupBy("least_fp", "row").agg(F.count("*").alias("n"))
    stay = first.groupBy("least_fp").agg(F.min(F.struct("row", "n")).alias("x")).select(F.col("x.row").alias("key"), F.col("x.n").alias("n"))
    return pick(docs, cut(stay, "stay", stay=True), row_key(docs["text"], docs["doc_id"]))
