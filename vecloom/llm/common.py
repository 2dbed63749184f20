"""What the operators share: word and white-space patterns, row keys, ranks of equal rows, components.

White space is the ASCII set of the contracts, ``[\\x20\\x09-\\x0D]``; a word is a maximal run
of anything else. Null texts count as empty everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.shared import cut, discard, remove, scratch, shared_path

__all__ = ["SPACE", "WORD", "Packed", "Pressed", "components", "cut", "discard", "fold_of", "fresh", "gather", "left_join", "most_frequent", "numbered", "pick", "pieces_at", "release", "remove", "row_key", "scratch", "shared_path", "slices", "text_of"]

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library is not glibc

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is a column already."""
    out = []
    for n in names:
        while n in columns or n in out:
            n += "_"
        out.append(n)
    return out


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; 0 is the held-out fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def row_key(text: Column, *others: Column) -> Column:
    """128 bits (binary) that tell rows apart by the text and the other values, nulls included."""
    known = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in others]
    return F.unhex(F.md5(F.concat_ws("\0", *known, F.md5(text_of(text)))))


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a right side with unique keys; null keys match null.

    A key with a third of the left rows makes skewed partitions of the left side only, which adaptive
    execution splits, each part with its copy of the one right row.
    """
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])


def numbered(rows: DataFrame, key: str, uid: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0 for the first of the rows with equal ``key``, 1 for the next, and so on.

    ``rows`` is cut, and ``uid`` is the monotonically increasing id it was written with. Ranks are given within
    each written partition and moved up by the counts of the partitions before, so no key is gathered in a task.
    """
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    if many.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    again = cut(rows.join(many, rows[key] == many["_key"]).select(F.col(key).alias("_key"), F.col(uid).alias("_uid")), "equal")
    part = F.shiftright("_uid", 33)
    counts = again.groupBy("_key", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), before.alias("_before")), "equal")
    own = again.withColumn("_in", F.row_number().over(Window.partitionBy("_key", part).orderBy("_uid")) - 1).withColumn("_part", part)
    ranks = own.join(counts, (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_p"))).select("_uid", (F.col("_in") + F.col("_before")).alias(name))
    return rows.join(ranks, rows[uid] == ranks["_uid"], "left").drop("_uid").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def pick(docs: DataFrame, stay: DataFrame, own: Column) -> DataFrame:
    """The rows of ``docs`` whose key ``own`` is one of ``stay`` (key, n): of ``n`` > 1 equal rows, one."""
    key, n = fresh(docs.columns, "_stay_key", "_stay_n")
    stay = stay.select(F.col("key").alias(key), F.col("n").alias(n))
    once = docs.join(stay.where(F.col(n) == 1), own == F.col(key), "left_semi")
    again = stay.where(F.col(n) > 1)
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, own == F.col(key)).dropDuplicates([key]).drop(key, n))


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column, size: int):
    """``(from, to)`` ranges of rows of an Arrow string or binary column, of about ``size`` bytes (one row at least)."""
    ends, start = np.frombuffer(column.buffers()[1], np.int64 if "large" in str(column.type) else np.int32)[column.offset : column.offset + len(column) + 1], 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1)
        yield start, min(stop, len(column))
        start = stop


def pieces_at(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and sizes, laid end to end."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def gather(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries laid end to end in ``values``, those of ``index`` laid end to end, and their sizes."""
    at, own = np.cumsum(sizes) - sizes, sizes[index]
    return pieces_at(values, at[index], own), own


class Packed:
    """A table of words and ids in a few arrays, found by hash and compared as texts."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        at = np.array(ids.offsets, np.int32)
        flat = ids.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        self._keep(words, at - at[0], flat.astype(np.uint16 if len(flat) == 0 or flat.max() < 1 << 16 else np.int32))

    def _keep(self, words: pa.Array, at: np.ndarray, ids: np.ndarray, hashes: np.ndarray | None = None) -> None:
        """Words stay as they came; the low bits of a key name the word's row, the others are its hash."""
        keys = self._hashes(words) if hashes is None else hashes
        self.low = np.uint64((1 << len(words).bit_length()) - 1)
        keys &= ~self.low
        keys |= np.arange(len(words), dtype=np.uint64)
        keys.sort()
        self.keys, self.words, self.at, self.ids = keys, words, at, ids

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw, out = memoryview(words.buffers()[2]), np.empty(len(words), np.uint64)
        for k in range(0, len(words), 1 << 16):
            at = ends[k : k + (1 << 16) + 1].tolist()
            out[k : k + (1 << 16)] = [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(at, at[1:])]
        return out

    def find(self, words: pa.Array) -> np.ndarray:
        """The row of each word in the table, or -1."""
        place = np.full(len(words), -1, np.int64)
        h = self._hashes(words) & ~self.low
        at = np.searchsorted(self.keys, h)
        open_ = np.arange(len(words))
        while len(open_):  # more than once only where hashes collide
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] & ~self.low == h[open_]]
            rows = (self.keys[at[open_]] & self.low).astype(np.int64)
            same = pc.equal(self.words.take(pa.array(rows)), words.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            place[open_[same]] = rows[same]
            open_ = open_[~same]
            at[open_] += 1
        return place


class Pressed:
    """A table of words and ids in compressed parts that tasks have made: the driver hands them on unread, a worker unpacks them once."""

    def __init__(self, parts: list[bytes], rows: int, n_bytes: int, n_ids: int, most: int):
        self.parts, self.rows, self.n_bytes, self.n_ids, self.most = parts, rows, n_bytes, n_ids, most

    @staticmethod
    def read(table: DataFrame) -> Pressed:
        """From rows ``w, ids`` of bounded size."""

        def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sink, ids = pa.BufferOutputStream(), b.column(1).flatten()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b)
                known = [b.num_rows, pc.sum(pc.binary_length(b.column(0))).as_py() or 0, len(ids), pc.max(ids).as_py() or 0]
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()]), *[pa.array([x]) for x in known]], ["part", "n", "n_bytes", "n_ids", "most"])

        got = table.select("w", "ids").mapInArrow(press, "part binary, n long, n_bytes long, n_ids long, most long").toArrow()
        total = lambda c: pc.sum(got.column(c)).as_py() or 0
        out = Pressed(got.column("part").to_pylist(), total("n"), total("n_bytes"), total("n_ids"), pc.max(got.column("most")).as_py() or 0)
        del got
        release()
        return out

    def unpacked(self) -> Packed:
        """The table; parts go as their rows come in place, so that few are held twice."""
        if self.parts is None:
            return self._table
        raw, ends, at = np.empty(self.n_bytes, np.uint8), np.zeros(self.rows + 1, np.int32), np.zeros(self.rows + 1, np.int32)
        ids, hashes = np.empty(self.n_ids, np.uint16 if self.most < 1 << 16 else np.int32), np.empty(self.rows, np.uint64)
        row = byte = k = 0
        self.parts.reverse()
        while self.parts:
            b = pa.ipc.open_stream(self.parts.pop()).read_next_batch()
            words, lists = b.column(0).cast(pa.string()), b.column(1)
            own, n = np.asarray(lists.flatten()), len(words)
            if not n:
                continue
            place = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4)
            raw[byte : byte + place[-1] - place[0]] = np.frombuffer(words.buffers()[2], np.uint8)[place[0] : place[-1]]
            ends[row + 1 : row + n + 1] = place[1:] - place[0] + byte
            at[row + 1 : row + n + 1] = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)) + k
            ids[k : k + len(own)] = own
            hashes[row : row + n] = Packed._hashes(words)
            row, byte, k = row + n, byte + int(place[-1] - place[0]), k + len(own)
            if len(self.parts) % 16 == 0:
                del b, words, lists, own, place
                release()
        self._table = Packed.__new__(Packed)
        self._table._keep(pa.Array.from_buffers(pa.string(), self.rows, [None, pa.py_buffer(ends), pa.py_buffer(raw)]), at, ids, hashes)
        self.parts = None
        release()
        return self._table


def most_frequent(words: DataFrame, key: str, cost: Column, most: int) -> tuple[DataFrame, bool]:
    """The rows of ``words`` (with a count ``n``) of highest counts whose ``cost`` in bytes sums to ``most`` at most, and whether that is all.

    Counts are classed by powers of two; of the class that no longer fits whole, rows are taken by a hash of ``key``
    until the bound is reached.
    """
    level, bucket = F.floor(F.log2("n")), F.pmod(F.xxhash64(key), F.lit(1024))
    least, room, whole = None, most, True
    for r in words.groupBy(level.alias("level")).agg(F.sum(cost).alias("b")).orderBy(F.desc("level")).collect():  # 63 at most
        if r["b"] > room:
            whole = False
            break
        least, room = r["level"], room - r["b"]
    fits = F.lit(False) if least is None else level >= least
    if not whole:
        upto = 0
        for x in words.where(level == r["level"]).groupBy(bucket.alias("bucket")).agg(F.sum(cost).alias("b")).orderBy("bucket").collect():  # 1024 at most
            if x["b"] > room:
                break
            room, upto = room - x["b"], x["bucket"] + 1
        fits = fits | ((level == r["level"]) & (bucket < upto))
    return words.where(fits), whole


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows ``v, root`` for every vertex of an edge.

    Random-priority contraction: in each round every vertex joins the neighbour with the lowest
    priority (its own included), edges are rewritten to the chosen vertices and loops dropped;
    priorities are rehashed by round, so a chain shrinks by a constant factor too. The rounds'
    maps are then composed. Every aggregate is a min with a map-side part; no vertex's edges are
    ever gathered. ``root`` is some vertex of the component, the same for all of them. Inside
    ``scratch`` the rounds' files go with it.
    """
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        rank = lambda c, n=len(maps): F.struct(F.xxhash64(F.lit(n), c).alias("p"), c.alias("v"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        m = cut(low.select(F.col("a").alias("v"), F.least(F.col("m"), rank(F.col("a")))["v"].alias("to")), "contract")
        maps.append(m)
        x = e.join(m.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(m.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        x = x.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        e = cut(x, "edges")
    if not maps:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0].select("v", F.col("to").alias("root"))
    for m in maps[1:]:
        m = m.select(F.col("v").alias("_v"), F.col("to").alias("_to"))
        out = out.join(m, out["root"] == m["_v"], "left").select("v", F.coalesce("_to", "root").alias("root"))
    return out
