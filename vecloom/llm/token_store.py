"""Token ids in directly addressable codes.

File format. A dataset folder in the shared store holds Parquet files whose rows are segments; a
segment's ``blob`` is self-contained and little-endian:

    b"DACT", version u16, levels u16, n_tokens u64, n_docs u64,
    doc_ids i64[n_docs], ends u64[n_docs]        (one past each document's last token)
    per level: m u64, chunks u8[m]               (the next 8 bits of each id that has any)
               bitmap u64[ceil(m / 64)]          (set: the id goes on at the next level)
               ranks u64[ceil(m / 512) + 1]      (set bits before each run of 512)

The i-th id is found without decoding anything else: read ``chunks[i]``; while its bit is set, its
place at the next level is the rank of that bit. Segments hold whole documents, in ascending doc_id
order within a part; parts are ascending too, so ``(part, seq)`` is the order of the corpus.

Texts are encoded by the tokenizers library, whole. A space between two non-space characters always
starts a new pre-token, so texts are cut there and each worker encodes a distinct cut once, keeping a
bounded table of results (in packed arrays, two generations of ``KNOWN`` cuts).

Edge cases: null and empty texts have only the end id; rows with equal ids stay apart, in a fixed
order; a null doc_id comes first (in the file: the least 64-bit number, which a doc_id must not be: a row with it
is refused); very long texts have a segment of their own; extra columns are
ignored; an empty table gives an empty dataset and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Packed, gather, pieces_at, release, shared_path, slices, text_of

END = 0
SEGMENT = 1 << 20
SLICE = 8 << 20
KNOWN = 800_000
RUN = 32
#: Fixed value: how the byte-level vocabulary writes a space.
SPACED = "Ġ"
NO_ID = -(1 << 63)
SCHEMA = "part int, seq int, base long, n_docs long, n_tokens long, blob binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


# ---- encoding -----------------------------------------------------------------------------

_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: At least what Python and the library call white space.
SPACE_LAST = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]$"
TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"


class Encoder:
    """Ids of texts from a table of known cuts and the library.

    Cuts that the table lacks are encoded ``RUN`` to a string. A cut has one space, its first character, so that the
    ids whose piece starts with a space tell where each begins; a cut with other spaces is encoded alone.
    """

    def __init__(self, path: str, plain: bool = False, known: int | None = None):
        """``plain``: the strings of special tokens are text like any other; ``known``: cuts in a generation of the table."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = known or KNOWN
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        vocab = self.library.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for piece, i in vocab.items() if piece.startswith(SPACED)]] = True
        self.tables: list[Packed] = []  # the newest first
        self.pending: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts end to end, and how many each has."""
        out = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*out, np.zeros(0, np.int32)]), np.fromiter(map(len, out), np.int64, len(out))

    def after_space(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of cuts that follow a space, end to end, and how many each has."""
        alone = pc.or_(pc.or_(pc.equal(pc.binary_length(cuts), 0), pc.match_substring(cuts, " ")), pc.match_substring_regex(cuts, SPACE_LAST)).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~alone)
        ws = cuts.take(pa.array(plain)).to_pylist()
        parts, sizes = [], np.zeros(len(cuts), np.int64)
        runs = [ws[k : k + RUN] for k in range(0, len(ws), RUN)]
        at = 0
        for k in range(0, len(runs), 64):
            for run, e in zip(runs[k : k + 64], self.library.encode_batch_fast([" " + " ".join(run) for run in runs[k : k + 64]], add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                first = np.flatnonzero(self.spaced[ids])
                if len(first) == len(run) and first[0] == 0:
                    own = np.diff(np.append(first, len(ids)))
                else:
                    ids, own = self._encode([" " + w for w in run])
                parts.append(ids)
                sizes[plain[at : at + len(run)]] = own
                at += len(run)
        values = np.concatenate([*parts, np.zeros(0, np.int32)])
        if len(plain) == len(cuts):
            return values, sizes
        more, own = self._encode([" " + w for w in cuts.take(pa.array(np.flatnonzero(alone))).to_pylist()])
        sizes[alone] = own
        each = np.concatenate((sizes[plain], own))
        place = np.empty(len(cuts), np.int64)
        place[np.concatenate((plain, np.flatnonzero(alone)))] = np.arange(len(cuts))
        return gather(np.concatenate((values, more)), each, place)

    def _learn(self, cuts: pa.Array, values: np.ndarray, sizes: np.ndarray) -> None:
        """Keep new results; they join the newest table some at a time, and that grows old when it is full."""
        self.pending.append((cuts, values, sizes))
        if sum(len(c) for c, _, _ in self.pending) < self.known // 4:
            return
        words, ids, n = (list(x) for x in zip(*self.pending))
        self.pending = []
        if self.tables and len(self.tables[0].words) < self.known:
            t = self.tables.pop(0)
            words, ids, n = [t.words, *words], [t.ids.astype(np.int32), *ids], [np.diff(t.at), *n]
        ends = np.concatenate(([0], np.cumsum(np.concatenate(n)))).astype(np.int32)
        self.tables.insert(0, Packed(pa.concat_arrays(words), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))))
        del self.tables[2:]

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end (each closed by ``end``), and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cuts, index, firsts = split_cuts(texts)
        inner = np.ones(len(index), bool)
        inner[firsts] = False
        wanted = np.zeros(len(cuts), bool)  # a cut that only begins texts is not needed after a space
        wanted[index[inner]] = True
        base = len(cuts)
        sizes, starts = np.zeros(base + len(firsts) + 1, np.int64), np.zeros(base + len(firsts) + 1, np.int64)
        values, total = [], 0

        def put(at: np.ndarray | slice, ids: np.ndarray, own: np.ndarray) -> None:
            nonlocal total
            sizes[at], starts[at] = own, total + np.cumsum(own) - own
            values.append(ids.astype(np.int32, copy=False))
            total += len(ids)

        left = np.flatnonzero(wanted)
        for t in self.tables:
            place = t.find(cuts if len(left) == base else cuts.take(pa.array(left)))
            hit = place >= 0
            rows = place[hit]
            own = (t.at[rows + 1] - t.at[rows]).astype(np.int64)
            put(left[hit], pieces_at(t.ids, t.at[rows].astype(np.int64), own), own)
            left = left[~hit]
        new = cuts.take(pa.array(left))
        ids, own = self.after_space(new)
        put(left, ids, own)
        put(slice(base, base + len(firsts)), *self._encode(cuts.take(pa.array(index[firsts])).to_pylist()))
        put(slice(base + len(firsts), None), np.array([end or 0]), np.ones(1, np.int64))
        self._learn(new, ids, own)
        index[firsts] = base + np.arange(len(firsts))
        if end is not None:
            index, firsts = np.insert(index, np.append(firsts[1:], len(index)), len(sizes) - 1), firsts + np.arange(len(firsts))
        return pieces_at(np.concatenate(values), starts[index], sizes[index]).view(np.uint32), np.add.reduceat(sizes[index], firsts)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def split_cuts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct cuts of the texts, the place of each cut of each text among them, and where each text begins."""
    lists = pc.split_pattern(texts, " ")
    if pc.any(pc.match_substring_regex(texts, TWO_SPACES)).as_py():  # a cut only between two other characters
        lists = pa.array([_CUT.split(t) if _SPACES.search(t) else t.split(" ") for t in texts.to_pylist()], pa.list_(pa.string()))
    values = lists.flatten().dictionary_encode()
    return values.dictionary, values.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets)[:-1].astype(np.int64) - lists.offsets[0].as_py()


# ---- the format ---------------------------------------------------------------------------


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment's blob."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest) or not levels:
        more = rest >> np.uint64(8)
        on = more > 0
        m = len(rest)
        bits = np.zeros((m + 63) // 64 * 64, np.uint8)
        bits[:m] = on
        runs = np.add.reduceat(bits.astype(np.uint64), np.arange(0, len(bits), 512)) if m else np.zeros(0, np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(runs, dtype=np.uint64)))
        levels.append(struct.pack("<Q", m) + (rest & np.uint64(255)).astype(np.uint8).tobytes() + np.packbits(bits, bitorder="little").tobytes() + ranks.tobytes())
        rest = more[on]
    head = b"DACT" + struct.pack("<HHQQ", 1, len(levels), len(ids), len(doc_ids))
    return head + doc_ids.astype("<i8").tobytes() + ends.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """Random access to a blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"DACT":
            raise ValueError("not a token segment")
        version, levels, self.n_tokens, n_docs = struct.unpack_from("<HHQQ", blob, 4)
        if version != 1:
            raise ValueError(f"unknown version {version}")
        at = 24
        self.doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
        self.ends = np.frombuffer(blob, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", blob, at)
            words, runs = (m + 63) // 64, (m + 511) // 512
            at += 8
            chunks = np.frombuffer(blob, np.uint8, m, at)
            bitmap = np.frombuffer(blob, np.uint8, words * 8, at + m)
            ranks = np.frombuffer(blob, "<u8", runs + 1, at + m + words * 8)
            at += m + words * 8 + 8 * (runs + 1)
            self.levels.append((chunks, bitmap, ranks))

    def __getitem__(self, i: int) -> int:
        out = shift = 0
        for chunks, bitmap, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return out
            run = i >> 9
            i = int(ranks[run]) + int(np.unpackbits(bitmap[run * 64 : (i >> 3) + 1], bitorder="little")[: i - run * 512].sum())
            shift += 8
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(self.n_tokens, np.uint32)
        at = None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            on = np.flatnonzero(np.unpackbits(bitmap, bitorder="little")[: len(chunks)])
            if at is None:
                out[:], at = part, on
            else:
                out[at] |= part
                at = at[on]
        return out


# ---- writing and reading ------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, encode = TaskContext.get().partitionId(), _encoder(path)
    doc_ids: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    n = base = seq = 0

    def flush() -> pa.RecordBatch:
        nonlocal doc_ids, ids, counts, n, base, seq
        ends = np.cumsum(np.concatenate(counts))
        blob = pack(np.concatenate(doc_ids), ends, np.concatenate(ids))
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base]), pa.array([len(ends)]), pa.array([n]), pa.array([blob], pa.binary())], ["part", "seq", "base", "n_docs", "n_tokens", "blob"])
        base, seq, n, doc_ids, ids, counts = base + n, seq + 1, 0, [], [], []
        return out

    for b in batches:
        for lo, hi in slices(b.column(1), SLICE):
            x, c = encode(b.column(1)[lo:hi], end)
            doc_ids.append(pc.fill_null(b.column(0)[lo:hi], NO_ID).to_numpy(zero_copy_only=False))
            ids.append(x)
            counts.append(c)
            n += len(x)
            if n >= SEGMENT:
                yield flush()
        release()
    if n:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encode ``docs`` and write the dataset at ``path``, ids in ascending doc_id order."""
    file = tokenizer or default_tokenizer()
    known = F.when(F.col("doc_id") == F.lit(NO_ID + 1) - 1, F.raise_error(F.lit("doc_id -2**63 stands for null in token files"))).otherwise(F.col("doc_id").cast("long"))
    rows = docs.select(known.cast("long").alias("doc_id"), text_of().alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(lambda it: _segments(it, file, end), SCHEMA).write.parquet(path)


def _read(spark: SparkSession, path: str, column: str, kind: str, value) -> DataFrame:
    """Per document of the dataset: ``doc_id, start, n_tokens`` and ``column``, what ``value`` makes of the packed ids."""
    seg = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Segment(blob.as_buffer())
                raw = memoryview(s.all().astype("<u4", copy=False)).cast("B")
                starts = np.concatenate(([0], s.ends[:-1]))
                own = pa.array([value(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), s.ends.tolist())], pa.binary() if kind == "binary" else pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), pa.array(np.full(len(own), part, np.int32)), pa.array(base + starts), pa.array(s.ends - starts), own], ["doc_id", "part", "start", "n_tokens", column])

    docs = seg.select("part", "base", "blob").mapInArrow(run, f"doc_id long, part int, start long, n_tokens long, {column} {kind}")
    parts = seg.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # a row for each written part: as many as the write had tasks
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", column)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the dataset: ``doc_id, start, n_tokens, ids`` (packed u32), in no order."""
    return _read(spark, path, "ids", "binary", bytes)


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as tokens, read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return _read(docs.sparkSession, path, "ids_crc32", "long", zlib.crc32)


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
