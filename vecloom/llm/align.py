"""Alignment of two tokenizers over the same bytes, by a sweep over the events of their token ends.

A token ends at a byte offset; the ends of both sides are the events. Between two neighbouring events exactly
one token of each side lies, and two tokens that overlap do so in one such stretch, so that the events are the
links. Offsets where both sides end cut the tokens into groups.

1. Each task encodes its texts (whole) with both libraries and emits runs of events: a row per side and about
   ``SPAN`` bytes of text with the byte offset at which it begins, and the ids, whose byte lengths are a table.
2. The runs of both sides are united, repartitioned by document and sorted within partitions by offset.
3. A machine reads each partition as a stream. It keeps the tokens of the open group, some counts and a digest,
   whatever the length of a document, and emits per document its counts and the links, as packed id pairs.
4. Links are counted by pair, with a part per task. The most frequent pairs, up to ``TABLE`` bytes, go to all
   tasks; the documents' links that fall beside them are joined to the counts.

Edge cases: null and empty texts, and texts whose joined tokens differ from space+text on either side (a text
with U+2581, for one), have no tokens: zeros and the empty digest. Rows with equal or null ids are documents of
their own. Very long texts are many runs; a document's digest is sequential, so all its runs meet in one task.
Ties between counts are all best. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, most_frequent, pieces_at, release, slices, text_of
from .pieces import BYTE, MARK, PieceModel, default_model, split_words
from .token_store import Encoder, default_tokenizer

SLICE = 4 << 20
SPAN = 16 << 10
SWEEP = 1 << 19
KNOWN = 300_000
TABLE = 64 << 20
A, B = 0, 1


# ---- the two sides ------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others moved past 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bytes:
    """The bytes of each token id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return pieces_at(self.raw, self.starts[ids], self.sizes[ids])


class BytePairs(Encoder):
    """Side A: the byte-level tokenizer over space+text."""

    def __init__(self, path: str):
        super().__init__(path, plain=True, known=KNOWN)
        alphabet, vocab = byte_alphabet(), self.library.get_vocab()
        tokens = [b""] * (max(vocab.values(), default=0) + 1)
        for piece, i in vocab.items():
            tokens[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.bytes = Bytes(tokens)


class Pieces(Encoder):
    """Side B: the piece model; no piece crosses from word to word, so that a distinct word is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.library, self.known, self.tables, self.pending = sentencepiece.SentencePieceProcessor(model_file=path), KNOWN, [], []
        model = PieceModel.read(path)
        self.space = model.single(MARK)  # of the empty word, for which the library gives nothing
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in model.rows])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, index, starts = split_words(texts)
        sizes, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        values, total, left = [], 0, np.arange(len(words))
        for t in self.tables:
            place = t.find(words.take(pa.array(left)))
            hit = place >= 0
            own = (t.at[place[hit] + 1] - t.at[place[hit]]).astype(np.int64)
            values.append(pieces_at(t.ids, t.at[place[hit]].astype(np.int64), own).astype(np.int32))
            sizes[left[hit]], at[left[hit]] = own, total + np.cumsum(own) - own
            total, left = total + len(values[-1]), left[~hit]
        new = words.take(pa.array(left))
        ids = [np.array(x or self.space, np.int32) for x in self.library.encode(new.to_pylist(), num_threads=1)] if len(new) else []
        own, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate([*ids, np.zeros(0, np.int32)])
        sizes[left], at[left] = own, total + np.cumsum(own) - own
        self._learn(new, flat, own)
        by_word = np.concatenate([*values, flat])
        out = pieces_at(by_word, at[index], sizes[index])
        ends = np.concatenate(([0], np.cumsum(sizes[index])))[starts]
        return out, np.diff(ends)


@lru_cache(maxsize=1)
def _sides(tokenizer: str, model: str) -> tuple[BytePairs, Pieces]:
    return BytePairs(tokenizer), Pieces(model)


def encode_both(texts: pa.Array, sides: tuple[BytePairs, Pieces]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side the ids of all texts end to end and how many each has; none where a side does not give space+text."""
    n = len(texts)
    sizes = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    full = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    own = texts.take(pa.array(full))
    spaced = pc.binary_join_element_wise(" ", own, "")
    want = np.frombuffer(b"".join(x.as_buffer() for x in spaced), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64))))
    got, right = [], np.ones(len(full), bool)
    for side, given in zip(sides, (spaced, own)):
        ids, each = side(given) if len(full) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ids = ids.astype(np.int64)
        joined = side.bytes.join(ids)
        if len(joined) != len(want) or not np.array_equal(joined, want):
            token_ends = np.concatenate(([0], np.cumsum(side.bytes.sizes[ids])))
            ends = token_ends[np.concatenate(([0], np.cumsum(each)))]
            for k in range(len(full)):
                right[k] &= np.array_equal(joined[ends[k] : ends[k + 1]], want[bounds[k] : bounds[k + 1]])
        got.append((ids, each))
    out = []
    for s, (ids, each) in enumerate(got):
        sizes[s][full] = np.where(right, each, 0)
        out.append((ids if right.all() else ids[np.repeat(right, each)], sizes[s]))
    return out


# ---- events -------------------------------------------------------------------------------

EVENTS = "row long, doc_id long, offset long, side int, ids binary"


def events(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """Runs of token ends of both sides; a document without tokens has one empty run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(tokenizer, model)
        for b in batches:
            for lo, hi in slices(b.column(2), SLICE):
                rows, doc_ids = (b.column(c)[lo:hi].to_numpy(zero_copy_only=False) for c in (0, 1))
                columns: list[list] = [[], [], [], []]
                for side, ((ids, each), own) in enumerate(zip(encode_both(b.column(2)[lo:hi], sides), sides)):
                    raw = ids.astype("<u2").tobytes()
                    ends = np.cumsum(own.bytes.sizes[ids])
                    stops = np.cumsum(each)
                    for k, (stop, n) in enumerate(zip(stops.tolist(), each.tolist())):
                        at = first = stop - n
                        base = int(ends[at - 1]) if at else 0
                        while at < stop or (n == 0 and side == A):
                            begins = int(ends[at - 1]) - base if at > first else 0
                            # a run ends with the first token to end at or past the next multiple of SPAN
                            to = min(stop, int(np.searchsorted(ends, base + (begins // SPAN + 1) * SPAN)) + 1) if n * 256 > SPAN else stop
                            for c, v in zip(columns, (k, begins, side, raw[2 * at : 2 * to])):
                                c.append(v)
                            at = to
                            if n == 0:
                                break
                of = np.array(columns[0], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[of], pa.int64()), b.column(1)[lo:hi].take(pa.array(of)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
                    ["row", "doc_id", "offset", "side", "ids"],
                )
            release()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, EVENTS)


# ---- the machine --------------------------------------------------------------------------

PARTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


class Machine:
    """Consumes runs of events in order; keeps the open group of one document, its digest and nothing else."""

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.sizes = sizes_a, sizes_b
        most = max(len(sizes_a), len(sizes_b))
        self.written = pa.array([f"{i}{s}" for i in range(most) for s in ",|;"])
        self.row: int | None = None
        self.doc_id: int | None = None
        self.open = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.digest = None
        self.out: list[tuple] = []

    def _close(self) -> None:
        if self.row is not None:
            self.out.append((self.row, self.doc_id, 0, 0, 0, 0, self.digest.hexdigest() if self.digest else "", b""))
        self.digest = None

    def feed(self, docs: list[tuple[int, int | None, list[list[np.ndarray]]]]) -> list[tuple]:
        """Documents in order with their runs of either side; the first may go on with the open one, the last may go on later."""
        segments, firsts = [], []
        for k, (row, doc_id, runs) in enumerate(docs):
            more = self.open if k == 0 and row == self.row else None
            segments.append([np.concatenate([*([more[s]] if more else []), *runs[s], np.zeros(0, np.int64)]) for s in (A, B)])
            firsts.append(row != self.row if k == 0 else True)
        a, b = (np.concatenate([x[s] for x in segments]) for s in (A, B))
        ends_a, ends_b = np.cumsum(self.sizes[A][a]), np.cumsum(self.sizes[B][b])
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        twice = ends[:-1][ends[1:] == ends[:-1]]
        last = int(twice[-1]) if len(twice) else 0
        na, nb = int(np.searchsorted(ends_a, last, "right")), int(np.searchsorted(ends_b, last, "right"))
        self.open, a, b, ends_a, ends_b = [a[na:], b[nb:]], a[:na], b[:nb], ends_a[:na], ends_b[:nb]
        ends = ends[: na + nb]
        events = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
        links = (a[np.searchsorted(ends_a, events)] << 16 | b[np.searchsorted(ends_b, events)]).astype("<u4")
        # groups are written A tokens first: a token's place is that in its own side plus what the other side has before
        group_a, group_b = np.searchsorted(twice, ends_a), np.searchsorted(twice, ends_b)
        to_a, to_b = np.searchsorted(ends_a, twice, "right"), np.searchsorted(ends_b, twice, "right")
        tokens = np.empty(na + nb, np.int64)
        tokens[np.arange(na) + np.concatenate(([0], to_b))[group_a]] = a * 3 + (ends_a == twice[group_a])
        tokens[np.arange(nb) + to_a[group_b]] = b * 3 + 2 * (ends_b == twice[group_b])
        text = self.written.take(pa.array(tokens))
        places = np.frombuffer(text.buffers()[1], np.int32)[: na + nb + 1] if na + nb else np.zeros(1, np.int32)
        raw = memoryview(text.buffers()[2] or b"")
        # where each document's part stops, in either side, in groups and in links
        stop_a = np.minimum(np.cumsum([len(x[A]) for x in segments]), na)
        stop_b = np.minimum(np.cumsum([len(x[B]) for x in segments]), nb)
        upto = np.concatenate(([0], ends_a))[stop_a]
        stop_g, stop_l = np.searchsorted(twice, upto, "right"), np.searchsorted(events, upto, "right")
        before = (0, 0, 0, 0)
        for k, stops in enumerate(zip(stop_a.tolist(), stop_b.tolist(), stop_g.tolist(), stop_l.tolist())):
            if firsts[k]:
                self._close()
                self.row, self.doc_id = docs[k][0], docs[k][1]
            own = tuple(y - x for x, y in zip(before, stops))
            if own[0]:
                if self.digest is None:
                    self.digest = hashlib.sha256()
                else:
                    self.digest.update(b";")
                self.digest.update(raw[places[before[0] + before[1]] : places[stops[0] + stops[1]] - 1])
                self.out.append((self.row, self.doc_id, *own, None, links[before[3] : stops[3]].tobytes()))
            before = stops
        out, self.out = self.out, []
        return out

    def end(self) -> list[tuple]:
        self._close()
        return self.out


def sweep(runs: DataFrame, sizes_a: np.ndarray, sizes_b: np.ndarray) -> DataFrame:
    """Parts of documents with counts and links, the last part of each with its digest."""
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
    names = [c.split()[0] for c in PARTS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, docs, held = Machine(sizes_a, sizes_b), [], 0
        for b in batches:
            for row, doc_id, side, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if not docs or docs[-1][0] != row:
                    if held > SWEEP:
                        if got := machine.feed(docs):
                            yield batch(got)
                        docs, held = [], 0
                    docs.append((row, doc_id, [[], []]))
                elif held > 2 * SWEEP:  # a long document
                    if got := machine.feed(docs):
                        yield batch(got)
                    docs, held = [(row, doc_id, [[], []])], 0
                own = np.frombuffer(ids.as_buffer(), "<u2").astype(np.int64)
                docs[-1][2][side].append(own)
                held += len(own)
        if docs and (got := machine.feed(docs)):
            yield batch(got)
        if got := machine.end():
            yield batch(got)

    return runs.repartition("row").sortWithinPartitions("row", "offset", "side").select("row", "doc_id", "offset", "side", "ids").mapInArrow(run, PARTS)


# ---- counts of pairs ----------------------------------------------------------------------


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links hold each pair of ids, and whether no pair with its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def merged() -> pa.RecordBatch:
            codes, ns = (np.concatenate(x) for x in zip(*held))
            codes, place = np.unique(codes, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(np.bincount(place, weights=ns).astype(np.int64))], ["pair", "n"])

        for b in batches:
            for lo, hi in slices(b.column(0), SLICE):
                raw = b"".join(x.as_buffer() for x in b.column(0)[lo:hi])
                if raw:
                    held.append(np.unique(np.frombuffer(raw, "<u4"), return_counts=True))
                    total += len(held[-1][0])
                if total > 1 << 22:
                    yield merged()
                    held, total = [], 0
        if held:
            yield merged()

    pairs = cut(parts.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs", stay=True)
    b = F.col("pair").bitwiseAND(0xFFFF)
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # one row for each id of the second vocabulary
    return pairs.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, table: int = TABLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    tokenizer, model = tokenizer or default_tokenizer(), model or default_model()
    a, b = _sides(tokenizer, model)
    parts = cut(sweep(events(docs, tokenizer, model), a.bytes.sizes, b.bytes.sizes), "links", stay=True)
    counts = cut(pair_counts(parts), "pairs", stay=True)
    head, whole = most_frequent(counts, "pair", F.lit(13), table)
    got = head.toArrow()
    pairs, ns, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    shared = docs.sparkSession.sparkContext.broadcast((pairs[order].astype(np.uint32), ns[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ns, best = shared.value
        none = np.zeros(1, np.int64)
        for b in batches:
            for lo, hi in slices(b.column(7), SLICE):
                part = b.slice(lo, hi - lo)
                sizes = pc.binary_length(part.column(7)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                codes = np.frombuffer(b"".join(x.as_buffer() for x in part.column(7)), "<u4")
                at = np.searchsorted(pairs, codes)
                found = at < len(pairs)
                found[found] = pairs[at[found]] == codes[found]
                bounds = np.concatenate((none, np.cumsum(sizes)))
                each_n, each_best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
                each_n[found], each_best[found] = ns[at[found]], best[at[found]]
                sums, bests = (np.diff(np.concatenate((none, np.cumsum(x)))[bounds]) for x in (each_n, each_best))
                rest = [np.unique(codes[x:y][~found[x:y]], return_counts=True) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())] if not found.all() else [(none[:0], none[:0])] * len(sizes)
                ends = pa.array(np.concatenate((none, np.cumsum([len(x) for x, _ in rest]))).astype(np.int32))
                flat = [np.concatenate([x[k] for x in rest]).astype(np.int64) if rest else none[:0] for k in (0, 1)]
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], ["pair", "k"]))
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(bests), pa.array(sums), lists], [*part.schema.names[:7], "n_best", "count_sum", "rest"])

    fields = ", ".join(f for f in PARTS.split(", ")[:7]) + ", n_best long, count_sum long, rest array<struct<pair:long,k:long>>"
    scored = parts.mapInArrow(run, fields)
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    if not whole:
        scored = cut(scored, "scored", stay=True)
        used = scored.where(F.size("rest") > 0).select("row", "doc_id", F.explode("rest").alias("r")).select("row", "doc_id", "r.pair", "r.k")
        late = used.join(counts, "pair").select("row", "doc_id", *[F.lit(0).cast("long").alias(c) for c in sums[:4]], F.lit(None).cast("string").alias("groups_sha256"), (F.col("k") * F.col("best").cast("long")).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum"))
        scored = scored.drop("rest").unionByName(late)
    return scored.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sums], F.max("groups_sha256").alias("groups_sha256")).drop("row")
