"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into words where no piece can cross: before a space mark that follows another
   character, and between characters that no piece has side by side. The distinct words of all texts
   are counted, with a map-side part.
2. Every distinct word's substrings of at most the longest piece's length are exploded and joined, on
   equality, to the broadcast piece table (whose size is the model's). The edges found are grouped by
   word; words are dealt out once, by their count, and no further exchange is needed.
3. A higher-order ``aggregate`` folds each word's edges into its segmentation: a Viterbi fold for
   unigram models; for BPE models a fold of merges, the best-scored edge over two neighbouring
   symbols first, leftmost on ties. (Viterbi over BPE scores does not give the library's ids.)
4. The table of words and ids goes back to the documents: the most frequent words, up to ``TABLE``
   bytes, in a broadcast; where the corpus has more words, each task lists the others that its
   documents use, they are joined to the table, and the documents are filled in, one to a row.

Edge cases: null and empty texts give no ids and decode to the empty text; characters without a
piece become byte pieces, or the unknown id where the model has none; words of more than ``LONG``
characters are segmented by the same rules with a heap or an array in the task, as their edges or steps
would outgrow one row; rows that repeat are each encoded; ties are leftmost (merges) or the
earliest start (Viterbi); extra columns are ignored; an empty table gives no rows. ``decode`` adds a
column named ``decoded`` (lengthened where one of that name exists).
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Packed, Pressed, cut, fresh, gather, most_frequent, pieces_at, release, scratch, slices, text_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
SLICE = 4 << 20
SHARE = 20_000
TABLE = 128 << 20
LONG = {BPE: 1024, UNIGRAM: 1 << 16}
MISSING = (1 << 20) - 1


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


# ---- model --------------------------------------------------------------------------------


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass(eq=False)
class PieceModel:
    """The piece table of a model file, or one given as ``(piece, score, type)`` rows in id order."""

    rows: list[tuple[str, float, int]]
    kind: int = BPE
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0
    longest: int = 1
    neighbours: frozenset[str] = frozenset()

    def __post_init__(self):
        self.ids = {p: i for i, (p, _, t) in enumerate(self.rows) if t not in (UNKNOWN, CONTROL, BYTE)}
        by = {p: i for i, (p, _, t) in enumerate(self.rows) if t == BYTE}
        self.byte_ids = [by[f"<0x{b:02X}>"] for b in range(256)] if len(by) == 256 else []
        self.unknown = next((i for i, r in enumerate(self.rows) if r[2] == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.neighbours = frozenset(p[k : k + 2] for p in self.ids for k in range(len(p) - 1))
        crossing = [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing:
            raise ValueError(f"pieces that cross words are not supported: {crossing[:3]}")

    @staticmethod
    def read(path: str) -> PieceModel:
        with open(path, "rb") as f:
            raw = f.read()
        rows, kind = [], UNIGRAM
        for n, v in _fields(raw):
            if n == 1:
                x = dict(_fields(v))
                rows.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif n == 2:
                kind = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3 and dict(_fields(v)).get(2):
                raise ValueError("models that rewrite characters are not supported")
        return PieceModel(rows, kind)

    def single(self, c: str) -> list[int]:
        """The ids of a character that is not part of a longer piece."""
        i = self.ids.get(c)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    def triples(self, word: str) -> list[tuple[int, int, int, float]]:
        """For Viterbi: start, end, id and score of all pieces in a word of any length, single characters too, by end and start."""
        low = min((r[1] for r in self.rows), default=0.0) - 10.0
        out = []
        for s, c in enumerate(word):
            out.append((s, s + 1, self.ids.get(c, MISSING)))
            for e in range(s + 2, min(len(word), s + self.longest) + 1):
                i = self.ids.get(word[s:e])
                if i is not None:
                    out.append((s, e, i))
        out.sort(key=lambda x: (x[1], x[0]))
        return [(s, e, i, self.rows[i][1] if i != MISSING else low) for s, e, i in out]

    def merge_long(self, word: str) -> list[int]:
        """The merges of one long word, with a heap over neighbouring symbols."""
        n = len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n))
        gone, heap, ids = [False] * n, [], self.ids

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < n:
                i = ids.get(word[a : stop[b]]) if stop[b] - a <= self.longest else None
                if i is not None:
                    heapq.heappush(heap, (-self.rows[i][1], a, b, stop[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if gone[a] or b >= n or gone[b] or stop[a] != b or stop[b] != e:
                continue
            gone[b], stop[a] = True, e
            if e < n:
                before[e] = a
            offer(before[a], a)
            offer(a, e)
        out, s = [], 0
        while s < n:
            out += [ids[word[s : stop[s]]]] if stop[s] - s > 1 else self.single(word[s])
            s = stop[s]
        return out

    def viterbi_long(self, word: str) -> list[int]:
        best = [(0.0, 0, 0)] + [(-1e30, 0, 0)] * len(word)
        for s, e, i, score in self.triples(word):
            if best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s, i)
        out, e = [], len(word)
        while e:
            _, s, i = best[e]
            out.append([i] if i != MISSING else self.single(word[s]))
            e = s
        return [i for x in reversed(out) for i in x]

    def fold_long(self, word: str) -> list[int]:
        return self.merge_long(word) if self.kind == BPE else self.viterbi_long(word)


@lru_cache(maxsize=4)
def _model(path: str) -> PieceModel:
    return PieceModel.read(path)


# ---- words --------------------------------------------------------------------------------

_RUN = re.compile(f"{MARK}+[^{MARK}]*")


def words_of(text: str) -> list[str]:
    """The words of a text, each without its first space mark."""
    return [w[1:] for w in _RUN.findall(MARK + text.replace(" ", MARK))] if text else []


@lru_cache(maxsize=2)
def _sides(model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """A class for each character that a longer piece has (0: none), and whether a piece has two classes side by side."""
    chars = sorted(set("".join(model.neighbours)))
    kind = np.zeros(0x110000, np.uint16)
    kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    side = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for x in model.neighbours:
        side[kind[ord(x[0])], kind[ord(x[1])]] = True
    return kind, side


def parts_of(words: pa.Array, model: PieceModel) -> tuple[pa.Array, np.ndarray]:
    """The words, each with its space mark, cut where no piece has the two characters side by side: all parts end to
    end, and the place of each word's first part."""
    marked = pc.binary_join_element_wise(MARK, words, "")
    raw = b"".join([marked.buffers()[2].to_pybytes()]) if len(words) else b""
    code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    kind, side = _sides(model)
    c = kind[code]
    cuts = np.ones(len(code), bool)
    cuts[1:] = ~side[c[:-1], c[1:]]
    ends = np.cumsum(pc.utf8_length(marked).to_numpy(zero_copy_only=False), dtype=np.int64)
    firsts = np.concatenate(([0], ends))[: len(words)].astype(np.int64)
    cuts[firsts] = True
    width = 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)
    at = np.flatnonzero(cuts)
    offsets = np.append((np.cumsum(width) - width)[at], len(raw)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    return parts, np.searchsorted(at, firsts)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the place of each word of each text among them, and where each text begins."""
    odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.or_(pc.match_substring(texts, MARK), pc.equal(pc.binary_length(texts), 0)))
    lists = pc.split_pattern(texts, " ")
    if pc.any(odd).as_py():
        own = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        order = np.arange(len(texts))
        order[own] = len(texts) + np.arange(len(own))
        lists = pa.concat_arrays([lists, pa.array([words_of(t) for t in texts.take(pa.array(own)).to_pylist()], pa.list_(pa.string()))]).take(pa.array(order))
    values = lists.flatten().dictionary_encode()
    starts = np.asarray(lists.offsets).astype(np.int64)
    return values.dictionary, values.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts - starts[0]


def _tally(batches: Iterator[pa.RecordBatch], model: PieceModel) -> Iterator[pa.RecordBatch]:
    """The parts of words and how often they occur, for about ``SLICE`` bytes of text at a time."""
    for b in batches:
        for lo, hi in slices(b.column(0), SLICE):
            words, index, _ = split_words(b.column(0)[lo:hi])
            parts, firsts = parts_of(words, model)
            known = parts.dictionary_encode()
            each = np.repeat(np.bincount(index, minlength=len(words)), np.diff(np.append(firsts, len(parts))))
            n = np.bincount(known.indices.to_numpy(zero_copy_only=False), weights=each, minlength=len(known.dictionary)).astype(np.int64)
            out = pa.RecordBatch.from_arrays([known.dictionary, pa.array(n)], ["w", "n"])
            yield out.filter(pc.less_equal(pc.utf8_length(known.dictionary), LONG[model.kind]))
        release()


# ---- lattice and folds --------------------------------------------------------------------


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """``piece, id, score, rank`` of the pieces that stand for text, equal scores with equal ranks: a row for each piece."""
    known = list(model.ids.items())
    order = {v: k for k, v in enumerate(sorted({-model.rows[i][1] for _, i in known}))}
    rank = [order[-model.rows[i][1]] for _, i in known]
    columns = {"piece": pa.array([p for p, _ in known], pa.string()), "id": pa.array([i for _, i in known], pa.int32()), "score": pa.array([model.rows[i][1] for _, i in known], pa.float64()), "rank": pa.array(rank, pa.int64())}
    return spark.createDataFrame(pa.table(columns))


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """``w, n, edges, chars`` of each distinct ``w``: for BPE models edges ``(s, e, id)`` of two characters and more, best
    first and leftmost on ties, for others edges ``(k, s, e, id, v)`` of all lengths by end and start; and its characters
    ``(s, id)`` in order (MISSING where one is no piece). An edge of a merge, and a character, is one number."""
    tails = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.char_length("w"))).alias("at")).withColumn("tail", F.expr(f"substring(w, at, {model.longest})"))
    subs = tails.select("w", "n", (F.col("at") - 1).alias("s"), "tail", F.explode(F.sequence(F.lit(1), F.char_length("tail"))).alias("l"))
    subs = subs.select("w", "n", "s", "l", F.expr("substring(tail, 1, l)").alias("sub"))
    found = subs.join(F.broadcast(piece_table(words.sparkSession, model)), F.col("sub") == F.col("piece"), "left").where("id is not null or l = 1")
    end = F.col("s") + F.col("l")
    if model.kind == BPE:  # positions are below 2**11, as LONG bounds these words; characters come after the edges
        position = F.shiftleft(F.col("s").cast("long"), 31).bitwiseOR(F.shiftleft(end.cast("long"), 20))
        edge = F.shiftleft("rank", 42).bitwiseOR(position).bitwiseOR(F.col("id").cast("long"))
        char = F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(position).bitwiseOR(F.coalesce("id", F.lit(MISSING)).cast("long"))
        grouped = found.select("w", "n", F.when(F.col("l") > 1, edge).otherwise(char).alias("x")).groupBy("w").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("x")).alias("x"))
        many = F.size("x") - F.char_length("w")
        return grouped.select("w", "n", F.slice("x", F.lit(1), many).alias("edges"), F.slice("x", many + 1, F.char_length("w")).alias("chars"))
    edges = F.sort_array(F.collect_list(F.struct(end.cast("double").alias("k"), "s", end.alias("e"), "id", F.col("score").alias("v"))))
    own = F.shiftleft(F.col("s").cast("long"), 20).bitwiseOR(F.coalesce("id", F.lit(MISSING)).cast("long"))
    return found.groupBy("w").agg(F.max("n").alias("n"), edges.alias("edges"), F.sort_array(F.collect_list(F.when(F.col("l") == 1, own))).alias("chars"))


BLOCK = 64


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(st: Column, i: Column) -> Column:
    return F.get(F.get(st, F.shiftright(i, 6)), i.bitwiseAND(F.lit(BLOCK - 1)))


def _blocks(n: Column, value) -> Column:
    """``value(i)`` for i in 0 .. n - 1, in blocks, so that a change copies one block and not all."""
    count = F.floor((n + BLOCK - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.transform(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, n) - 1), value))


def _missing(w: Column, s: Column, model: PieceModel) -> Column:
    """The ids of the character at ``s`` that is no piece."""
    if not model.byte_ids:
        return F.array(F.lit(model.unknown))
    code = F.hex(F.encode(F.substring(w, s + 1, F.lit(1)), "UTF-8"))
    table = F.array(*map(F.lit, model.byte_ids))
    return F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.get(table, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))


def _id(x: Column) -> Column:
    """The id of an edge of a merge or of a character."""
    return x.bitwiseAND(F.lit(MISSING)).cast("int")


def _merge_fold(w: Column, edges: Column, chars: Column, model: PieceModel) -> Column:
    """State: the boundaries between symbols, from 0 to the end; without the 0 once no merge is left. An edge that reaches
    from a boundary to the next but one covers two neighbouring symbols. Each step makes the first such merge: the boundary
    inside goes. Pairs of boundaries are met with all edges at once (``array_intersect`` keeps the edges' order), as a
    lambda for each edge and step costs far more."""
    pair = lambda s, e: F.shiftleft(s, 11).bitwiseOR(e)
    rest = F.lit(LONG[BPE] + 1)

    def folded(spans: Column) -> Column:
        def step(ends: Column, _: Column) -> Column:
            pairs = F.zip_with(ends, F.slice(ends, F.lit(3), rest), pair)  # null for the last two
            best = F.get(F.array_intersect(spans, pairs), F.lit(0))
            middle = F.get(ends, F.array_position(ends, F.shiftright(best, 11)).cast("int"))
            return F.when(F.get(ends, F.lit(0)) > 0, ends).otherwise(F.coalesce(F.array_remove(ends, middle), F.slice(ends, F.lit(2), rest)))

        def symbols(ends: Column) -> Column:
            def one(e: Column, k: Column) -> Column:
                return _bind(F.coalesce(F.get(ends, k - 1), F.lit(0).cast("long")), lambda s: F.when(e - s == 1, F.get(chars, s.cast("int"))).otherwise(F.get(edges, F.array_position(spans, pair(s, e)).cast("int") - 1)))

            return F.transform(ends, one)

        start = F.sequence(F.lit(0).cast("long"), F.size(chars).cast("long"))
        return F.aggregate(F.slice(chars, F.lit(2), rest), start, step, lambda ends: _bind(F.array_remove(ends, F.lit(0).cast("long")), symbols))

    def ids(found: Column) -> Column:
        plain = lambda x: F.when(_id(x) == MISSING, _missing(w, F.shiftright(x, 31).bitwiseAND(F.lit(2047)).cast("int"), model)).otherwise(F.array(_id(x)))
        return F.when(F.exists(found, lambda x: _id(x) == MISSING), F.flatten(F.transform(found, plain))).otherwise(F.transform(found, _id))

    spans = F.transform(edges, lambda x: F.shiftright(x, 20).bitwiseAND(F.lit((1 << 22) - 1)))
    return _bind(_bind(spans, folded), ids)


def _viterbi_fold(w: Column, edges: Column, chars: Column, model: PieceModel) -> Column:
    """State: for each position the best score, and the start and id of the edge that reaches it. Edges come by end and start."""
    low = min((r[1] for r in model.rows), default=0.0) - 10.0
    n = F.size(chars)
    cell = lambda v, s, i: F.struct(v.cast("double").alias("v"), s.cast("int").alias("s"), i.cast("int").alias("id"))
    start = _blocks(n + 1, lambda i: cell(F.when(i == 0, 0.0).otherwise(-1e30), F.lit(0), F.lit(0)))

    def step(st: Column, x: Column) -> Column:
        put = lambda v: F.transform(st, lambda old, b: F.when(b == F.shiftright(x["e"], 6), F.transform(old, lambda c, i: F.when(b * BLOCK + i == x["e"], cell(v, x["s"], F.coalesce(x["id"], F.lit(MISSING)))).otherwise(c))).otherwise(old))
        score = _at(st, x["s"])["v"] + F.coalesce(x["v"], F.lit(low))
        return _bind(score, lambda v: F.when(v > _at(st, x["e"])["v"], put(v)).otherwise(st))

    best = F.aggregate(edges, start, step)

    def path(st: Column) -> Column:
        def back(acc: Column, _: Column) -> Column:
            def go(c: Column) -> Column:
                own = F.when(c["id"] == MISSING, F.reverse(_missing(w, c["s"], model))).otherwise(F.array(c["id"]))
                last = F.get(acc["ids"], F.size(acc["ids"]) - 1)
                full = F.size(last) >= 4 * BLOCK  # appended to the last run of ids, so that a long word is not copied at each step
                grown = F.when(full, F.concat(acc["ids"], F.array(own))).otherwise(F.concat(F.slice(acc["ids"], F.lit(1), F.size(acc["ids"]) - 1), F.array(F.concat(last, own))))
                return F.struct(c["s"].alias("at"), grown.alias("ids"))

            return F.when(acc["at"] == 0, acc).otherwise(_bind(_at(st, acc["at"]), go))

        empty = F.struct(n.alias("at"), F.array(F.array().cast("array<int>")).alias("ids"))
        return F.aggregate(chars, empty, back, lambda acc: F.reverse(F.flatten(acc["ids"])))

    return _bind(best, path)


def word_table(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``w, n, ids`` of all distinct words of ``docs`` (with ``text``) of up to LONG characters.

    Words are dealt out ``SHARE`` to a partition, so that few substrings are sorted at a time; a task takes some in turn.
    """
    tallied = docs.select(text_of().alias("text")).mapInArrow(lambda it: _tally(it, model), "w string, n long")
    words = cut(tallied.groupBy("w").agg(F.sum("n").alias("n")), "tally")
    parts = max(1, -(-words.count() // SHARE))
    fold = _merge_fold if model.kind == BPE else _viterbi_fold
    table = lattice(words.repartition(parts, "w"), model).select("w", "n", fold(F.col("w"), F.col("edges"), F.col("chars"), model).alias("ids"))
    return table.coalesce(max(1, parts // 4)) if parts > 24 else table


# ---- back to the documents ----------------------------------------------------------------


class Filler:
    """Turns texts into ids with a table; words that the table lacks become -1 - k, k their place in the list of the rest."""

    def __init__(self, model: PieceModel, table: Packed):
        self.model, self.table = model, table

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all texts end to end, where each text begins (and the last ends), and the words that are missing."""
        words, index, starts = split_words(texts)
        if not len(index):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), []
        parts, firsts = parts_of(words, self.model)
        known = parts.dictionary_encode()
        place, table = self.table.find(known.dictionary), self.table
        found = place >= 0
        at, sizes = np.zeros(len(place), np.int64), np.ones(len(place), np.int64)
        at[found], sizes[found] = table.at[place[found]], table.at[place[found] + 1] - table.at[place[found]]
        # the table's ids that are asked for, then those of the words it lacks
        own = pieces_at(table.ids, at[found], sizes[found]).astype(np.int32)
        at[found] = np.cumsum(sizes[found]) - sizes[found]
        values, rest, end = [own], [], len(own)
        for k in np.flatnonzero(~found).tolist():
            w = known.dictionary[k].as_py()
            if len(w) > LONG[self.model.kind]:
                values.append(np.array(self.model.fold_long(w), np.int32))
            else:
                values.append(np.array([-1 - len(rest)], np.int32))
                rest.append(w)
            at[k], sizes[k] = end, len(values[-1])
            end += len(values[-1])
        of = known.indices.to_numpy(zero_copy_only=False)
        by_word = pieces_at(np.concatenate(values), at[of], sizes[of])
        ids, own = gather(by_word, np.add.reduceat(sizes[of], firsts), index)
        return ids, np.concatenate(([0], np.cumsum(own)))[starts], rest


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """For a slice of rows at a time: ids of rows, texts, and what ``Filler`` gives."""
    model, table = shared.value
    fill = Filler(model, table.unpacked())
    for b in batches:
        for lo, hi in slices(b.column(1), SLICE):
            texts = b.column(1)[lo:hi]
            yield b.column(0)[lo:hi], texts, *fill(texts)
        release()


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def _digests(texts: pa.Array) -> list[pa.Array]:
    import zlib

    raw = [t.as_buffer() for t in texts]
    return [pa.array([x.size for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]


ENCODED = "doc_id long, ids array<int>, n_bytes long, crc long"


def _table_of(docs: DataFrame, model: PieceModel, table: int) -> tuple[Pressed, DataFrame | None]:
    """The words that fit in ``table`` bytes, the most frequent first; and all words, if some do not fit."""
    words = cut(word_table(docs, model), "words")
    head, whole = most_frequent(words, "w", F.octet_length("w") + 4 * F.size("ids") + 24, table)
    return Pressed.read(head.select("w", "ids")), None if whole else words


def encode(docs: DataFrame, model: PieceModel | str | None = None, table: int = TABLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, ids`` and the text's ``n_bytes, crc``."""
    m = model if isinstance(model, PieceModel) else _model(model or default_model())
    return _encoded(docs, m, table, None)


def _encoded(docs: DataFrame, m: PieceModel, table: int, finish) -> DataFrame:
    """As ``encode``; with ``finish``, what it makes of ``(doc_ids, ids, starts, texts or None, digests)`` and its schema."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    with scratch(docs.sparkSession):
        pressed, words = _table_of(docs, m, table)
        shared = docs.sparkSession.sparkContext.broadcast((m, pressed))
        del pressed
        if words is None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for doc_ids, texts, ids, starts, _ in _encode(batches, shared):
                    if finish:
                        yield finish[0](doc_ids, ids, starts, texts, None)
                    else:
                        yield pa.RecordBatch.from_arrays([doc_ids, _lists(ids, starts), *_digests(texts)], ["doc_id", "ids", "n_bytes", "crc"])

            return rows.mapInArrow(run, finish[1] if finish else ENCODED)

        def list_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 33
            for doc_ids, texts, ids, starts, rest in _encode(batches, shared):
                ids, own, sizes = _own_rest(ids, starts, len(rest))
                words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(rest, pa.string()).take(pa.array(own)))
                rows = pa.array(np.arange(row, row + len(doc_ids)))
                row += len(doc_ids)
                yield pa.RecordBatch.from_arrays([rows, words, doc_ids, _lists(ids, starts), *_digests(texts)], ["row", "rest", "doc_id", "ids", "n_bytes", "crc"])

        # written once: the numbers of rows and the places of their words hold from here on. A row holds one document,
        # so that what a reader, a join or a group has in memory at a time does not grow with a slice of texts
        coded = cut(rows.mapInArrow(list_rest, f"row long, rest array<string>, {ENCODED}"), "coded", stay=True)
        used = coded.select("row", F.posexplode("rest").alias("k", "w"))
        joined = used.join(words.select("w", F.col("ids").alias("own")), "w")
        filled = cut(joined.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("k", "own"))).alias("own")), "filled", stay=True)
    # small files of lists may be large in memory: no broadcast
    whole = coded.drop("rest").join(filled.hint("merge"), F.col("row") == F.col("_row"), "left").select(F.col("own.own").alias("own"), "doc_id", "ids", "n_bytes", "crc")

    def put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(2), b.column(0)
            for lo, hi in _runs(ids, SLICE // 4):
                part = b.slice(lo, hi - lo)
                values, starts = _put_in(lists[lo:hi], ids[lo:hi])
                if finish:
                    yield finish[0](part.column(1), values, starts, None, (part.column(3), part.column(4)))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(1), _lists(values, starts), part.column(3), part.column(4)], ["doc_id", "ids", "n_bytes", "crc"])
            release()

    return whole.mapInArrow(put_in, finish[1] if finish else ENCODED)


def _own_rest(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Missing words counted by text: ``ids`` with -1 - k for the k-th missing word of a text, which of the ``n`` missing
    words each text has (end to end), and how many."""
    at = np.flatnonzero(ids < 0)
    text = np.searchsorted(starts, at, side="right") - 1
    pairs, place = np.unique(text * max(n, 1) + (-1 - ids[at].astype(np.int64)), return_inverse=True)
    of = pairs // max(n, 1)
    out = ids.copy()
    out[at] = -1 - (place - np.searchsorted(of, text))
    return out, pairs % max(n, 1), np.bincount(of, minlength=len(starts) - 1)


def _runs(lists: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of lists with about ``most`` values, one list at least."""
    ends, lo = np.asarray(lists.offsets), 0
    while lo < len(lists):
        hi = min(len(lists), max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


def _put_in(own: pa.ListArray, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the entries of each row's ``own`` (a list of ids for each of its missing words, or null) in their places."""
    coded, starts = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets).astype(np.int64)
    starts, absent = starts - starts[0], coded < 0
    entries = own.flatten()  # of null rows nothing
    n_own = np.nan_to_num(pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    first = np.cumsum(n_own) - n_own
    values, sizes = entries.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), np.diff(starts))
    index = np.where(absent, first[row] - 1 - coded, len(sizes) + np.cumsum(~absent) - 1).astype(np.int64)
    out, each = gather(np.concatenate((values, coded[~absent])), np.concatenate((sizes, np.ones(int((~absent).sum()), np.int64))), index)
    return out, np.concatenate(([0], np.cumsum(each)))[starts]


# ---- decoding -----------------------------------------------------------------------------


def decode_ids(ids: Iterable[int], table: list[bytes | None]) -> bytes:
    raw = b"".join([table[i] for i in ids]).replace(MARK.encode(), b" ")
    return raw[1:] if raw[:1] == b" " else raw


def piece_bytes(model: PieceModel) -> list[bytes]:
    surface = {UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
    return [surface.get(t, str.encode)(p) for p, _, t in model.rows]


def decode(encoded: DataFrame, model: PieceModel | str | None = None) -> DataFrame:
    """``encoded`` (with ``ids``) plus ``decoded``, the text; bytes that are not UTF-8 are replaced."""
    m = model if isinstance(model, PieceModel) else _model(model or default_model())
    table = piece_bytes(m)  # as long as the piece table
    at, (name,) = encoded.columns.index("ids"), fresh(encoded.columns, "decoded")
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                out = [decode_ids(x.values.to_numpy(zero_copy_only=False).tolist(), table).decode("utf-8", "replace") for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, name])

    return encoded.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: PieceModel | str | None = None, table: int = TABLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_pieces, ids, round_trip`` (the ids decode to the whole text)."""
    import zlib

    m = model if isinstance(model, PieceModel) else _model(model or default_model())
    decoded_as = piece_bytes(m)

    def check(doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray, texts: pa.Array | None, digests: tuple | None) -> pa.RecordBatch:
        same = []
        for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            raw = decode_ids(ids[a:b].tolist(), decoded_as)  # of one text at a time: a list of numbers is large
            same.append(raw == texts[k].as_buffer().to_pybytes() if texts is not None else (len(raw), zlib.crc32(raw)) == (digests[0][k].as_py(), digests[1][k].as_py()))
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(starts)), _lists(ids, starts), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return _encoded(docs, m, table, (check, "doc_id long, n_pieces long, ids array<int>, round_trip boolean"))
