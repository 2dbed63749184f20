"""Copies in a media column: local descriptors, blocks compared whole, geometric consensus.

1. Equal bytes collapse to one row first (map-side), so a picture held by a third of all rows is
   described and joined once.
2. Each picture is described on a pyramid of scales: corner responses, every one that is the greatest within
   ``REACH`` pixels of its level (a rule of the neighbourhood: corners grow with the area, and a crop keeps those
   of its part), the orientation of the intensity centroid around each, and 256 binary tests in the frame
   turned by it.
3. Hamming tables: in each table a feature is keyed by some bits of its descriptor, drawn once; more bits the more
   features there are, so that a feature meets about ``MEETS`` unrelated ones in a table whatever the size of the
   corpus, and more tables the longer the keys, so that a match of ``DIFFER`` differing bits shares a key in one of them
   with the chance ``SURE`` at every size (of 256 tables at most, which keys of 39 bits need). Features
   of one key are compared whole, and pairs within ``RADIUS`` bits go on. A copy has many
   more matches than the votes it needs, so that links are found more surely than matches. (All pairs of features
   would be certain, at the square of their number.) Keys are counted first: one met very often is cut into parts, and
   each pair of parts is a group of its own, so that no task holds an unbounded key and no pair is left out.
   Features are moved in one of two ways, whichever moves them less. With at most as many blocks of ``BLOCK`` features
   as there are tables, each pair of blocks is compared in a task of its own, straight from the written blocks: features are
   written once, nothing is shuffled, and a pair of pictures is counted where it is found. Tables cost no disk there, so
   that keys are longer, with so many more tables that no match within ``RADIUS`` is found less surely. Beyond that, each
   feature is sent to one cell for each table.
4. Each match gives a similarity transform; transforms vote in two staggered grids of scale, turn and
   shift. Pictures linked by at least ``VOTES`` different features in one cell of the grid are copies.
5. Links are joined into classes.

Formats: binary PGM (P5) and PPM (P6). Edge cases: null, empty and unreadable values are a class of
their own per row content and never link to others; pictures too small for a corner link only by equal bytes;
repeated rows are equal bytes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, left_join, release, scratch

LEVELS = (1.0, 0.7071, 0.5)
REACH = 3
MARGIN = 11
RADIUS = 40
VOTES = 3
MEETS = 256
HEAVY = 20_000
SEEN = 1 << 18

# the places of the 256 tests: pairs of points around the corner
_rng = np.random.default_rng(11)
TESTS = np.clip(np.round(_rng.normal(0, 3.6, (256, 4))), -7, 7)
# those across the corner's direction first: they tell the most, and the first words decide most pairs
TESTS = TESTS[np.argsort(np.abs(TESTS[:, 0] - TESTS[:, 2]), kind="stable")]


def read_picture(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a P5 or P6 file, or None."""
    if not raw or raw[:2] not in (b"P5", b"P6"):
        return None
    try:
        parts, at = [], 2
        while len(parts) < 3:
            while raw[at : at + 1].isspace():
                at += 1
            if raw[at : at + 1] == b"#":
                at = raw.index(b"\n", at)
                continue
            end = at
            while raw[end : end + 1].isdigit() and end - at < 10:  # more digits than any picture has pixels are no size
                end += 1
            parts.append(int(raw[at:end]))
            at = end
        w, h, most = parts
        n = 1 if raw[:2] == b"P5" else 3
        if most > 255 or not 0 < w * h * n <= len(raw) - at - 1:
            return None
        p = np.frombuffer(raw, np.uint8, w * h * n, at + 1).reshape(h, w, n)
        return p.mean(axis=2, dtype=np.float32)
    except (ValueError, IndexError, OverflowError):
        return None


def write_picture(p: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (p.shape[1], p.shape[0]) + np.clip(p, 0, 255).astype(np.uint8).tobytes()


def _box(p: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1)^2, edges repeated."""
    q = np.pad(p, r + 1, mode="edge").cumsum(axis=0).cumsum(axis=1)
    k = 2 * r + 1
    return (q[k:-1, k:-1] - q[:-k - 1, k:-1] - q[k:-1, : -k - 1] + q[: -k - 1, : -k - 1]) / (k * k)


def _resize(p: np.ndarray, s: float) -> np.ndarray:
    h, w = int(p.shape[0] * s), int(p.shape[1] * s)
    y, x = (np.arange(h) + 0.5) / s - 0.5, (np.arange(w) + 0.5) / s - 0.5
    y0, x0 = np.clip(y.astype(int), 0, p.shape[0] - 2), np.clip(x.astype(int), 0, p.shape[1] - 2)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    a = p[y0][:, x0] * (1 - fx) + p[y0][:, x0 + 1] * fx
    b = p[y0 + 1][:, x0] * (1 - fx) + p[y0 + 1][:, x0 + 1] * fx
    return a * (1 - fy) + b * fy


_dy, _dx = np.mgrid[-7:8, -7:8]
_disc = (_dx * _dx + _dy * _dy <= 49).astype(np.float64)


def _greatest(r: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value within ``reach`` pixels of each, rows and columns."""
    m = np.lib.stride_tricks.sliding_window_view(np.pad(r, reach, constant_values=-np.inf), 2 * reach + 1, axis=0).max(axis=-1)
    return np.lib.stride_tricks.sliding_window_view(m, 2 * reach + 1, axis=1).max(axis=-1)


def describe(p: np.ndarray) -> list[tuple[float, float, float, float, bytes]]:
    """``(x, y, scale, angle, 32 descriptor bytes)`` of a picture's corners, in its own coordinates."""
    out = []
    for s in LEVELS:
        q = p if s == 1 else _resize(p, s)
        if min(q.shape) < 2 * MARGIN + 3:
            continue
        q = q.astype(np.float64)
        gy, gx = np.gradient(q)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        c = r[1:-1, 1:-1]
        top = c >= _greatest(r, REACH)[1:-1, 1:-1]
        top &= c > 100.0
        top[: MARGIN - 1] = top[-MARGIN + 1 :] = False
        top[:, : MARGIN - 1] = top[:, -MARGIN + 1 :] = False
        ys, xs = np.nonzero(top)
        if not len(ys):
            continue
        ys, xs = ys + 1, xs + 1
        patch = q[ys[:, None, None] + _dy, xs[:, None, None] + _dx] * _disc
        a = np.arctan2((patch * _dy).sum(axis=(1, 2)), (patch * _dx).sum(axis=(1, 2)))
        smooth, cos, sin = _box(q, 1), np.cos(a)[:, None], np.sin(a)[:, None]
        look = lambda tx, ty: smooth[np.rint(ys[:, None] + sin * tx + cos * ty).astype(int), np.rint(xs[:, None] + cos * tx - sin * ty).astype(int)]  # noqa: B023,E731
        bits = look(TESTS[:, 0], TESTS[:, 1]) < look(TESTS[:, 2], TESTS[:, 3])
        for x, y, angle, d in zip(xs, ys, a, np.packbits(bits, axis=1)):
            out.append(((x + 0.5) / s, (y + 0.5) / s, 1 / s, float(angle), d.tobytes()))
    return out


FEATURE = "struct<no:int,x:float,y:float,scale:float,angle:float,b0:bigint,b1:bigint,b2:bigint,b3:bigint>"
NAMES = ["no", "x", "y", "scale", "angle", "b0", "b1", "b2", "b3"]


def described(rows: DataFrame) -> DataFrame:
    """``id, pic, feats`` of ``rows`` (id, image): a 128-bit digest of the bytes, and the features of the first
    row of each picture in its task (null for its further copies there). Pictures themselves are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            pics, at, values, absent = [], [0], [], []
            for raw in b.column(1).to_pylist():
                pic = xxhash.xxh3_128_digest(raw)
                pics.append(pic)
                absent.append(pic in seen)
                if pic not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()  # a picture met again is described again
                    seen.add(pic)
                    p = read_picture(raw)
                    for no, (x, y, s, a, d) in enumerate(describe(p) if p is not None and min(p.shape) > 1 else []):
                        values.append((no, x, y, s, a, *np.frombuffer(d, "<i8").tolist()))
                at.append(len(values))
            cols = list(zip(*values)) if values else [[] for _ in NAMES]
            kinds = [pa.int32(), *[pa.float32()] * 4, *[pa.int64()] * 4]
            each = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], NAMES)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), each, mask=pa.array(absent))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pics, pa.binary()), lists], ["id", "pic", "feats"])
            release()

    return rows.select("id", "image").mapInArrow(run, f"id long, pic binary, feats array<{FEATURE}>")


# ---- Hamming tables -------------------------------------------------------------------------

#: In each table, the bits of a descriptor in the order in which a key takes them.
ORDERS = np.stack([_rng.permutation(256) for _ in range(256)])
#: A match of so many differing bits shares a key in one of the tables with this chance, however long keys are.
DIFFER, SURE = 24, 0.985
#: How often a bit agrees between features of unrelated pictures.
CHANCE = 0.6


def key_bits(n: int) -> int:
    """Bits of a key, for ``n`` features."""
    return int(np.clip(np.ceil(np.log(max(n, 2) / MEETS) / -np.log(CHANCE)), 8, 40))


def tables_for(bits: int) -> int:
    """How many tables keys of so many bits need: the longer the keys, the more."""
    share = np.prod(1 - DIFFER / (256 - np.arange(bits)))  # of the tables in which none of a key's bits differs
    return int(np.clip(np.ceil(np.log(1 - SURE) / np.log(1 - share)), 1, len(ORDERS)))


def keys_of(words: np.ndarray, bits: int) -> np.ndarray:
    """A key for each table (rows) and feature (columns); tables have keys of their own."""
    each = np.unpackbits(words.view(np.uint8).reshape(len(words), 32), axis=1)
    tables = tables_for(bits)
    out = np.empty((tables, len(words)), np.uint64)
    for t in range(tables):
        key = np.full(len(words), t + 1, np.uint64)
        for b in ORDERS[t, :bits]:
            key = (key << np.uint64(1)) | each[:, b].astype(np.uint64)
        out[t] = key
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (pic, feats): the picture, number, place and words of each feature."""
    f = b.column(1).flatten()
    column = lambda c: f.field(c).to_numpy(zero_copy_only=False)
    pic = np.repeat(b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
    at = np.stack([column(c) for c in ("x", "y", "scale", "angle")], axis=1)
    return pic, column("no"), at, np.ascontiguousarray(np.stack([column(f"b{k}") for k in range(4)], axis=1))


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, n = np.unique(keys_of(_flat(b)[3], bits).ravel(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


GROUP = "cell int, grp array<bigint>, side array<boolean>, pic array<bigint>, no array<int>, at array<float>, words array<bigint>"


def _deal(batches: Iterator[pa.RecordBatch], bits: int, cells: int, heavy: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each cell: its features, with the group in which each is compared."""
    hot, parts = np.array(sorted(heavy), np.int64).view(np.uint64), np.array([heavy[k] for k in sorted(heavy)], np.int64)
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            pic, no, at, words = _flat(b.slice(lo, 512))
            keys = keys_of(words, bits).ravel()
            feature = np.tile(np.arange(len(pic)), len(keys) // max(len(pic), 1))
            grp, side = _mixed(keys), np.zeros(len(keys), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                of = np.flatnonzero(hot[place] == keys)
                m = parts[place[of]]
                own = (_mixed(pic[feature[of]].view(np.uint64)) % m.astype(np.uint64)).astype(np.int64)
                other = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)  # every part meets the feature's own
                own = np.repeat(own, m)
                pair = np.minimum(own, other) * np.repeat(m, m) + np.maximum(own, other)
                more = _mixed(_mixed(np.repeat(keys[of], m)) + pair.astype(np.uint64) + np.uint64(1))
                rest = np.setdiff1d(np.arange(len(keys)), of)
                feature = np.concatenate((feature[rest], np.repeat(feature[of], m)))
                grp, side = np.concatenate((grp[rest], more)), np.concatenate((side[rest], own > other))
                same = np.concatenate((np.zeros(len(rest), bool), own == other))
                grp = np.where(same, grp | np.uint64(1), grp & ~np.uint64(1))  # the last bit tells: all pairs, or only across
                grp[: len(rest)] |= np.uint64(1)
            else:
                grp |= np.uint64(1)
            cell = ((grp >> np.uint64(1)) % np.uint64(cells)).astype(np.int32)
            order = np.argsort(cell, kind="stable")
            cell, feature, grp, side = cell[order], feature[order], grp[order], side[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            ends = np.append(first, len(cell)).astype(np.int32)
            lists = lambda x, k=1: pa.ListArray.from_arrays(pa.array(ends * k), pa.array(x))  # noqa: B023,E731
            columns = [lists(grp.view(np.int64)), lists(side), lists(pic[feature]), lists(no[feature]), lists(at[feature].astype(np.float32).ravel(), 4), lists(words[feature].ravel(), 4)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), *columns], ["cell", "grp", "side", "pic", "no", "at", "words"])


MATCH = "a long, b long, no int, scale float, turn float, tx float, ty float"


def near_pairs(grp: np.ndarray, side: np.ndarray, pic: np.ndarray, words: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``i, j`` of features of one group (sorted by ``grp``) and of different pictures within ``radius`` bits, lag by lag."""
    stop = np.searchsorted(grp, grp, "right")
    i, lag = np.arange(len(grp)), 0
    across = (grp & np.uint64(1)) == 0
    while True:
        lag += 1
        i = i[i + lag < stop[i]]
        if not len(i):
            return
        for k in range(0, len(i), 1 << 18):
            x = i[k : k + (1 << 18)]
            y = x + lag
            keep = (pic[x] != pic[y]) & (~across[x] | (side[x] != side[y]))
            x, y = x[keep], y[keep]
            d = np.zeros(len(x), np.uint16)
            for w in range(4):
                d += np.bitwise_count(words[x, w] ^ words[y, w])
                near = d <= radius
                if not near.all():
                    x, y, d = x[near], y[near], d[near]
            if len(x):
                yield x, y


def transforms(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """``scale, turn, tx, ty`` that carry places ``a`` (rows of x, y, scale, angle) to ``b``."""
    (ax, ay, a_scale, a_angle), (bx, by, b_scale, b_angle) = a.T, b.T
    s, turn = b_scale / a_scale, (b_angle - a_angle) % (2 * np.pi)
    c, d = s * np.cos(turn), s * np.sin(turn)
    return [x.astype(np.float32) for x in (s, turn, bx - (c * ax - d * ay), by - (d * ax + c * ay))]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of each cell; rows come sorted by cell."""

    def matches(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda c: np.concatenate([r.column(c).flatten().to_numpy(zero_copy_only=False) for r in rows])
        grp = column("grp").view(np.uint64)
        order = np.argsort(grp, kind="stable")
        grp, side, pic, no = grp[order], column("side")[order], column("pic")[order], column("no")[order]
        at, words = column("at").reshape(-1, 4)[order].astype(np.float64), np.ascontiguousarray(column("words").reshape(-1, 4)[order]).view(np.uint64)
        for i, j in near_pairs(grp, side, pic, words):
            swap = pic[i] > pic[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            floats = [pa.array(x) for x in transforms(at[i], at[j])]
            yield pa.RecordBatch.from_arrays([pa.array(pic[i]), pa.array(pic[j]), pa.array(no[i]), *floats], ["a", "b", "no", "scale", "turn", "tx", "ty"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        cells = b.column(0).to_numpy()
        ends = [*(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for s, e in zip([0, *ends], ends):
            if held and e > s and held[-1].column(0)[0] != b.column(0)[s]:
                yield from matches(held)
                held = []
            if e > s:
                held.append(b.slice(s, e - s))
    if held:
        yield from matches(held)


def voted(pair: np.ndarray, no: np.ndarray, scale: np.ndarray, turn: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """For each pair (0 .. n - 1), the most different features of its first picture in one cell of transforms."""
    rows = [np.stack([pair, np.full(len(pair), h), np.floor(np.log2(scale) * 2 + 0.5), np.floor(turn / (np.pi / 6) + h / 2) % 12, np.floor(tx / 16 + h / 2), np.floor(ty / 16 + h / 2), no], axis=1) for h in (0, 1)]
    one = np.unique(np.concatenate(rows).astype(np.int64), axis=0)  # a feature votes once in a cell
    cell, n = np.unique(one[:, :6], axis=0, return_counts=True)
    most = np.zeros(int(pair.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, cell[:, 0], n)
    return most


def _vote(batches: Iterator[pa.RecordBatch], votes: int) -> Iterator[pa.RecordBatch]:
    """The links of pairs of pictures; rows come sorted by pair, and a pair's matches are as many as its features."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        col = lambda c: t.column(c).to_numpy()
        a, b = col("a"), col("b")
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        most = voted(np.cumsum(first) - 1, col("no"), *(col(c).astype(np.float64) for c in ("scale", "turn", "tx", "ty")))
        on = most >= votes
        return pa.RecordBatch.from_arrays([pa.array(a[first][on]), pa.array(b[first][on]), pa.array(most[on])], ["a", "b", "n"])

    held: list[pa.RecordBatch] = []
    for x in batches:
        a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
        if not len(a):
            continue
        last = np.flatnonzero((a != a[-1]) | (b != b[-1]))
        whole = int(last[-1]) + 1 if len(last) else 0  # the last pair may go on in the next batch
        if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (a[0], b[0]):
            yield links(held)
            held = []
        if whole:
            held.append(x.slice(0, whole))
            yield links(held)
            held = []
        held.append(x.slice(whole))
    if held:
        yield links(held)


# ---- pairs of blocks ------------------------------------------------------------------------

BLOCK, FEW, SPREAD = 3 << 16, 1 << 14, 8
MORE = 8
MOST, SLICE = 3 << 20, 1 << 17
Features = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # picture, number, place and words, picture by picture


def blocks_for(n: int) -> int:
    """How many blocks hold ``n`` features: some for every core, of about ``BLOCK``."""
    return max(1, -(-n // BLOCK), min(SPREAD, -(-n // FEW)))


def longer_keys(bits: int) -> tuple[int, int]:
    """Bits and tables of keys up to ``MORE`` bits longer than ``bits``, by which no match within ``RADIUS`` is found less surely."""
    missed = lambda k: np.log1p(-np.prod(1 - RADIUS / (256 - np.arange(k))))
    for k in range(bits + MORE, bits, -1):
        tables = max(tables_for(k), int(np.ceil(tables_for(bits) * missed(bits) / missed(k))))
        if tables <= len(ORDERS):
            return k, tables
    return bits, tables_for(bits)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole pictures with about ``size`` features (one picture at least)."""

    def block() -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary()) for x, k in zip(parts, ("<i8", "<i4", "<f4", "<i8"))], ["pic", "no", "at", "words"])

    held, n = [], 0
    for b in batches:
        flat = _flat(b)
        ends, lo = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)), 0
        while lo < len(flat[0]):
            fit = int(np.searchsorted(ends, lo + size - n, "right"))
            hi = int(ends[fit - 1]) if fit else 0
            if hi <= lo and not n:
                hi = int(ends[np.searchsorted(ends, lo, "right")])
            if hi > lo:
                held.append(tuple(x[lo:hi] for x in flat))
                n, lo = n + hi - lo, hi
            if lo < len(flat[0]) or n >= size:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted values of ``parts``, which is emptied."""
    x = np.concatenate(parts)
    parts.clear()
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def matches_of(pic: np.ndarray, words: np.ndarray, left: int, bits: int, tables: int, radius: int = RADIUS, most: int | None = None) -> np.ndarray | None:
    """``i * n + j`` of the ``n`` features that share a key and differ in at most ``radius`` bits: ``i`` of the first ``left`` and ``j`` of
    the others, or (``left`` = 0) any two of different pictures. None if there are more than ``most``."""
    n = len(pic)
    shift = np.uint64(n.bit_length())
    low = (np.uint64(1) << shift) - np.uint64(1)
    octets = np.ascontiguousarray(words.view(np.uint8).reshape(n, 32).T)
    found, size, known = [np.zeros(0, np.int64)], 0, 0
    for t in range(tables):
        key = np.zeros(n, np.uint64)
        for k in range(0, bits, 8):
            octet = np.zeros(n, np.uint8)
            for b in ORDERS[t, k : min(k + 8, bits)].tolist():
                octet = (octet << np.uint8(1)) | ((octets[b >> 3] >> np.uint8(7 - (b & 7))) & np.uint8(1))
            key = (key << np.uint64(8)) | octet
        key = np.sort((key << shift) | np.arange(n, dtype=np.uint64))  # the left ones of a key come first
        again = (key[1:] ^ key[:-1]) <= low
        key = key[np.append(again, False) | np.append(False, again)]  # a key met once has no pair
        if not len(key):
            continue
        index = (key & low).astype(np.int32)
        key >>= shift
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        end = np.repeat(first + sizes, sizes)
        if left:
            x = np.flatnonzero(index < left)
            y = np.repeat(first + np.add.reduceat(index < left, first, dtype=np.int64), sizes)[x]
        else:
            x = np.arange(len(key))
            y = x + 1
        times = end[x] - y
        some = np.flatnonzero(times > 0)
        x, y, times = x[some], y[some], times[some]
        upto, at = np.cumsum(times), 0
        w0, w1 = words[index, 0], words[index, 1]
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), "right")))
            c = times[at:stop]
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - y[at:stop], c)
            d = np.bitwise_count(np.repeat(w0[x[at:stop]], c) ^ w0[j])
            d += np.bitwise_count(np.repeat(w1[x[at:stop]], c) ^ w1[j])
            near = np.flatnonzero(d <= radius)
            i, j, d = index[np.repeat(x[at:stop], c)[near]], index[j[near]], d[near]
            for w in (2, 3):
                d += np.bitwise_count(words[i, w] ^ words[j, w])
                near = d <= radius
                i, j, d = i[near], j[near], d[near]
            if not left:
                apart = pic[i] != pic[j]
                i, j = i[apart], j[apart]
            found.append(i.astype(np.int64) * n + j)
            size += len(i)
            if most and size > known + most // 3:  # several tables find the same
                found = [_distinct(found)]
                size = known = len(found[0])
                if known > most:
                    return None
            at = stop
    return _distinct(found)


def _halves(f: Features) -> list[Features]:
    """Two parts of whole pictures, or one if there is but one picture."""
    ends = np.flatnonzero(f[0][1:] != f[0][:-1]) + 1
    if not len(ends):
        return [f]
    mid = int(ends[np.abs(ends - len(f[0]) // 2).argmin()])
    return [tuple(x[:mid] for x in f), tuple(x[mid:] for x in f)]


def block_links(a: Features, b: Features | None, bits: int, tables: int, votes: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The links between pictures of ``a`` and ``b``, or (``b`` None) within ``a``. Blocks with more than ``most`` matches are halved."""
    pic, no, at, words = a if b is None else (np.concatenate(x) for x in zip(a, b))
    n, left = len(pic), 0 if b is None else len(a[0])
    code = matches_of(pic, words, left, bits, tables, most=MOST if most is None else most)
    if code is None:
        one, two = _halves(a), _halves(b) if b is not None else []
        if b is None:
            parts = [(one[0], None), (one[1], None), (one[0], one[1])]
        elif len(one) == 2 and (len(two) == 1 or len(a[0]) >= len(b[0])):
            parts = [(x, b) for x in one]
        elif len(two) == 2:
            parts = [(a, x) for x in two]
        else:
            parts, most = [(a, b)], 0  # two pictures: as many matches as they have
        for x, y in parts:
            yield from block_links(x, y, bits, tables, votes, most)
        return
    local = np.cumsum(np.append(False, pic[1:] != pic[:-1]))
    start = np.append(True, local[1:] != local[:-1]).nonzero()[0]
    lo = 0
    while lo < len(code):  # matches come sorted by i, so that slices of whole pictures hold whole pairs
        last = local[code[min(lo + SLICE, len(code)) - 1] // n]
        hi = int(np.searchsorted(code, (start[last + 1] if last + 1 < len(start) else n) * n))
        i, j = code[lo:hi] // n, code[lo:hi] % n
        lo = hi
        pair = local[i] * n + local[j]
        kinds, times = np.unique(pair, return_counts=True)
        kinds = kinds[times >= votes]
        if not len(kinds):
            continue
        place = np.minimum(np.searchsorted(kinds, pair), len(kinds) - 1)
        keep = np.flatnonzero(kinds[place] == pair)
        i, j, place = i[keep], j[keep], place[keep]
        swap = pic[i] > pic[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        moved = transforms(at[i].astype(np.float64), at[j].astype(np.float64))
        count = voted(place, no[i], *(x.astype(np.float64) for x in moved))
        on = np.flatnonzero(count >= votes)
        one, two = pic[start[kinds[on] // n]], pic[start[kinds[on] % n]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(count[on])], ["a", "b", "n"])


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch], bits: int, tables: int, votes: int) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks, each its number, then ``pic, no, at, words``."""

    def features(b: pa.RecordBatch, row: int, at: int) -> Features:
        raw = [np.frombuffer(b.column(at + k)[row].as_buffer(), kind) for k, kind in enumerate(("<i8", "<i4", "<f4", "<u8"))]
        return raw[0], raw[1], raw[2].reshape(-1, 4), raw[3].reshape(-1, 4)

    for b in batches:
        for row in range(b.num_rows):
            same = b.column(0)[row] == b.column(5)[row]
            yield from block_links(features(b, row, 1), None if same else features(b, row, 6), bits, tables, votes)
            release()


def _links_by_blocks(some: DataFrame, n: int, bits: int, votes: int) -> DataFrame:
    """The links, a task for each pair of blocks; no key and no pair of pictures is gathered from several tasks."""
    blocks = blocks_for(n)
    bits, tables = longer_keys(bits)
    written = some.repartition(blocks).mapInArrow(lambda it: _blocks(it, max(1, n // blocks * 5 // 4)), "pic binary, no binary, at binary, words binary")
    written = cut(written.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    one, two = (written.select(*[F.col(c).alias(f"{c}_{side}") for c in written.columns]) for side in "lr")
    pairs = one.hint("shuffle_replicate_nl").join(two, F.col("block_l") <= F.col("block_r"))
    return pairs.mapInArrow(lambda it: _pairs_of_blocks(it, bits, tables, votes), "a long, b long, n long")


def links(known: DataFrame, votes: int = VOTES, heavy: int = HEAVY) -> DataFrame:
    """``a, b, n``: pictures of ``known`` (pic, feats) with ``votes`` different features in one cell of transforms."""
    n = known.agg(F.sum(F.size("feats"))).first()[0] or 0
    bits = key_bits(n)
    some = known.where(F.size("feats") > 0).select("pic", "feats")
    if blocks_for(n) <= tables_for(bits):
        return _links_by_blocks(some, n, bits, votes)
    keyed = n * tables_for(bits)
    cells = max(1, -(-keyed // 150_000))
    bound = max(heavy, keyed // 10_000)  # so that at most 10,000 keys are cut
    keys = some.mapInArrow(lambda it: _count(it, bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > bound)
    parts = {r["key"]: -(-r["n"] // bound) for r in keys.collect()}
    dealt = some.mapInArrow(lambda it: _deal(it, bits, cells, parts), GROUP)
    dealt = dealt.repartition(min(cells, 4096), "cell").sortWithinPartitions("cell")
    # a match that several tables find votes once all the same
    by_pair = dealt.mapInArrow(_compare, MATCH).repartition("a", "b").sortWithinPartitions("a", "b")
    return by_pair.mapInArrow(lambda it: _vote(it, votes), "a long, b long, n long")


def media_copies(media: DataFrame, id_col: str = "id", image_col: str = "image", votes: int = VOTES) -> DataFrame:
    """Per row of ``media``: ``id, class_id`` (least id of its class), ``n_links`` of its picture, ``copies`` of its bytes."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(image_col), F.lit(b"")).alias("image"))
    with scratch(media.sparkSession):
        whole = cut(described(rows), "described", stay=True)
        rows = cut(whole.select("id", "pic"), "rows")
        pics = whole.groupBy("pic").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("feats", ignorenulls=True).alias("feats"))
        pics = cut(pics.withColumn("no", F.monotonically_increasing_id()), "pictures")  # numbers hold from here on
        discard(whole)
        l = cut(links(pics.select(F.col("no").alias("pic"), "feats"), votes), "links")
        comp = components(l)
        degree = l.select(F.col("a").alias("p")).union(l.select(F.col("b").alias("p"))).groupBy("p").agg(F.count("*").alias("n_links"))
        named = pics.select("pic", "no", "first", "copies").join(comp, F.col("no") == F.col("v"), "left").select("pic", "no", "first", "copies", F.coalesce("root", "no").alias("root"))
        least = named.groupBy("root").agg(F.min("first").alias("class_id"))
        by_pic = named.join(least, "root").join(degree, F.col("no") == F.col("p"), "left").select("pic", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
        return cut(left_join(rows.select("id", "pic"), by_pic, ["pic"]).select("id", "class_id", "n_links", "copies"), "media", stay=True)


# ---- pictures for vectors: the test tables have no media column ------------------------------


def scene(vector: bytes, side: int = 80) -> np.ndarray:
    """A picture that depends on every component: a smooth ground from the values, grain and rectangles seeded by them."""
    v = np.frombuffer(vector, "<f4").astype(np.float64)
    n = int(np.sqrt(len(v))) or 1
    ground = _resize(v[: n * n].reshape(n, n) * 120 + 128, side / n) if n > 1 else np.full((side, side), 128.0)
    rng = np.random.default_rng(xxhash.xxh64_intdigest(vector))
    ground += _box(rng.normal(0, 110, (side, side)), 1)
    for x, y, w, h, by in zip(*rng.integers(0, side - 8, (2, 12)), *rng.integers(6, 22, (2, 12)), rng.uniform(-70, 70, 12)):
        ground[y : y + h, x : x + w] += by
    return np.clip(ground, 0, 255)


def edited(p: np.ndarray, seed: int) -> np.ndarray:
    """A crop of a picture with other contrast, brightness and some noise."""
    rng = np.random.default_rng(seed)
    top, left = rng.integers(2, 12, 2)
    q = p[top : p.shape[0] - rng.integers(2, 8), left : p.shape[1] - rng.integers(2, 8)]
    return np.clip(q * rng.uniform(0.85, 1.1) + rng.uniform(-12, 12) + rng.normal(0, 1.0, q.shape), 0, 255)


def pictured(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 8) -> DataFrame:
    """``id, image``: each vector's scene; each last of ``every`` ids holds an edited crop of the scene before it."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    before = v.where(F.pmod(F.col("id"), F.lit(every)) == every - 2).select((F.col("id") + 1).alias("_to"), F.col("v").alias("_v"))
    with_before = v.join(before, (F.col("id") == F.col("_to")) & (F.pmod(F.col("id"), F.lit(every)) == every - 1), "left").select("id", "v", "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, own, prev in zip(*[b.column(k).to_pylist() for k in range(3)]):
                use = own if prev is None else prev
                p = scene(np.array([x or 0 for x in use or []], "<f4").tobytes())
                out.append(write_picture(p if prev is None else edited(p, i)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "image"])

    return with_before.mapInArrow(run, "id long, image binary")
