"""Hard negatives by a dual-tree search: a tree over anchors against a tree over candidates.

A node is a ball (centre, radius) with the labels in it. For a pair of nodes every inner product lies in
``c·d ± (|c| s + |d| r + r s)``, so that one comparison prunes a whole group of anchors against a whole set of
candidates; pairs of leaves are scored exactly in integers.

1. The upper levels of the candidate tree are fitted on ``SAMPLE`` rows (a bounded sample; it decides only how rows
   are dealt out), at most ``CELLS`` cells; every row is placed. Cells with more than a block's rows (one vector
   may be a third of all) are split by a hash. A block's anchors form groups of at most ``GROUP``, with the
   score that their positives reach within the block as a first floor.
2. Groups are compared with cells (at most ``CELLS``, broadcast), those that stay with the blocks of the cells
   (an equi-join); so groups travel to the blocks that can matter. Many groups of one block are dealt to
   several tasks.
3. Per task, the lower levels of both trees are built and searched together; each anchor gets the block's
   best. A window per anchor merges the blocks'. The search runs twice: first for positives, then for negatives
   between the bounds that the positives' scores set.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; rows that
repeat are rows of their own, a row is not its own positive, ties go by vec_id and then by row. A null vec_id is
not divisible by anything (no anchor) and comes after all ids. Vectors of unequal length count as padded by zeros.
Components and scores beyond 64 bits are clipped to them. A positive score of zero or less has at most the negatives the
inequality admits (score 0 for 0, none below). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ANCHORS = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SAMPLE = 4096
CELLS = 4096
LEAST_BLOCK, MOST_BLOCK = 4096, 1 << 16
LEAF = 256
GROUP = 32
TILE = 512
LIMIT = (1 << 63) - 1
NONE = -LIMIT - 1

ROWS = "row long, vec_id long, label int, anchor boolean, vector array<long>"
BALL = "block long, cell int, grp long, center array<double>, radius double, least long, labels array<int>, rows array<long>, floors array<long>"


# ---- vectors ------------------------------------------------------------------------------


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of integers, padded by zeros to ``dim`` (else the longest)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    sizes = np.diff(starts)
    dim = max(int(sizes.max(initial=0)), dim or 0)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)] = flat
    return out


def widen(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, clipped to 64 bits."""
    most = int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 1 << 53:  # doubles hold every partial sum
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


# ---- trees --------------------------------------------------------------------------------


@dataclass(eq=False)
class Node:
    index: np.ndarray
    center: np.ndarray
    norm: float
    radius: float
    labels: frozenset
    children: tuple = ()


def ball(x: np.ndarray, labels: np.ndarray, index: np.ndarray) -> Node:
    own = x[index].astype(float)
    c = own.mean(axis=0)
    return Node(index, c, float(np.linalg.norm(c)), float(np.sqrt(((own - c) ** 2).sum(axis=1).max())) * (1 + 1e-9), frozenset(labels[index].tolist()))


def halves(x: np.ndarray, index: np.ndarray) -> list[np.ndarray]:
    """The rows below and above the median of the widest axis; halves by place where all values are equal."""
    own = x[index]
    axis = int(np.argmax(own.astype(float).var(axis=0))) if x.shape[1] else 0
    order = np.argsort(own[:, axis], kind="stable") if x.shape[1] else np.arange(len(index))
    return [index[order[: len(order) // 2]], index[order[len(order) // 2 :]]]


def tree(x: np.ndarray, labels: np.ndarray, leaf: int, index: np.ndarray, by_label: bool = False) -> Node:
    """Splits by label first (if so asked), then along the widest axes, down to ``leaf`` rows."""
    node = ball(x, labels, index)
    if by_label and len(node.labels) > 1:
        order = index[np.argsort(labels[index], kind="stable")]
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        parts = np.split(order, [cuts[len(cuts) // 2]])
    elif len(index) > leaf:
        parts = halves(x, index)
    else:
        return node
    node.children = tuple(tree(x, labels, leaf, p, by_label) for p in parts)
    return node


def interval(a: Node, b: Node) -> tuple[float, float]:
    mid = float(a.center @ b.center)
    reach = a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    slack = 1 + 1e-9 * (abs(mid) + reach)
    return mid - reach - slack, mid + reach + slack


def together(anchors: Node, rows: Node, useless: Callable[[Node, Node, float, float], bool], score: Callable[[Node, Node], None]) -> None:
    """Visits the pairs of leaves that no pair of nodes above makes useless, those with the highest bounds first."""
    stack = [(anchors, rows, *interval(anchors, rows))]
    while stack:
        a, b, low, high = stack.pop()
        if useless(a, b, low, high):
            continue
        if not a.children and not b.children:
            score(a, b)
            continue
        wide = b.children and (not a.children or b.radius >= a.radius or len(b.labels) > 1)
        pairs = [(a, c) for c in b.children] if wide else [(c, b) for c in a.children]
        stack += sorted(((p, q, *interval(p, q)) for p, q in pairs), key=lambda e: e[3])


class Best:
    """Per query the ``k`` rows of highest score, ties by id and row; ``floor`` is what a row has to reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor, self.kept = k, floors.copy(), [[] for _ in floors]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        if len(at) > self.k:  # no more than can enter, with all ties of the last
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        both = sorted(self.kept[q] + [(-int(scores[j]), int(ids[j]), int(rows[j])) for j in at[np.lexsort((rows[at], ids[at], -scores[at]))[: self.k]]])[: self.k]
        self.kept[q] = both
        if len(both) == self.k:
            self.floor[q] = max(self.floor[q], -both[-1][0])


# ---- rows, cells and blocks ---------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    i = F.col("vec_id").cast("long")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        i.alias("vec_id"),
        F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"),
        F.coalesce(i % ANCHORS == 0, F.lit(False)).alias("anchor"),
        whole.alias("vector"),
    )


def upper_levels(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and thresholds of a full binary tree of ``depth`` levels, in heap order: medians along the widest axes."""
    axes, cuts, parts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), [sample]
    for k in range(len(axes)):
        own = parts[k]
        if len(own) and own.shape[1]:
            axes[k] = int(np.argmax(own.astype(float).var(axis=0)))
            cuts[k] = float(np.median(own[:, axes[k]]))
        above = own[:, axes[k]] > cuts[k] if own.shape[1] else np.zeros(len(own), bool)
        parts += [own[~above], own[above]]
    return axes, cuts


def cell_of(x: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    x = widen(x, max(x.shape[1], int(axes.max(initial=-1)) + 1))
    at = np.zeros(len(x), np.int64)
    for _ in range(len(axes).bit_length()):
        at = 2 * at + 1 + (x[np.arange(len(x)), axes[at]] > cuts[at])
    return at - len(axes)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cell`` and ``block``; written, as both have to hold from here on."""
    n = rows.count()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // 32))
    depth = min(CELLS, max(1, n // block)).bit_length() - 1
    axes, cuts = np.zeros(0, np.int64), np.zeros(0)
    if depth:
        axes, cuts = upper_levels(matrix(rows.select("vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow().column(0)), depth)

    def run(batches):
        for b in batches:
            cell = cell_of(matrix(b.column(4)), axes, cuts) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    out = cut(rows.mapInArrow(run, ROWS + ", cell int"), "rows", stay=True)
    cells = out.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count("*") / block).cast("long").alias("_parts"))
    part = F.pmod(F.xxhash64("row"), F.col("_parts"))
    # a row for each cell: CELLS at most
    return cut(out.join(F.broadcast(cells), out["cell"] == cells["_cell"]).withColumn("block", F.shiftleft(F.col("cell").cast("long"), 40) + part).drop("_cell", "_parts"), "rows", stay=True)


def balls(rows: DataFrame) -> DataFrame:
    """Per block its ball (``grp`` null), and the groups of its anchors with the floors of their positives."""
    names = [c.split()[0] for c in BALL.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(t: pa.Table) -> pa.Table:
        x, labels, own = matrix(t.column("vector")), t.column("label").to_numpy(), t.column("row").to_numpy()
        block, cell = t.column("block")[0].as_py(), t.column("cell")[0].as_py()
        whole = ball(x, labels, np.arange(len(x)))
        out = [(block, cell, None, whole.center, whole.radius, None, sorted(whole.labels), None, None)]
        asked = np.flatnonzero(t.column("anchor").to_numpy(zero_copy_only=False))
        leaves = [tree(x, labels, GROUP, asked)] if len(asked) else []
        while leaves:
            node = leaves.pop()
            leaves += node.children
            if node.children:
                continue
            floors = np.full(len(node.index), NONE)
            for lab in node.labels:
                mine, peers = np.flatnonzero(labels[node.index] == lab), np.flatnonzero(labels == lab)
                if len(peers) > POSITIVES:  # the anchor itself is one of them
                    scores = inner(x[node.index[mine]], x[peers])
                    itself = np.searchsorted(peers, node.index[mine])
                    scores[np.arange(len(mine)), itself] = NONE
                    floors[mine] = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES]
            out.append((block, cell, int(own[node.index[0]]), node.center, node.radius, int(floors.min()), sorted(node.labels), own[node.index].tolist(), floors.tolist()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return cut(rows.select("block", "cell", "row", "label", "anchor", "vector").groupBy("block").applyInArrow(run, BALL), "balls", stay=True)


def visits(groups: DataFrame, blocks: DataFrame, same_label: bool) -> DataFrame:
    """``grp, block``: the blocks that a group has to be held against; ``groups`` have ``center, radius, least, labels``.

    ``least`` is what a score must reach; with ``same_label`` a label must be shared, else one must be another.
    """
    dim = blocks.agg(F.max(F.size("center"))).first()[0] or 0
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(c)))
    blocks = blocks.select("block", "cell", pad(F.col("center")).alias("center"), "radius", "labels")
    means = blocks.groupBy("cell").agg(F.array(*[F.avg(F.col("center")[k]) for k in range(dim)]).cast("array<double>").alias("mean"), F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"))
    away = F.sqrt(F.aggregate(F.zip_with("center", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    # a row for each cell: CELLS at most
    spread = blocks.join(F.broadcast(means.drop("labels")), "cell").groupBy("cell").agg(F.max(away + F.col("radius")).alias("radius"))
    cells = means.join(spread, "cell").select("cell", "mean", "radius", "labels").collect()
    shared = [(r["cell"], np.array(r["mean"]), float(np.linalg.norm(r["mean"])), r["radius"], frozenset(r["labels"])) for r in cells]

    def useful(center: np.ndarray, radius: float, least: int, labels: frozenset, b: tuple) -> bool:
        if not (labels & b[4] if same_label else b[4] - labels or len(labels) > 1):
            return False
        _, high = interval(Node(None, widen(center[None], len(b[1]))[0], float(np.linalg.norm(center)), radius, labels), Node(None, b[1], b[2], b[3], b[4]))
        return high >= least

    def run(batches):
        for b in batches:
            got = []
            for r in b.to_pylist():
                a = np.array(r["center"]), r["radius"], r["least"], frozenset(r["labels"])
                got += [(r["grp"], c[0]) for c in shared if useful(*a, c)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int64()), pa.array([c for _, c in got], pa.int32())], ["grp", "cell"])

    near = groups.select("grp", "center", "radius", "least", "labels").mapInArrow(run, "grp long, cell int")
    pairs = near.join(blocks, "cell").select("grp", "block", F.col("center").alias("d"), F.col("radius").alias("s"), F.col("labels").alias("others"))
    pairs = pairs.join(groups.select("grp", pad(F.col("center")).alias("c"), "radius", "least", "labels"), "grp")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    length = lambda x: F.sqrt(dot(x, x))
    mid, reach = dot(F.col("c"), F.col("d")), length(F.col("c")) * F.col("s") + length(F.col("d")) * F.col("radius") + F.col("radius") * F.col("s")
    other = (F.size("labels") > 1) | (F.size(F.array_except("others", "labels")) > 0)
    labels = F.arrays_overlap("labels", "others") if same_label else other
    return pairs.where(labels & (mid + reach + 1 + 1e-9 * (F.abs(mid) + reach) >= F.col("least"))).select("grp", "block")


# ---- the search ---------------------------------------------------------------------------

FOUND = "query long, place int, id long, found long, score long"


def searched(rows: DataFrame, groups: DataFrame, pairs: DataFrame, make: Callable) -> DataFrame:
    """Holds groups (``grp`` and the anchors' columns) against the rows of their blocks, some groups at a time."""
    pairs = cut(pairs, "visits", stay=True)
    tiles = pairs.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    left = rows.join(tiles, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "row", "vec_id", "label", "vector")
    right = pairs.join(tiles, "block").select("block", F.pmod(F.xxhash64("grp"), F.col("tiles")).cast("int").alias("tile"), "grp").join(groups, "grp")
    left, right = left.select(*[F.col(c).alias(c) for c in left.columns]), right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(make, FOUND)


def _sides(rows: pa.Table, asked: pa.Table) -> tuple:
    x, y = matrix(rows.column("vector")), matrix(asked.column("vector"))
    dim = max(x.shape[1], y.shape[1])
    ids = pc.fill_null(rows.column("vec_id"), LIMIT).to_numpy()
    labels, mine = rows.column("label").to_numpy(), asked.column("label").to_numpy()
    return widen(x, dim), widen(y, dim), ids, rows.column("row").to_numpy(), labels, mine, asked.column("row").to_numpy(), tree(widen(x, dim), labels, LEAF, np.arange(len(x)), by_label=True), tree(widen(y, dim), mine, GROUP, np.arange(len(y)))


def _table(out: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names)


def find_positives(rows: pa.Table, asked: pa.Table) -> pa.Table:
    if not rows.num_rows or not asked.num_rows:
        return _table([])
    x, y, ids, own, labels, mine, queries, candidates, anchors = _sides(rows, asked)
    best = Best(asked.column("floor").to_numpy(), POSITIVES)

    def score(a: Node, b: Node) -> None:
        s = inner(y[a.index], x[b.index])
        hits = (mine[a.index][:, None] == labels[b.index]) & (s >= best.floor[a.index][:, None]) & (queries[a.index][:, None] != own[b.index])
        for k in np.flatnonzero(hits.any(axis=1)):
            best.offer(a.index[k], s[k], ids[b.index], own[b.index], np.flatnonzero(hits[k]))

    together(anchors, candidates, lambda a, b, low, high: not (a.labels & b.labels) or high < best.floor[a.index].min(), score)
    return _table([(int(queries[q]), 0, None if i == LIMIT else i, r, -s) for q, kept in enumerate(best.kept) for s, i, r in kept])


def find_negatives(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """``asked`` has the positives' scores in order in ``scores``; a query is an anchor and one of them."""
    if not rows.num_rows or not asked.num_rows:
        return _table([])
    x, y, ids, own, labels, mine, queries, candidates, anchors = _sides(rows, asked)
    scores = asked.column("scores").combine_chunks()
    sizes = np.diff(np.asarray(scores.offsets))
    of = np.repeat(np.arange(len(y)), sizes)  # the anchor of each query
    first = np.concatenate(([0], np.cumsum(sizes)))
    p = [int(v) for v in scores.flatten().to_pylist()]
    best = Best(np.array([-(-LOW * v // 100) for v in p], np.int64), NEGATIVES)
    upper = np.array([HIGH * v // 100 for v in p], np.int64)
    least, most = np.full(len(y), LIMIT), np.full(len(y), NONE)  # what any query of an anchor can use
    np.minimum.at(least, of, best.floor)
    np.maximum.at(most, of, upper)

    def score(a: Node, b: Node) -> None:
        s = inner(y[a.index], x[b.index])
        hits = (mine[a.index][:, None] != labels[b.index]) & (s >= least[a.index][:, None]) & (s <= most[a.index][:, None])
        for k in np.flatnonzero(hits.any(axis=1)):
            q, near = a.index[k], np.flatnonzero(hits[k])
            for j in range(first[q], first[q + 1]):
                at = near[(s[k, near] >= best.floor[j]) & (s[k, near] <= upper[j])]
                if len(at):
                    best.offer(j, s[k], ids[b.index], own[b.index], at)
            least[q] = best.floor[first[q] : first[q + 1]].min()

    together(anchors, candidates, lambda a, b, low, high: high < least[a.index].min() or low > most[a.index].max() or (len(a.labels) == 1 and a.labels == b.labels), score)
    return _table([(int(queries[of[j]]), int(j - first[of[j]]), None if i == LIMIT else i, r, -s) for j, kept in enumerate(best.kept) for s, i, r in kept])


def first_of(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("id"), F.asc("found")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, and ``positive_rank``."""
    rows = placed(usable(embeddings))
    both = balls(rows)
    blocks, groups = both.where("grp IS NULL"), both.where("grp IS NOT NULL")
    members = groups.select("grp", F.explode(F.arrays_zip("rows", "floors")).alias("m")).select("grp", F.col("m.rows").alias("row"), F.col("m.floors").alias("floor"))
    anchors = members.join(rows.select("row", "vec_id", "label", "vector"), "row")
    asked = anchors.select("grp", "row", "label", "vector", "floor")
    positives = cut(first_of(searched(rows, asked, visits(groups, blocks, True), find_positives), POSITIVES, ["query"]), "positives", stay=True)
    # five scores for each anchor at most; those below zero admit no negative
    scores = positives.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s")).select("query", F.col("s.score").alias("scores"))
    asked = cut(anchors.join(scores, anchors["row"] == scores["query"]).select("grp", "row", "vec_id", "label", "vector", "scores"), "anchors", stay=True)
    least = asked.groupBy(F.col("grp").alias("_grp")).agg(F.floor(F.min(F.array_min("scores")).cast("double") * (LOW / 100)).cast("long").alias("_least"))
    again = groups.join(least, groups["grp"] == least["_grp"]).withColumn("least", F.col("_least") - 1).drop("_grp", "_least")
    found = first_of(searched(rows, asked.drop("vec_id"), visits(again, blocks, False), find_negatives), NEGATIVES, ["query", "place"])
    p = positives.select(F.col("query").alias("row"), (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select(F.col("query").alias("row"), "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(p, ["row", "place"])
    out = out.join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", (F.col("place") + 1).cast("int").alias("positive_rank"))
