"""Hard negatives against brute force, with small trees, ties, odd vectors and repeated rows."""

import math
import random

import numpy as np
import pytest

from tests.compare import connect, same
from vecloom.llm import negatives, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
CLASH = "vec_id long, label int, embedding array<float>, row int, cell int, block int"


def brute(rows):
    kept = []
    for i, lab, v in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]))
    dim = max((len(v) for _, _, v in kept), default=0)
    x = np.array([v + [0] * (dim - len(v)) for _, _, v in kept], np.int64).reshape(len(kept), dim)
    last = lambda i: 1 << 70 if i is None else i
    out = []
    for a, (i, lab, _) in enumerate(kept):
        if i is None or i % 50:
            continue
        s = (x @ x[a]).tolist()
        order = sorted(range(len(kept)), key=lambda j: (-s[j], last(kept[j][0]), j))
        for j in [j for j in order if j != a and kept[j][1] == lab][:5]:
            fit = [k for k in order if kept[k][1] != lab and 50 * s[j] <= 100 * s[k] <= 95 * s[j]][:3]
            out += [(i, kept[j][0], r + 1, kept[k][0], s[j], s[k]) for r, k in enumerate(fit)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, v in (("LEAST_BLOCK", 60), ("LEAF", 20), ("GROUP", 3), ("TILE", 2)):
        monkeypatch.setattr(negatives, name, v)


def test_embeddings_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert rows_of(queries.op11_hard_negatives(spark, sf_dir)) == brute(rows)


def test_embeddings_against_sql(spark, sf_dir):
    same(queries.op11_hard_negatives(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op11_hard_negatives"])


def test_deep_trees_and_many_tiles(spark, sf_dir, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert rows_of(queries.op11_hard_negatives(spark, sf_dir)) == brute(rows)


def test_odd_rows_ties_and_a_common_vector(spark, small):
    rnd = random.Random(1)
    rows = [(rnd.randrange(300), rnd.choice([None, 0, 1, 2]), None if rnd.random() < 0.05 else [rnd.choice([0.5, 0.25, 0.1, -0.3]) for _ in range(rnd.choice([3, 3, 3, 2]))]) for _ in range(400)]
    rows += [(50, 1, [1.0, None, 2.0]), (50, 1, [float("nan"), 1.0, 1.0]), (100, 1, [float("inf"), 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (None, 2, [1.0, 1.0, 1.0]), (150, 0, [])]
    rows += [(50, 2, [0.5, 0.5, 0.5])] * 2 + [(700 + k % 3, k % 2, [0.5, 0.5, 0.5]) for k in range(400)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CLASH)
    assert rows_of(negatives.hard_negatives(df)) == brute([tuple(r)[:3] for r in df.collect()])


def test_empty_tables_and_values_beyond_64_bits(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], CLASH)).count() == 0
    one = [(50, 1, [0.5, 0.5], 1, 1, 1)]
    assert negatives.hard_negatives(spark.createDataFrame(one, CLASH)).count() == 0
    huge = [(50, 1, [1e30, 1.0], 1, 1, 1), (51, 1, [1e30, 1.0], 1, 1, 1), (52, 2, [1e20, 1.0], 1, 1, 1), (53, 2, [1.0, 1.0], 1, 1, 1)]
    assert negatives.hard_negatives(spark.createDataFrame(huge, CLASH)).count() == 0  # clipped: no score is at most 0.95 of another


def test_node_intervals_hold_every_pair():
    rnd = np.random.default_rng(0)
    x = rnd.integers(-99, 99, (200, 8))
    labels = np.zeros(200, np.int32)
    a, b = negatives.tree(x, labels, 10, np.arange(100)), negatives.tree(x, labels, 10, np.arange(100, 200))
    low, high = negatives.interval(a.children[0], b.children[1])
    s = negatives.inner(x[a.children[0].index], x[b.children[1].index])
    assert low <= s.min() and s.max() <= high
    pruned, scored = [], []
    near = lambda p, q, lo, hi: hi < 60_000 and not pruned.append(len(p.index) * len(q.index))
    negatives.together(a, b, near, lambda p, q: scored.append((p.index, q.index)))
    assert sum(pruned) > 0 and sum(pruned) + sum(len(p) * len(q) for p, q in scored) == 100 * 100
    found = {(i, j) for p, q in scored for i in p.tolist() for j in q.tolist()}
    assert {(i, 100 + j) for i, j in np.argwhere(negatives.inner(x[:100], x[100:]) >= 60_000).tolist()} <= found
