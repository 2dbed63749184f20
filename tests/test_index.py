"""The stored index: recall, what a search reads, rows that come later, odd vectors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.vector_udf import unit
from vecloom.operators.index import Index
from vecloom.plans import catalog

ROWS = "concept string, q array<double>"


def frame(spark, x, prefix="r"):
    return spark.createDataFrame([(f"{prefix}{k}", v.tolist()) for k, v in enumerate(x)], ROWS)


def asked(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "query_id long, query array<double>")


def recall(got, x, queries, k):
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(int(r["concept"][1:]))
    want = [set(np.argsort(-(x @ q), kind="stable")[:k].tolist()) for q in queries]
    return np.mean([len(found.get(i, set()) & w) / k for i, w in enumerate(want)])


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    centers = unit(r.normal(size=(60, 24)))
    return unit(np.repeat(centers, 60, axis=0) + 0.35 * r.normal(size=(3600, 24)) / np.sqrt(24))


def test_recall_at_a_tenth_of_the_rows(spark, clustered):
    index = Index.build(spark, frame(spark, clustered))
    cells = len(index.centroids())
    assert 50 <= cells <= 80  # about sqrt(n)
    probe = index.calibrate(10)
    assert index.calibrate(10) == probe and index.store.marks() == {f"probe:{index.version}:10:0.9": str(probe)}
    queries = clustered[::60]
    got = index.search(asked(spark, queries), 10, probe)
    assert recall(got, clustered, queries, 10) >= 0.9
    sizes = {r["cell"]: r["count"] for r in index.entries().groupBy("cell").count().collect()}
    probed = index.probed(asked(spark, queries), probe).collect()
    assert sum(sizes[r["cell"]] for r in probed) <= 0.1 * len(queries) * len(clustered)


def test_a_search_reads_only_the_folders_it_probes(spark, clustered):
    index = Index.build(spark, frame(spark, clustered))
    one = asked(spark, clustered[:1])
    cells = {r["cell"] for r in index.probed(one, 2).collect()}
    met = index.store.read_parts("entries", sorted(cells), index.version)
    assert {int(f.split("part=")[1].split("/")[0]) for f in met.inputFiles()} == cells
    read = met.count()
    assert 0 < read < len(clustered) / 8 and {r["cell"] for r in met.select("cell").distinct().collect()} == cells


def test_rows_that_come_later(spark, clustered):
    first = Index.build(spark, frame(spark, clustered[:3000]))
    before = first.store.files("entries", first.version)
    index = first.register(frame(spark, clustered[:3010]))  # ten are new
    after = index.store.files("entries")
    assert index.entries().count() == 3010 and first.entries().count() == 3000
    assert all(after[c][: len(before[c])] == before[c] for c in before)  # files that were there stay
    assert 1 <= sum(after[c] != before.get(c) for c in after) <= 10
    assert np.array_equal(index.centroids(), first.centroids())
    assert index.register(frame(spark, clustered[:3010])).version == index.version  # nothing to add
    got = index.search(asked(spark, clustered[3005:3006]), 1, 4).first()
    assert got["concept"] == "r3005"
    assert Index.open(spark, index.store.root).entries().count() == 3010


def test_odd_vectors_stay_out(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", None), ("e", []), ("z", [0.0, 0.0]), ("l", [1.0, 0.0, 0.0]), ("i", [float("inf"), 1.0]), ("a2", [1.0, 0.0])]
    index = Index.build(spark, spark.createDataFrame(rows, ROWS))
    assert sorted(r["concept"] for r in index.entries().collect()) == ["a", "a2", "b"]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, query array<double>")
    got = index.search(q, 2, index.calibrate(2)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["concept"], r["score"]) for r in got] == [(1, "a", 1.0), (1, "a2", 1.0)]
    empty = Index.build(spark, spark.createDataFrame([], ROWS))
    assert empty.search(q, 2, empty.calibrate(2)).count() == 0 and empty.register(spark.createDataFrame(rows, ROWS)).version == empty.version


def test_recall_over_the_embeddings(spark):
    big = os.environ.get("TEST_BIG_DIR", "/root/testdata/sf0.1")
    if not os.path.exists(f"{big}/embeddings.parquet"):
        pytest.skip("no larger tables here")
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{big}/embeddings.parquet").orderBy("vec_id").collect()])
    x = unit(x)
    got = catalog.QUERIES["recall_indexed"](spark, big).select("query_id", F.concat(F.lit("r"), F.split("concept", ":")[1]).alias("concept"))
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(int(r["concept"][1:]))
    assert sorted(found) == list(range(0, len(x), 100))
    hits = [len(found[q] & set(np.argsort(-(x @ x[q]), kind="stable")[:10].tolist())) for q in found]
    assert np.mean(hits) >= 8.8
