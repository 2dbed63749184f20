"""Many queries at once, baked contexts, and what summaries say would overturn them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions.vector_udf import unit
from vecloom.operators import bake as B


def rows(spark, x, name="r"):
    return spark.createDataFrame([(f"{name}{k:03}", None if v is None else [float(c) for c in v]) for k, v in enumerate(x)], "concept string, q array<double>")


@pytest.mark.parametrize("bound", [32 << 20, 400])
def test_many_queries_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(B, "QUERY_BYTES", bound)  # the second takes several passes
    monkeypatch.setattr(B, "BATCH", 37)
    r = np.random.default_rng(4)
    x = r.integers(-2, 3, (300, 5)).astype(float)  # with many ties
    asked = [*x[:20], [0.0] * 5, None, [1.0, 2.0]]
    odd = [*x, None, [], [1.0], [0.0] * 5, [float("nan")] * 5]
    q = spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(asked)], "query_id long, query array<double>")
    got = sorted(map(tuple, B.recall_many(rows(spark, odd).repartition(5), q, 7).collect()))
    s = np.floor(np.clip(unit(x) @ unit(x[:20]).T, -1, 1) * 1e6 + 0.5) / 1e6
    want = []
    for j in range(20):
        if not x[j].any():
            continue
        best = sorted((-s[i, j], f"r{i:03}") for i in range(300) if x[i].any())[:7]
        want += [(j, name, -v, k + 1) for k, (v, name) in enumerate(best)]
    assert got == sorted(want)
    assert B.recall_many(rows(spark, []), q, 7).count() == 0 and B.recall_many(rows(spark, x), q.limit(0), 7).count() == 0


def test_sections_of_a_context(spark):
    x = np.eye(4)
    r = rows(spark, x).withColumn("ts", F.substring("concept", 2, 3).cast("long"))
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0, 0.0]), (2, [0.0, 0.2, 0.0, 1.0])], "query_id long, query array<double>")
    got = [tuple(r) for r in B.context_bake(r, q, ["r002", "gone", "r000"], 2).orderBy("section", "position").select("section", "position", "concept").collect()]
    assert got == [("fixed", 1, "r002"), ("fixed", 3, "r000"), ("recent", 1, "r003"), ("recent", 2, "r002"), ("top", 1, "r000"), ("top", 2, "r003")]


CASES = [
    ("### Falsifiers\n- one falls\n\n* `two` breaks\n• dotted one\n3. numbered\nprose\n## Other\n- no", ["one falls", "two` breaks", "• dotted one", "3. numbered"]),
    ('x {"falsifiers": ["a b", "c]d", "e \\"q\\" f", "xy"], "more": ["no no"]}', ["a b", "c]d", 'e "q" f']),
    ('"falsifiers": ["never closed', []),
    ('"falsifiers": null', []),
    ("falsifier: `drops below 0.7`; second; ;ab", ["drops below 0.7`", "second"]),
    ("- FALSIFIERS: {json}", []),
    ("ship: falsifier parse works\nnext_vector: confirm falsifiers are bodies", []),
    ("We would reverse this if it fails\n- would_falsify: growth\n# what would reverse it\n- in section", ["We would reverse this if it fails", "would_falsify: growth", "in section"]),
    ("### falsifiers:\n- falsifiers\n- ...\n- {x}\n- [y]\n- same\n- same", ["same"]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_falsifiers(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.falsifiers(F.col("t")).alias("f")).first()["f"] == want


def test_justifications(spark):
    why = lambda t: spark.createDataFrame([(t,)], "t string").select(T.justification(F.col("t")).alias("f")).first()["f"]
    assert why("**decision_point:** a\n**justification:** because\nof it") == "** because of it"
    assert why("Decision: go now") == "go now"
    assert why("justification: x\ndecision: real reason") == "x decision: real reason"
    assert why("\n**head**\ngoal: g\n  first line \nsecond") == "first line"
    long = why("justification: " + "w" * 200)
    assert len(long) == 98 and long.endswith("…")
    assert why("**only**") == "**only**" and why(None) is None


def test_a_task_holds_a_bounded_part_of_the_scores(monkeypatch, spark):
    import tracemalloc

    r = np.random.default_rng(3)
    asked = spark.createDataFrame([(k, r.normal(size=4).tolist()) for k in range(3000)], "query_id long, query array<double>")
    caught = {}
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, run, schema: caught.setdefault("run", run) and asked.selectExpr("query_id", "'' AS concept", "0.0 AS score"))
    B.recall_many(rows(spark, r.normal(size=(3, 4))), asked, 5)
    x = r.normal(size=(2048, 4))
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{k:04}" for k in range(2048)]), pa.array(x.tolist(), pa.list_(pa.float64()))], ["concept", "q"])
    tracemalloc.start()
    got = sum(b.num_rows for b in caught["run"](iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 3000 * 5 and peak < 32 << 20  # all scores of a batch alone take 49 MB
