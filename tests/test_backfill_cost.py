"""A backfill changes rows where they are: texts are neither joined nor grouped, and a first load writes them once."""

from pyspark.sql import functions as F

from vecloom.operators import bonds as B
from vecloom.sources import versions
from vecloom.sources.versions import Change, Store


def test_texts_are_not_cut_joined_or_grouped(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(versions, "cut", lambda df, *a, own=versions.cut, **k: cuts.append(df) or own(df, *a, **k))
    written = []
    monkeypatch.setattr(Change, "_put", lambda self, table, out, parts, own=Change._put: written.append(out) or own(self, table, out, parts))
    s = Store.fresh(spark, "test-backfill")
    s.create(vectors=(B.VECTORS, ["concept"], 4))
    rows = [(f"r{k}", "some text" if k % 3 else None, [1.0, 0.0] if k % 2 else None) for k in range(90)] + [(None, "no name", None), ("r1", "some text", [0.5])]
    with s.change() as c:
        c.upsert("vectors", spark.createDataFrame(rows, B.VECTORS))
    embed = lambda t: F.array(F.length(t).cast("int"))
    assert B.backfill(s, embed)["parts"] and B.backfill(s, embed) == {"parts": 0}
    assert not cuts and len(written) == 1
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = {c: v or ([float(len(t))] if t else None) for c, t, v in rows[:-1]}
    assert {r["concept"]: r["vector"] for r in s.read("vectors").collect()} == want and len(s.versions()) == 3
