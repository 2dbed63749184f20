"""Versioned tables: what readers see while writers come, go and die."""

import pytest

from vecloom.operators import bonds as B
from vecloom.sources import versions
from vecloom.sources.versions import Store

ROWS = "concept string, text string"


@pytest.fixture
def store(spark):
    return B.bonded_store(spark, 3, "test-bonds")


def names(df):
    return sorted(r[0] for r in df.collect())


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def bonds(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, label string, dst string")


def test_entries_stubs_and_bonds_appear_together(spark, store):
    with store.change() as c:
        B.upsert_with_bonds(c, entries(spark, ("tile:a", "x"), (" b ", "y"), ("", "no name"), ("c:no-text", "  "), (None, "z")), bonds(spark, ("tile:a", "serves", "goal:g"), ("", "l", "x:y"), ("tile:a", " ", "x:y"), ("tile:a", "l", None)))
        assert store.read("entries").count() == 0  # not yet visible
    got = {r["concept"]: (r["text"], r["stub"]) for r in store.read("entries").collect()}
    assert got == {"tile:a": ("x", False), "tensor:b": ("y", False), "goal:g": ("tensor stub entry for bond anchor: goal:g", True)}
    assert store.read("bonds").count() == 1
    with store.change() as c:  # an entry replaces its stub, a stub replaces nothing
        B.upsert_with_bonds(c, entries(spark, ("goal:g", "now told")), bonds(spark, ("goal:g", "of", "tile:a")))
    got = {r["concept"]: (r["text"], r["stub"]) for r in store.read("entries").collect()}
    assert got["goal:g"] == ("now told", False) and got["tile:a"] == ("x", False)


def test_a_writer_that_dies_between_two_tables_leaves_nothing(spark, store):
    with store.change() as c:
        B.upsert_with_bonds(c, entries(spark, ("t:a", "x")), bonds(spark))
    before = store.versions()
    with pytest.raises(RuntimeError, match="killed"), store.change() as c:
        c.upsert("entries", spark.createDataFrame([("t:b", "y", False)], B.ENTRIES))
        raise RuntimeError("killed")
    assert store.versions() == before and names(store.read("entries")) == ["t:a"]
    assert store.vacuum(keep=2) == 1  # its files
    assert names(store.read("entries")) == ["t:a"]


def test_a_torn_manifest_is_no_version(spark, store):
    out = store._fs.create(store._path("versions/000000000009.json"), False)
    out.write(bytearray(b'{"version": 9, "tab'))
    out.close()
    assert store.versions() == [1] and store.read("entries").count() == 0
    with store.change() as c:
        B.upsert_with_bonds(c, entries(spark, ("t:a", "x")), bonds(spark))
    assert store.versions() == [1, 10] and names(store.read("entries")) == ["t:a"]


def test_readers_hold_their_version_and_writers_conflict(spark, store):
    with store.change() as c:
        B.upsert_with_bonds(c, entries(spark, ("t:a", "x")), bonds(spark))
    held = store.read("entries")
    with pytest.raises(versions.Conflict), store.change() as slow:
        slow.upsert("entries", spark.createDataFrame([("t:c", "z", False)], B.ENTRIES))
        with store.change() as fast:
            B.upsert_with_bonds(fast, entries(spark, ("t:b", "y")), bonds(spark))
    assert names(held) == ["t:a"] and names(store.read("entries", 2)) == ["t:a"]
    assert names(store.read("entries")) == ["t:a", "t:b"]


def test_rows_with_one_key_deletes_and_null_keys(spark):
    s = Store.fresh(spark, "test-store")
    s.create(t=("k long, v string", ["k"], 2))
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    with s.change() as c:
        c.upsert("t", rows((1, "a"), (1, "b"), (2, "c"), (None, "n")))
    assert sorted(map(tuple, s.read("t").collect()), key=str) == [(1, "b"), (2, "c"), (None, "n")]
    with s.change() as c:
        assert c.upsert("t", rows((1, "b"), (None, "n"))) == 0
    assert s.versions() == [1, 2]
    with s.change() as c:
        c.delete("t", rows((1, ""), (7, "")).select("k"))
    assert sorted(map(tuple, s.read("t").collect()), key=str) == [(2, "c"), (None, "n")]
    with s.change() as c:
        c.delete("t", rows((2, "")).select("k"))
        c.mark("done", "yes")
    assert s.marks() == {"done": "yes"} and s.read("t").count() == 1


def test_backfill_rewrites_only_what_changes(spark):
    from pyspark.sql import functions as F

    s = Store.fresh(spark, "test-vectors")
    s.create(vectors=(B.VECTORS, ["concept"], 16))
    rows = [(f"r{k}", "text" if k % 2 else "", None if k == 1 else [1.0, float(k)]) for k in range(60)]
    rows += [("empty", None, None), ("zero", "some", [0.0, 1.0]), ("fails", "bad", None)]
    with s.change() as c:
        c.upsert("vectors", spark.createDataFrame(rows, B.VECTORS))
    before, n = s.files("vectors"), len(s.versions())
    embed = lambda t: F.when(t != "bad", F.array(F.length(t).cast("double"), F.lit(0.5)))
    done = B.backfill(s, embed)
    after = s.files("vectors")
    changed = {p for p in after if after[p] != before[p]}
    assert 1 <= len(changed) <= 2 and done == {"parts": len(changed)}  # two rows were due
    got = {r["concept"]: r["vector"] for r in s.read("vectors").collect()}
    assert got["r1"] == [4.0, 0.5] and got["zero"] == [4.0, 0.5] and got["fails"] is None and got["empty"] is None and got["r3"] == [1.0, 3.0]
    assert len(s.versions()) == n + 1
    assert B.backfill(s, embed) == {"parts": 0} and s.files("vectors") == after and len(s.versions()) == n + 1
    assert B.backfill(s, embed, force=True)["parts"] > 2
