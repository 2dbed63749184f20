"""Encoders, table functions in SQL, folder streams, sinks, and report rules on fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import encode as E
from vecloom.operators import mutate as M
from vecloom.operators import reports as R
from vecloom.sources import chunks, packs
from vecloom.streaming import feed

TEXTS = [(0, "the apple fell far from the tree"), (1, "noise about weather and traffic"), (2, "salmon swim upstream to spawn in autumn"), (3, None), (4, "The Apple fell far from the tree")]


def as_complex(v):
    a = np.array(v, float).reshape(-1, 2)
    return a[:, 0] + 1j * a[:, 1]


def test_encoding_is_deterministic_and_ignores_case(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    v = {r["id"]: as_complex(r["v"]) for r in df.select("id", E.encode_xof(256)("text").alias("v")).collect()}
    assert np.allclose(v[0], v[4]) and not np.allclose(v[0], v[1])
    assert np.allclose(v[3], 0) and all(abs(np.linalg.norm(v[k]) - 1) < 1e-5 for k in (0, 1, 2))
    assert (v[0] @ v[2].conj()).real < 0.3


def test_exact_and_paraphrased_texts_are_recalled(spark):
    df = spark.createDataFrame([*TEXTS[:3], (9, "salmon swim upstream")], "id long, text string")
    v = {r["id"]: as_complex(r["v"]) for r in df.select("id", E.encode_xof(1024)("text").alias("v")).collect()}
    best = max((0, 1, 2), key=lambda k: (v[9] @ v[k].conj()).real)
    assert best == 2
    lanes = {r["id"]: np.array(r["re"]) + 1j * np.array(r["im"]) for r in E.encode_lanes(df, "text", 64, "id").collect()}
    assert max((0, 1, 2), key=lambda k: (lanes[9] @ lanes[k].conj()).real) == 2


def test_unit_phase_vectors_unbind_exactly(spark):
    df = spark.createDataFrame([("role", "filler")], "a string, b string").select(E.unit_phase(512)("a").alias("a"), E.unit_phase(512)("b").alias("b"))
    r = df.first()
    a, b = as_complex(r["a"]), as_complex(r["b"])
    bound = a * b / np.linalg.norm(a * b)
    back = bound * a.conj()
    assert abs(back @ b.conj()) / np.linalg.norm(back) / np.linalg.norm(b) > 0.95


def test_table_functions_in_sql(spark):
    chunks.register(spark)
    got = spark.sql("SELECT part, chunk FROM chunk_text('n', 'aa bb cc', 4)").collect()
    assert [tuple(r) for r in got] == [(0, "aa "), (1, "bb "), (2, "cc")]
    got = spark.sql("SELECT kind, title, label FROM extract_items('py', '# note\ndef f():\n    pass')").collect()
    assert [tuple(r) for r in got] == [("function", "f", "f: note — def f():")]


def test_requests_dropped_into_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "req_1.json").write_text(json.dumps({"concept": "a", "body": "x"}) + "\n")
    (tmp_path / "in" / "other.txt").write_text("no")
    s = feed.watch_folder(spark, f"file://{tmp_path}/in", "concept string, body string", "req_*.json")
    assert [tuple(r) for r in feed.replay(s, "inbox").collect()] == [("a", "x")]


def test_batches_reach_a_sink_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"concept": "a"}\n{"concept": "b"}\n')
    seen = []
    q = feed.sink_batches(feed.watch_folder(spark, f"file://{tmp_path}/in", "concept string"), lambda df, n: seen.extend((n, r["concept"]) for r in df.collect()), "sink", "1 second")
    q.processAllAvailable()
    q.stop()
    assert sorted(c for _, c in seen) == ["a", "b"]


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"k": 1, "ts": "2024-01-01T00:00:00Z"}, {"k": 1, "ts": "2024-01-01T00:10:00Z"}, {"k": 2, "ts": "2024-01-01T00:20:00Z"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    s = feed.watch_folder(spark, f"file://{tmp_path}/in", "k int, ts timestamp")
    assert sorted(r["k"] for r in feed.replay(feed.deduplicated(s, ["k"]), "dedup").collect()) == [1, 2]


def test_branches_end_at_their_first_end(spark):
    rows = [("a", 1, "open"), ("a", 2, "merged"), ("a", 3, "open"), ("b", 1, "open"), ("c", 1, "abandoned"), ("c", 2, "merged")]
    got = {r["branch"]: r["state"] for r in feed.branch_states(spark.createDataFrame(rows, "branch string, ts int, action string")).collect()}
    assert got == {"a": "merged", "b": "open", "c": "abandoned"}


def test_quarantine_renames_and_caps(spark):
    items = spark.createDataFrame([("a", "x", 0.9, "k"), ("b", "y", 0.3, "k")], packs.SCHEMA)
    got = sorted(tuple(r)[:3] for r in packs.quarantined(items, spark.createDataFrame([("a",)], "concept string")).collect())
    assert got == [("b", "y", 0.3), ("sync:a", "x", 0.6)]


def test_unknown_wire_bytes_are_null(spark):
    df = spark.createDataFrame([(b"junk",), (None,)], "w binary").select(packs.wire_decode()("w").alias("x"))
    assert all(r["x"]["concept"] is None for r in df.collect())


@pytest.mark.parametrize("hits, most, want", [([("a", 5), ("b", 9)], 2, ["b", "a"]), ([("a", 5)], 1, ["a"])])
def test_prioritised_sources(spark, hits, most, want):
    first = spark.createDataFrame(hits, "concept string, ts long")
    second = spark.createDataFrame([("z", 100), ("a", 100)], "concept string, ts long")
    assert [r["concept"] for r in R.prioritised([first, second], most).collect()] == want


def test_payload_issues_and_needles(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ("nope",), ('{"k": ""}',)], "b string")
    assert [r["i"] for r in rows.select(R.payload_issues(F.col("b"), ["k"]).alias("i")).collect()] == [[], ["not_json"], ["missing_k"]]
    with pytest.raises(ValueError):
        R.containing(rows, "short", 3)


def test_blending_updates_and_inserts(spark):
    old = spark.createDataFrame([("a", [1.0, 0.0], 0.5, 3)], "concept string, q array<double>, drift double, mass int")
    new = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0])], "concept string, q array<double>")
    got = {r["concept"]: r for r in M.blended(old, new).collect()}
    assert np.allclose(got["a"]["q"], np.array([0.8, 0.2]) / np.hypot(0.8, 0.2)) and got["a"]["drift"] == 1.0 and got["a"]["mass"] == 4
    assert got["b"]["q"] == [0.0, 1.0] and got["b"]["mass"] == 1
