"""Small literal fixtures for operators whose rules SQL on the test tables does not pin down."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import scores as S
from vecloom.functions import text as T
from vecloom.functions import vector as V
from vecloom.functions import vector_udf as U
from vecloom.operators import aggregate as A
from vecloom.operators import consolidate as C
from vecloom.operators import integrity as I
from vecloom.operators import mutate as M
from vecloom.operators import recall as R
from vecloom.operators import relations as G
from vecloom.operators import structured as Q
from vecloom.plans.catalog import QUERIES
from vecloom.sources import chunks as K
from vecloom.sources import packs as P
from vecloom.streaming import feed


def one(spark, expr, **cols):
    row = {k: v for k, v in cols.items()} or {"x": 1}
    return spark.createDataFrame([row]).select(expr.alias("r")).first()["r"]


# ---- vectors --------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31))
def test_numpy_kernels_keep_unit_length(seed):
    r = np.random.default_rng(seed)
    a, b = U.unit(r.normal(size=(5, 16))), U.unit(r.normal(size=(5, 16)))
    g = U.gram_schmidt_rows(a, b)
    assert np.allclose((g * b).sum(axis=1), 0, atol=1e-9) and np.allclose(np.linalg.norm(g, axis=1), 1)
    assert np.allclose(np.linalg.norm(U.rk4_rows(a, b, steps=4), axis=1), 1)
    assert ((U.rk4_rows(a, b, steps=4) * b).sum(axis=1) >= (a * b).sum(axis=1) - 1e-9).all()
    assert ((U.reconcile_rows(a, b, 12) * b).sum(axis=1) >= (a * b).sum(axis=1) - 1e-9).all()
    assert np.allclose(np.linalg.norm(U.srht_rows(a), axis=1), np.linalg.norm(a, axis=1))


def test_unbind_recovers_what_was_bound(spark):
    r = np.random.default_rng(3)
    z = np.exp(1j * r.uniform(0, 2 * np.pi, (2, 64)))
    df = spark.createDataFrame([(z[0].real.tolist(), z[0].imag.tolist(), z[1].real.tolist(), z[1].imag.tolist())], "ar array<double>, ai array<double>, br array<double>, bi array<double>")
    a, b = V.Z(F.col("ar"), F.col("ai")), V.Z(F.col("br"), F.col("bi"))
    back = V.unbind(V.bind(a, b), b)
    got = df.select(V.zcosine(back, a).alias("same"), V.hermitian(V.bind(a, b), a).alias("other"), V.zcosine(V.superpose(a, b), a).alias("near")).first()
    assert got["same"] > 0.999 and got["other"] < 0.5 and got["near"] > 0.5


def test_zero_vectors_have_no_direction(spark):
    assert one(spark, V.normalise(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


@pytest.mark.parametrize("better, worse", [({"rel": 0.9}, {"rel": 0.5}), ({"drift": 0.0}, {"drift": 0.6}), ({"mass": 9}, {"mass": 1}), ({"c": 0.9}, {"c": 0.1})])
def test_each_factor_raises_the_score(spark, better, worse):
    def score(d):
        v = {"c": 0.5, "rel": 0.7, "drift": 0.3, "mass": 4} | d
        rel, drift = F.lit(v["rel"]), F.lit(v["drift"])
        return one(spark, S.ranked_score(F.lit(v["c"]), rel, drift, F.lit(v["mass"]), S.precision_weight(rel, 1 - drift)))

    assert score(better) > score(worse)


def test_two_phase_recall_finds_the_exact_top(spark):
    r = np.random.default_rng(1)
    v = U.unit(r.normal(size=(400, 32)))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(400), "concept": [f"c{i}" for i in range(400)], "q": v.tolist()}))
    q = R.query_vector(df, 7)
    exact = {x["concept"] for x in R.recall(df, q, 10).collect()}
    assert len(exact & {x["concept"] for x in R.two_phase(df, q, 10).collect()}) >= 9
    assert len(exact & {x["concept"] for x in R.srht(df, q, 10, 32).collect()}) >= 9


def test_fixed_prefixes_and_notices(spark):
    d = lambda c: one(spark, S.goal_distance(F.lit(c)))
    assert [d(c) for c in ("primary_goal", "goal:x", "trace:x", "tile:x", "scar:x", "metric:x", "local:x", "note")] == [0, 0, 1, 2, 2, 5, 6, 3]
    assert one(spark, T.splice_mode(F.lit("scar:x"), F.lit("pub fn a() {}"))) == "append"
    long = one(spark, T.spliced(F.lit(""), F.lit("é" * 96_001), F.lit("append"), F.lit(1)))
    assert long.startswith("[provlog truncated — 65 chars removed from head]\n\né") and long.count("é") == 95_936


# ---- structured -----------------------------------------------------------------------------


def test_structured_fixture(spark):
    rows = spark.createDataFrame([("goal:ship", 0.86, 41, None), ("goal:plan", 0.62, 93, None), ("trace:k7", 0.55, 170, "walk.py"), ("metric:beat", 0.31, 12, None)], "concept string, reliability double, recency long, path string")
    edges = spark.createDataFrame([("goal:ship", "decomposes_into", "goal:plan", None)], "src string, label string, dst string, volatility double")
    names = lambda q: [r["concept"] for r in Q.run(rows, q, edges).collect()]
    assert names(Q.Query(prefix="goal:", least=0.8)) == ["goal:ship"]
    assert names(Q.Query(related_to="goal:ship")) == ["goal:ship", "goal:plan"]
    assert names(Q.Query(related_to="goal:plan", direction="in", label="decomposes_into")) == ["goal:ship", "goal:plan"]
    assert len(names(Q.Query(limit=2))) == 2
    assert names(Q.Query(stem="walk")) == ["trace:k7"]
    assert names(Q.Query(order="recency", limit=1)) == ["trace:k7"]
    assert Q.Query.of({"limit": 999, "order": "odd"}) == Q.Query(limit=200)


def test_globs_are_literal_but_for_stars(spark):
    for pattern, text, hit in [("a.c", "abc", False), ("a*c", "a.b.c", True), ("*x", "x", True), ("a*b*c", "a-c-b", False), ("(a)*", "(a)b", True)]:
        assert one(spark, Q.glob(F.lit(text), pattern)) is hit


# ---- relations ------------------------------------------------------------------------------

LINE = "src string, label string, dst string, volatility double"


def test_expansion_gives_least_costs(spark):
    e = spark.createDataFrame([("a", "x", "b", 1.0), ("a", "x", "c", 0.1), ("c", "x", "b", 0.1), ("b", "x", "a", 0.1), ("b", "y", "d", 0.0)], LINE)
    seeds = spark.createDataFrame([("a",)], "concept string")
    got = {r["concept"]: round(r["cost"], 6) for r in G.expand(e, seeds, 2.5, direction="out").collect()}
    assert got == {"a": 0.0, "b": 2.0, "c": 1.1}  # d would cost 3
    assert {r["concept"] for r in G.expand(e, seeds, 2.5, "x", "out").collect()} == {"a", "b", "c"}
    assert {r["concept"] for r in G.expand(e, seeds, 0.5, direction="out").collect()} == {"a"}


def test_walks_survive_cycles_and_stop(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 60)] + [(100, 101), (101, 100)], "concept long, previous long")
    heads = spark.createDataFrame([(59,), (100,), (7,)], "concept long")
    got = G.walk(links, heads, 48).collect()
    line = {r["at"]: r["depth"] for r in got if r["head"] == 59}
    assert line == {59 - d: d for d in range(48)}
    assert {r["at"] for r in got if r["head"] == 100} == {100, 101}
    assert len([r for r in got if r["head"] == 7]) == 8


def test_subgraphs_have_no_dangling_edges(spark):
    e = spark.createDataFrame([("hub", "l", f"n{i}", 0.1) for i in range(50)] + [("n1", "l", "n2", 0.1)], LINE)
    entries = spark.createDataFrame([("hub", 0)] + [(f"n{i}", i + 1) for i in range(50)], "concept string, rank int")
    got = G.bounded_subgraph(e, entries).collect()
    names = {"hub"} | {f"n{i}" for i in range(11)}
    assert len(got) <= 32 and all(r["src"] in names and r["dst"] in names for r in got) and len(got) == 12


def test_topology_of_nothing(spark):
    e = spark.createDataFrame([], LINE)
    n = spark.createDataFrame([("a", True)], "concept string, flagged boolean")
    r = G.topology(n, e).first()
    assert (r["nodes"], r["edges"], r["orphans"], r["suggestions"]) == (1, 0, 1, "relate_orphans,review_flagged")


def test_relating_replaces_an_edge(spark):
    e = spark.createDataFrame([("a", "l", "b", 0.1)], LINE)
    new = spark.createDataFrame([("a", "l", "b", 0.9), ("b", "l", "c", 0.2)], LINE)
    assert sorted((r["src"], r["volatility"]) for r in G.relate(e, new).collect()) == [("a", 0.9), ("b", 0.2)]


# ---- text -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "concept, text, mode",
    [("helper:session_handoff_latest", "x", "replace"), ("manifest:rehydration_9", "{}", "replace"), ("helper:other", "x", "append"), ("f__fn__g", "fn g() {}", "replace"), ("f__fn__g", "prose", "append"), ("f__fn__g__arc", "fn g() {}", "append"), ("plain", "fn g()", "append")],
)
def test_splice_modes(spark, concept, text, mode):
    assert one(spark, T.splice_mode(F.lit(concept), F.lit(text))) == mode


def test_bodies_are_capped_at_their_tail(spark):
    got = one(spark, T.capped(F.lit("a" * 100 + "b" * 100), 150))
    assert got.startswith("[provlog truncated — 114 chars removed from head]\n\n") and got.endswith("b" * 86) and "a" not in got.split("\n\n")[1]
    assert one(spark, T.segments(F.lit("one\n\n--- update @ 5 ---\ntwo\n\n--- update @ 6 ---\nthree"), 2)) == ["two", "three"]


def test_splicing_keeps_the_longest_documents(spark, tmp_path):
    texts = {1: "r" * 95_000, 2: "s" * 10 + "t" * 95_990, 3: "u" * 90_000, 5: "v" * 100 + "w" * 96_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["body"] for r in QUERIES["splice_append"](spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        body = text if i % 4 == 1 else f"old body\n\n--- update @ {i} ---\n{text}"
        if len(body) > 96_000:
            gone = len(body) - (96_000 - 64)
            body = f"[provlog truncated — {gone} chars removed from head]\n\n{body[gone:]}"
        assert got[i] == hashlib.sha256(body.encode()).hexdigest()
    assert len(got) == 4


def test_scrubbing_names_what_it_found(spark):
    s = T.scrub(F.lit("a@b.org 123-45-6789 /home/me/x ~/y rtsp://cam/1 token: abc"))
    assert one(spark, s["text"]) == "[REDACTED_EMAIL] [REDACTED_SSN] [REDACTED_PATH]/x [REDACTED_PATH] [REDACTED_STREAM] [REDACTED_SECRET]"
    assert one(spark, s["found"]) == ["ssn", "email", "home_path", "tilde_path", "rtsp", "api_secret"]


def test_fields_footers_and_json(spark):
    body = "**a:** one two\nrest {\"k\": [1, {\"z\": 2}]} tail\n**recorded_at:** 7"
    assert one(spark, T.field(F.lit(body), "a")) == "one two" and one(spark, T.field(F.lit(body), "b")) == ""
    assert one(spark, T.without_footer(F.lit(body))).endswith("tail")
    assert one(spark, T.first_json(F.lit(body))) == '{"k": [1, {"z": 2}]}'
    assert one(spark, T.first_json(F.lit("{no"))) is None


# ---- chunks ---------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=60), st.integers(1, 12))
def test_chunks_join_to_the_text(text, most):
    parts = list(K.chunk_spans(text, most))
    assert "".join(parts) == text and all(0 < len(p) <= most for p in parts)


def test_extracted_items():
    md = list(K.markdown_items("---\nt: 1\n---\n# A\nx\n## B\n```py\n# no\n```\n# C"))
    assert [(r.kind, r.title, r.start, r.stop) for r in md] == [("frontmatter", "", 1, 3), ("code", "py", 7, 9), ("section", "A", 4, 9), ("section", "B", 6, 9), ("section", "C", 10, 10)]
    assert [(r.kind, r.title) for r in K.toml_items("a=1\n[x.y]\nb=2\n[[z]]\nc=3")] == [("table", "x.y"), ("table_array", "z")]
    assert [(r.kind, r.title) for r in K.python_items("class A:\n    def f(self):\n        pass")] == [("class", "A"), ("function", "f")]
    rust = "/// Doc\npub fn f(x: u8) -> u8 {\n    x\n}\nstruct S;\nimpl S {\n    fn g() {}\n}"
    assert [(r.kind, r.title, r.start, r.stop) for r in K.code_items(rust, "rs")] == [("fn", "f", 2, 4), ("struct", "S", 5, 5), ("impl", "S", 6, 8), ("fn", "g", 7, 7)]
    assert K.leading_comment(rust.split("\n"), 2) == "Doc"
    assert list(K.python_items("def (")) == []


# ---- integrity, folds -----------------------------------------------------------------------


def test_seals_and_chains(spark):
    d = I.digest(F.lit("x"), F.lit(None).cast("string"))
    for seal, magic, want in [(d, True, "valid"), (F.lit(""), True, "legacy_unsealed"), (F.lit("0"), True, "mismatch"), (d, False, "structural")]:
        assert one(spark, I.status(seal, d, F.lit(magic))) == want
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, I.depth(I.advance(a("b", "a", ""), F.lit("c")))) == 3
    assert one(spark, I.plausible(a("a", "", ""))) and not one(spark, I.plausible(a("a", "", "b")))
    assert one(spark, I.allowed(F.lit("1|bind|add"), "add")) and not one(spark, I.allowed(F.lit("1|bind"), "add")) and one(spark, I.allowed(F.lit("0|x"), "add"))
    assert one(spark, I.window_around(F.lit("0123456789needle0123456789"), F.lit("NEEDLE"), 8)) == "89needle"


def test_confirmation_comes_with_a_lead_of_one(spark):
    e = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([True, True, False, True, True, True])] + [(2, 0, False)], "k int, ts int, ok boolean")
    got = {r["k"]: r for r in M.hypothesis(e, "k", ["ts"], F.col("ok")).collect()}
    assert got[1]["confirmed"] and got[1]["support"] == 1.25 and got[1]["denial"] == 0.25
    assert not got[2]["confirmed"] and got[2]["streak"] == 1


def test_packing_goes_on_after_a_misfit(spark):
    s = spark.createDataFrame([("r", 1, "a", 5), ("r", 2, "b", 9), ("r", 3, "c", 4)], "g string, priority int, name string, cost int")
    assert A.packed_slots(s, "g", 10).first()["kept"] == ["a", "c"]


def test_consolidation_moves_towards_reliable_records(spark):
    r = np.random.default_rng(2)
    v = U.unit(np.abs(r.normal(size=(60, 8))))
    df = spark.createDataFrame(pd.DataFrame({"concept": [f"goal:{i}" for i in range(59)] + ["_hidden"], "reliability": [0.9] * 30 + [0.5] * 29 + [0.99], "q": v.tolist()}))
    prev = spark.createDataFrame([(v[0].tolist(),)], "centroid array<double>")
    got = C.consolidate(df, prev).first()
    assert got["n"] == 30 and abs(np.linalg.norm(got["v"]) - 1) < 1e-9 and np.dot(got["v"], v[:30].sum(axis=0)) > 0


# ---- packs and streams ----------------------------------------------------------------------


def test_packs_detect_a_changed_item(spark, tmp_path):
    rows = spark.createDataFrame([("a", "body", 0.9, "x"), ("b", "ü", None, None)], P.SCHEMA)
    P.write_pack(rows, f"file://{tmp_path}")
    got = {r["concept"]: (r["reliability"], r["kind"]) for r in P.read_pack(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": (0.9, "x"), "b": (0.5, "record")}
    P.check_manifest(spark, f"file://{tmp_path}")
    (tmp_path / "items" / "more.json").write_text('{"concept": "c", "body": "z"}\n')
    with pytest.raises(ValueError):
        P.check_manifest(spark, f"file://{tmp_path}")


def test_ingest_takes_known_files_only(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("x = 1")
    (tmp_path / "b.bin").write_bytes(b"\0")
    (tmp_path / "target.md").write_text("# t")
    got = [r["body"] for r in P.ingest(spark, f"file://{tmp_path}", ["target"]).collect()]
    assert got == ["x = 1"]


def test_streamed_leases_are_those_of_a_plain_loop(spark, sf_dir):
    from vecloom.plans import catalog

    got = {r["order"]: r["granted"] for r in catalog.QUERIES["stream_lease_ttl"](spark, sf_dir).collect()}
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "unix_micros(cast(ts as timestamp)) as ts", "event_id", "user_id").collect()
    for kind in {r["event_type"] for r in e}:
        rows = sorted((r["ts"], r["event_id"], r["user_id"]) for r in e if r["event_type"] == kind)
        assert [got[r[1]] for r in rows] == feed.lease_fold(rows, 3_600_000_000)


def test_closed_sessions_are_those_of_the_batch(spark, sf_dir):
    from vecloom.plans import catalog

    whole = {tuple(r) for r in catalog.QUERIES["turn_window"](spark, sf_dir).collect()}
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.selectExpr("max(ts) as t").first()["t"]
    closed = {tuple(r) for r in catalog.QUERIES["stream_session_turns"](spark, sf_dir).collect()}
    assert closed <= whole
    assert all((last - r[2]).total_seconds() < 5400 + 1 for r in whole - closed)


def test_chunk_query_keeps_every_character(spark, sf_dir):
    from vecloom.plans import catalog

    got = {r["doc_id"]: r["n"] for r in catalog.QUERIES["chunk_text"](spark, sf_dir).groupBy("doc_id").agg(F.sum("n_chars").alias("n")).collect()}
    want = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "length(text) as n").collect()}
    assert got == want


# ---- groups that may hold most of the rows ---------------------------------------------------


def test_neighbours_and_ranks_within_groups(spark):
    rows = [("hot", k, f"n{k}") for k in range(50)] + [("a", 1, "x"), (None, 5, "y"), (None, 6, "z")]
    df = spark.createDataFrame(rows, "g string, t long, name string").repartition(7)
    got = {(r["g"], r["t"]): (r["after"], r["rank"]) for r in A.ranks_within(A.beside(df, "g", [F.asc("t")], 1, after="name"), "g", [F.desc("t")], "rank").collect()}
    assert len(got) == 53 and got["hot", 48] == ("n49", 2) and got["hot", 49] == (None, 1) and got["hot", 0] == ("n1", 50)
    assert got["a", 1] == (None, 1) and got[None, 5] == ("z", 2) and got[None, 6] == (None, 1)


def test_slots_are_packed_by_priority(spark):
    rows = [("a", 1, "x", 30), ("a", 2, "big", 20), ("a", 3, "y", 10), ("a", 3, "yy", 1), ("b", 1, "z", 99), (None, 1, "n", 5), ("a", 0, "none", None)]
    df = spark.createDataFrame(rows, "g string, priority int, name string, cost int").repartition(5)
    got = {r["g"]: (r["used"], r["kept"]) for r in A.packed_slots(df, "g", 40).collect()}
    assert got == {"a": (40, ["x", "y"]), "b": (0, []), None: (5, ["n"])}
    assert A.packed_slots(df.limit(0), "g", 40).count() == 0


def test_best_overlap_by_index_and_by_join(spark, monkeypatch):
    from vecloom.operators import overlap

    many = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "d"]), (3, []), (4, None), (5, ["q"]), (1, ["a", "b"])], "doc_id long, a array<string>")
    few = spark.createDataFrame([(1, ["a", "b", "e"]), (2, ["d", "c"]), (3, []), (4, None)], "item_id long, b array<string>")
    want = [(1, 2 / 3), (1, 2 / 3), (2, 2 / 3), (3, 0.0), (4, 0.0), (5, 0.0)]
    for held in (overlap.HELD, 0):
        monkeypatch.setattr(overlap, "HELD", held)
        got = sorted(map(tuple, overlap.best_overlap(many, few).collect()))
        assert [i for i, _ in got] == [i for i, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])
    assert {r["overlap"] for r in overlap.best_overlap(many, few.limit(0)).collect()} == {0.0}


def test_signs_come_from_the_congruence():
    x, out = 7, []
    for _ in range(8):
        x = (x * 6364136223846793005 + 1) % 2**64
        out.append(-1.0 if x >> 63 else 1.0)
    assert U.signs(8, 7).tolist() == out
    v = np.arange(8.0)[None]
    y = U.srht_rows(v, 7)
    assert np.isclose(np.linalg.norm(y), np.linalg.norm(v)) and np.isclose(y[0, 0] * np.sqrt(8), (v[0] * out).sum())


# ---- clocks and places -----------------------------------------------------------------------


def test_turns_and_minutes_since_a_handoff(spark):
    from datetime import UTC, datetime

    from vecloom.operators import continuity as N

    at = lambda m: datetime.fromtimestamp(1_700_000_000 + 60 * m, UTC)
    rows = [("a", 0, at(0), False), ("a", 1, at(300), False), ("a", 2, at(301), True), ("a", 3, at(302), False), ("a", 4, at(421), False), ("b", 0, at(5), True)]
    got = N.sentinel_clock(spark.createDataFrame(rows, "g string, i int, ts timestamp, h boolean"), "g", ["i"], "ts", F.col("h")).orderBy("g", "i").collect()
    assert [(r["turns"], r["minutes"], r["due"]) for r in got] == [(1, 0, False), (2, 0, False), (0, 0, False), (1, 1, False), (2, 120, True), (0, 0, False)]


def test_places_of_concepts(spark):
    from vecloom.operators import continuity as N

    def plain(c, frame):
        h = frame * 0x9E3779B97F4A7C15 % 2**64
        for b in c.encode():
            h = (h * 0x0100000001B3 + b) % 2**64
        return np.sin(h % 628 / 100 - np.pi / 2) * 0.88, (h >> 16) % 628 / 100 * 2 * np.pi - np.pi

    for c, frame in (("goal:x", 0), ("", 7), ("zażółć 🙂", 12345678901), ("w" * 300, 2)):
        assert tuple(one(spark, N.place(F.lit(c), frame))) == pytest.approx(plain(c, frame), abs=1e-6)
    assert one(spark, N.place(F.lit(None).cast("string"))) is None
