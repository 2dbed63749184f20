"""Tiers of all pairs of a file, joined without grouping the pairs."""

import contextlib
import io
import random

import __spark_entry__ as entry
from vecloom.operators import reports as P


def test_tiers_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(P, "SPANS", 7, raising=False)
    monkeypatch.setattr(P, "PAIRS", 100, raising=False)
    rnd = random.Random(6)
    s = [(rnd.choice("abc") if k % 9 else None, f"i{k if k % 4 else k % 8}", lo := rnd.randrange(50), lo + rnd.randrange(9)) for k in range(60)] + [("a", "i1000", None, None), ("a", None, 1, 2)]
    w = [(rnd.choice("abcd"), k if k % 3 else k % 6, at := rnd.randrange(50), at + 5) for k in range(30)]
    want = {}
    for path, c, lo, hi in s:
        for p, wid, a, b in w:
            if path == p:
                tier = 0 if lo is not None and lo <= b and hi >= a else 1
                want[wid, c] = min(tier, want.get((wid, c), 1))
    got = P.locus_tiers(spark.createDataFrame(s, "path string, concept string, lo long, hi long"), spark.createDataFrame(w, "path string, wid long, first long, last long")).collect()
    assert len(got) == len(want) and {(r["wid"], r["concept"]): r["tier"] for r in got} == want


def test_pairs_of_unique_names_are_not_grouped(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        entry.queries()["locus_tiers"](spark, sf_dir).explain()
    assert "ShuffledHashJoin" in said.getvalue().split("Union")[1].split("HashAggregate")[0]
