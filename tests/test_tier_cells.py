"""Cells of a file's pairs: parts of any size, files with one side only, and results that take little space."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from vecloom.operators import reports as P


def _frames(spark, s, w):
    return spark.createDataFrame(s, "path string, concept string, lo long, hi long"), spark.createDataFrame(w, "path string, wid long, first long, last long")


def test_small_cells_against_a_loop(spark, monkeypatch):
    for name, x in (("SPANS", 5), ("WINDOWS", 6), ("BLOCK", 5), ("ROWS", 8), ("PAIRS", 50), ("CYCLE", 2)):
        monkeypatch.setattr(P, name, x, raising=False)
    rnd = random.Random(8)
    # a and b are cut on both sides, c has windows and d spans only, e is small; i0 and 0 come again, also as equal rows
    s = [(p, f"i{0 if k % 11 == 0 else k}{p * (k % 11 > 0)}", lo := rnd.randrange(60), lo + rnd.randrange(9)) for p, n in (("a", 33), ("b", 12), ("d", 40), ("e", 2)) for k in range(n)] + [("a", "i0", 3, 4)] * 9
    w = [(p, 0 if k % 7 == 0 else at * 100 + k, first := rnd.randrange(60), first + 5) for at, (p, n) in enumerate((("a", 25), ("b", 9), ("c", 30), ("e", 1))) for k in range(n)] + [("b", 0, 1, 2)] * 8 + [(None, 7, 1, 2)]
    want = {}
    for path, c, lo, hi in s:
        for p, wid, a, b in w:
            if path == p:
                want[wid, c] = min(0 if lo <= b and hi >= a else 1, want.get((wid, c), 1))
    got = P.locus_tiers(*_frames(spark, s, w)).collect()
    assert len(got) == len(want) and {(r["wid"], r["concept"]): r["tier"] for r in got} == want


def test_files_of_the_result_take_little_space(spark, tmp_path):
    spans = spark.range(1000).select(F.lit("f").alias("path"), F.concat(F.lit("item:"), "id").alias("concept"), (F.col("id") % 300).alias("lo"), (F.col("id") % 300 + F.col("id") * 31 % 50).alias("hi"))
    windows = spark.range(5000).select(F.lit("f").alias("path"), (F.col("id") * 7919).alias("wid"), (F.col("id") * 7 % 300).alias("first"), (F.col("id") * 7 % 300 + 10).alias("last"))
    P.locus_tiers(spans, windows).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5_000_000
    assert sum(f.stat().st_size for f in Path(tmp_path, "out").glob("*.parquet")) < 0.7 * 5_000_000
