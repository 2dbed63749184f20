"""Links found in pairs of blocks: written once, not shuffled, and no match less sure than in tables."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_others import large_pictures_and_crops
from vecloom.llm import media


@pytest.fixture(scope="module")
def known(spark):
    rows, _ = large_pictures_and_crops(3)
    df = spark.createDataFrame([(i, media.write_picture(p)) for i, p in rows], "id long, image binary")
    out = media.described(df).select(F.col("id").alias("pic"), "feats").cache()
    out.count()
    yield out
    out.unpersist()


def found(df):
    return {(r["a"], r["b"]): r["n"] for r in df.collect()}


def test_features_are_not_sent_for_each_table(known):
    plan = media.links(known)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_and_tables_find_the_same_links(known, monkeypatch):
    monkeypatch.setattr(media, "MORE", 0)  # the same keys in both
    one = found(media.links(known))
    monkeypatch.setattr(media, "SPREAD", 7)
    monkeypatch.setattr(media, "FEW", 1)
    assert found(media.links(known)) == one and len(one) > 50
    monkeypatch.setattr(media, "MOST", 20)  # blocks with many matches are halved
    assert found(media.links(known)) == one
    monkeypatch.setattr(media, "BLOCK", 1)  # more blocks than tables
    for heavy in (media.HEAVY, 40):  # cutting frequent keys changes nothing
        tables = media.links(known, heavy=heavy)
        assert "CartesianProduct" not in tables._jdf.queryExecution().executedPlan().toString()
        assert found(tables) == one


def test_matches_of_blocks_are_those_that_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (200, 32), np.uint8)
    flips = np.zeros((400, 256), np.uint8)
    for k in range(400):
        flips[k, rng.choice(256, k % 60, replace=False)] = 1
    words = (np.concatenate((a, a)) ^ np.packbits(flips, axis=1)).view(np.uint64)
    pic, bits, tables = np.arange(400) // 2, 9, 12
    keys = media.keys_of(words, bits)[:tables]
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2, dtype=int) <= media.RADIUS
    near &= (keys[:, :, None] == keys[:, None, :]).any(axis=0) & (pic[:, None] != pic[None])
    for left in (0, 150):
        code = media.matches_of(pic, words, left, bits, len(keys))
        want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near))) if i < j and (not left or i < left <= j)}
        assert {(c // 400, c % 400) for c in code.tolist()} == want and want
        assert media.matches_of(pic, words, left, bits, len(keys), most=3) is None


def test_longer_keys_miss_no_match_more_often():
    chance = lambda bits, tables, d: 1 - (1 - comb(256 - d, bits) / comb(256, bits)) ** tables
    for bits in range(8, 41):
        longer, tables = media.longer_keys(bits)
        assert longer >= bits and tables <= 256
        assert all(chance(longer, tables, d) >= chance(bits, media.tables_for(bits), d) - 1e-9 for d in range(media.RADIUS + 1))
