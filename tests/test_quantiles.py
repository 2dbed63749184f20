"""Exact quantiles without a group in one task."""

import contextlib
import io

import numpy as np
import pytest

import __spark_entry__ as entry
from vecloom.operators import aggregate as A


def test_quantiles_of_skewed_groups(spark):
    r = np.random.default_rng(5)
    own = {"a": r.integers(0, 40, 900).astype(float).tolist(), "b": [2.5], None: [1.0, 4.0], "c": r.normal(size=101).tolist(), "n": []}
    rows = [(k, float(v)) for k, vs in own.items() for v in vs] + [("a", None), ("n", None)]
    got = {x["_by"]: (x["p"], x["q"]) for x in A.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), "g", "v", {"p": 0.5, "q": 0.95}).collect()}
    assert set(got) == {k for k, vs in own.items() if vs}
    for k in got:
        assert got[k] == pytest.approx((np.quantile(own[k], 0.5), np.quantile(own[k], 0.95)))


def test_no_group_is_gathered(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        entry.queries()["percentiles"](spark, sf_dir).explain()
    assert "percentile(" not in said.getvalue()
