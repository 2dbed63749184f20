"""Memory of the centroid scores does not grow with batch and cells."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from vecloom.operators import index as X


@pytest.mark.parametrize("most", [1, 40])
def test_scores_of_a_batch_are_computed_in_parts(spark, most):
    r = np.random.default_rng(2)
    centers, q = r.normal(size=(1000, 8)), pd.Series([*r.normal(size=(5000, 8)), None])
    tracemalloc.start()
    got = X.nearest(centers, most).func(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[5000] is None and peak < 24 << 20  # all scores take 40 MB
    for k in (0, 4999):
        assert list(got[k]) == np.argsort(-(centers @ (q[k] / np.linalg.norm(q[k]))), kind="stable")[:most].tolist()
