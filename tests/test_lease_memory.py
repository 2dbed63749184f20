"""A resource's batch of requests waits as numbers."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from vecloom.streaming import feed as S


def test_leases_of_a_long_batch():
    r, n, kept = np.random.default_rng(1), 200_000, []
    rows = pd.DataFrame({"resource": "a", "holder": r.integers(0, 50, n), "ts": r.integers(0, 1 << 40, n), "order": np.arange(n)})
    own = S.Leases(3_600_000_000)
    own.lease = SimpleNamespace(exists=lambda: False, update=kept.append)
    tracemalloc.start()
    granted, parts = np.zeros(n, bool), 0
    for out in own.handleInputRows(("a",), (rows[k : k + 10_000] for k in range(0, n, 10_000)), None):
        granted[out["order"].to_numpy()] = out["granted"].to_numpy()
        parts += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.lexsort((rows["order"], rows["ts"]))
    want = S.lease_fold([tuple(x) for x in rows[["ts", "order", "holder"]].to_numpy().tolist()], 3_600_000_000)
    assert granted[order].tolist() == want and len(kept) == 1
    assert parts == 20 and peak < 20 << 20
