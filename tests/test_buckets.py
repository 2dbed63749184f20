"""Keys of an ordered fold share buckets: state and timers are met once for a bucket and slot, not once for each key."""

import __spark_entry__ as entry
from vecloom.streaming import feed as S
from vecloom.streaming import ordered as O


def test_states_do_not_grow_with_the_keys(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(O, "BUCKETS", 3, raising=False)
    monkeypatch.setattr(S, "shared_path", lambda s, name, own=S.shared_path: paths.setdefault(name, own(s, name)))
    paths = {}
    got = entry.queries()["stream_ticks"](spark, sf_dir)
    assert got.select("key").distinct().count() > 3
    state = spark.read.format("statestore").option("stateVarName", "kept").load(paths["ticks-state"])
    assert state.count() <= 3
