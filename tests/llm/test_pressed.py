"""The table of words goes through the driver compressed, and is whole again in the worker."""

import pickle

import numpy as np
import pyarrow as pa

from vecloom.llm import pieces
from vecloom.llm.common import Pressed


def test_the_driver_holds_the_table_of_words_compressed(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeinorstu"), rng.integers(5, 14))) for _ in range(4000)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(100)], "doc_id long, text string")
    model = pieces._model(pieces.default_model())
    table, rest = pieces._table_of(docs, model, pieces.TABLE)
    raw = sum(len(r["w"].encode()) + 4 * len(r["ids"]) + 24 for r in pieces.word_table(docs, model).collect())
    assert rest is None and len(pickle.dumps(table)) < raw / 2


def test_tables_of_many_parts_are_found_whole(spark):
    rows = [(f"w{k}é", [k, 70_000 + k][: 1 + k % 2]) for k in range(3000)]
    df = spark.createDataFrame(rows, "w string, ids array<int>").repartition(7)
    for own, most in ((df, 72_999), (df.where("w < 'w2'").selectExpr("w", "slice(ids, 1, 1) AS ids"), 2999), (df.limit(0), 0)):
        want = {r["w"]: r["ids"] for r in own.collect()}
        table = pickle.loads(pickle.dumps(Pressed.read(own))).unpacked()
        assert table.ids.dtype == (np.int32 if most >= 1 << 16 else np.uint16) and len(table.words) == len(want)
        place = table.find(pa.array([*want, "absent"], pa.string()))
        assert place[-1] == -1
        for w, at in zip(want, place[:-1].tolist()):
            assert table.ids[table.at[at] : table.at[at + 1]].tolist() == want[w]
