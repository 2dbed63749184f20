"""A step of the merges' fold evaluates no expression for each edge: that fold was two thirds of the CPU of the word table of op3_pieces."""

import random

from pyspark.sql import functions as F

from vecloom.llm import pieces


def test_merges_filter_no_edges_by_lambda(spark):
    from importlib.util import find_spec

    if find_spec("public_tokenizers") is None:
        return
    m, r = pieces._model(pieces.default_model()), random.Random(5)
    words = {pieces.MARK * r.randint(0, 2) + "".join(r.choice("etaoinsrhe=-01一\U0001f9ffé") for _ in range(r.randint(1, 30))) for _ in range(400)}
    words |= {"=" * 999, "t", "\U0001f9ff", pieces.MARK + "there"}
    rows = spark.createDataFrame([(w, 1) for w in sorted(words)], "w string, n long")
    found = pieces.lattice(rows.repartition(2, "w"), m)
    folded = found.select("w", pieces._merge_fold(F.col("w"), F.col("edges"), F.col("chars"), m).alias("ids"))
    assert "filter(" not in folded._jdf.queryExecution().analyzed().toString().lower()
    assert {x["w"]: x["ids"] for x in folded.collect()} == {w: m.merge_long(w) for w in words}
