"""Alignment of two tokenizers against all pairs of overlapping tokens, and the table of frequent rows."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tests.llm.test_dedup import ODD, odd
from vecloom.llm import align, common, queries

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MORE = [(20, "a▁b"), (21, "<s> <|endoftext|> x"), (22, "日本語 テスト " * 40), (23, "   \n\t x"), (24, "z" * 3000 + "  y"), (25, "trailing "), (26, "\0null byte 🙂🙂")]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(align.default_tokenizer())
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=align.default_model())


def brute(texts, libraries):
    bpe, sp = libraries
    alphabet, docs, counts = align.byte_alphabet(), [], Counter()
    for t in texts:
        a = b = []
        if t:
            a = [(i, bytes(alphabet[c] for c in bpe.id_to_token(i))) for i in bpe.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(t)]
            if {b"".join(x for _, x in a), b"".join(x for _, x in b)} != {(" " + t).encode()}:
                a = b = []
        sides = []
        for side in (a, b):
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            sides.append(spans)
        a, b = sides
        groups, low = [], 0
        for e in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append("|".join(",".join(str(i) for i, _, x in side if low < x <= e) for side in sides))
            low = e
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s2 < e and s < e2]
        counts.update(links)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(na, nb, ng, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for na, nb, ng, x, h in docs]


def rows_of(df):
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def test_odd_rows_with_any_run_and_table_size(spark, libraries, monkeypatch):
    rows = ODD + MORE
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], libraries))), key=str)
    assert rows_of(align.align(odd(spark, rows))) == want
    monkeypatch.setattr(align, "SWEEP", 50)
    monkeypatch.setattr(align, "SPAN", 64)
    assert rows_of(align.align(odd(spark, rows), table=400)) == want  # most pairs are joined
    assert rows_of(align.align(odd(spark, rows), table=0)) == want
    assert align.align(odd(spark, [])).count() == 0


def test_documents_against_all_pairs(spark, sf_dir, libraries):
    short = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 5000")
    rows = short.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows], libraries))), key=str)
    assert rows_of(align.align(short)) == want


def test_whole_table_keeps_its_counts(spark, sf_dir):
    got = queries.op13_alignment(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.where("n_links <> n_a + n_b - n_groups").count() == 0  # what intervals with shared ends always have


def test_frequent_rows_fill_their_bound(spark):
    from pyspark.sql import functions as F

    words = spark.createDataFrame([(f"w{k}", 5000) for k in range(50)] + [(f"x{k}", 3) for k in range(50)], "w string, n long")
    head, whole = common.most_frequent(words, "w", F.lit(10), 400)
    n = head.agg(F.count("*"), F.min("n")).first()
    assert not whole and 36 <= n[0] <= 40 and n[1] == 5000
    head, whole = common.most_frequent(words, "w", F.lit(10), 600)
    assert not whole and head.where("n = 5000").count() == 50 and 55 <= head.count() <= 60
    head, whole = common.most_frequent(words, "w", F.lit(10), 1000)
    assert whole and head.count() == 100
    head, whole = common.most_frequent(words.limit(0), "w", F.lit(10), 0)
    assert whole and head.count() == 0
