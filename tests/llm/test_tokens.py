"""Token files and piece encoding against the libraries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_dedup import ODD, odd
from vecloom.llm import pieces, queries, token_store


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_store.default_tokenizer())


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def ids_of(bpe, text):
    return [*bpe.encode(text or "", add_special_tokens=False).ids, 0]


def test_tokens_of_documents_round_trip(spark, sf_dir, bpe):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for r in docs:
        ids = ids_of(bpe, r["text"])
        want.append((r["doc_id"], start, len(ids), token_store.crc_of(ids)))
        start += len(ids)
    got = [tuple(r) for r in queries.op1_token_ids(spark, sf_dir).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == want


def test_tokens_of_odd_rows(spark, bpe):
    got = sorted(map(tuple, token_store.token_digests(odd(spark)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    text = dict(ODD)
    at = 0
    for i, start, n, crc in got:
        ids = ids_of(bpe, text[i])
        assert (start, n, crc) == (at, len(ids), token_store.crc_of(ids))
        at += n
    assert token_store.token_digests(odd(spark, [])).count() == 0


def test_cut_texts_encode_like_whole_ones(bpe):
    token_store.KNOWN, known = 8, token_store.KNOWN  # tables are made, grow old and go
    e = token_store.Encoder(token_store.default_tokenizer())
    rnd, texts = random.Random(2), []
    for _ in range(400):
        t = "".join(rnd.choice(["a", "Ab", " ", " ", "  ", "\n", "\t", "é", "1", ".", "'s", " ", "\x1c", "<|endoftext|>", "日本"]) for _ in range(rnd.randint(0, 14)))
        texts.append(t)
    ids, sizes = e(pa.array(texts), 7)
    want = [[*bpe.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    small = token_store.Encoder(token_store.default_tokenizer())
    for t, x in zip(texts, want):
        assert small(pa.array([t]))[0].tolist() == x[:-1], repr(t)
    assert len(small.tables) == 2
    token_store.KNOWN = known


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=4))
def test_any_ids_can_be_read_at_random(lists):
    ids = np.array([i for x in lists for i in x], np.uint32)
    s = token_store.Segment(token_store.pack(np.arange(len(lists)), np.cumsum([len(x) for x in lists]), ids))
    assert (s.all() == ids).all() and s.n_tokens == len(ids)
    assert all(s[i] == ids[i] for i in range(0, len(ids), 7))


def test_pieces_are_the_librarys(spark, sf_dir, sp):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_pieces(spark, sf_dir).collect():
        assert r["ids"] == sp.encode(docs[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) and r["round_trip"]


def test_pieces_of_odd_texts(spark, sp):
    rows = [*ODD, (30, "  a  b\n c "), (31, "ab▁c Ａ😀 x" * 20), (32, "a" * 3000), (33, " " * 40 + "hello")]
    text = dict(rows)
    for table in (pieces.TABLE, 600, 0):
        got = pieces.encode(odd(spark, rows), table=table).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["ids"] == sp.encode(text[r["doc_id"]] or "")
    assert pieces.encode_documents(odd(spark, [])).count() == 0


def test_decoding_is_the_librarys(sp):
    table = pieces.piece_bytes(pieces._model(pieces.default_model()))
    for t in ["", "a", " a b", "ü 😀 x\ny", "▁"]:
        ids = sp.encode(t)
        assert pieces.decode_ids(ids, table).decode() == sp.decode(ids)


def test_viterbi_of_a_unigram_model(spark):
    m = pieces.PieceModel([("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("ba", -5.5, 1), ("▁ab", -6.0, 1), ("bab", -5.0, 1)], pieces.UNIGRAM)
    score = {p: s for p, s, _ in m.rows[1:]}

    def best(w):
        if not w:
            return 0.0
        return max((score[w[:k]] if w[:k] in score else -16.0) + best(w[k:]) for k in range(1, min(3, len(w)) + 1) if w[:k] in score or k == 1)

    rnd = random.Random(0)
    rows = [(i, "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 8)))) for i in range(40)]
    text = dict(rows)
    for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), m).collect():
        got = sum(m.rows[i][1] if i else -16.0 for i in r["ids"])
        assert got == pytest.approx(sum(best("▁" + w) for w in pieces.words_of(text[r["doc_id"]])))


def test_viterbi_of_a_word_of_thousands_of_characters():
    m = pieces.PieceModel([("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("ba", -5.5, 1), ("▁ab", -6.0, 1), ("bab", -5.0, 1)], pieces.UNIGRAM)
    rnd = random.Random(2)
    word = "▁" + "".join(rnd.choice("ab") for _ in range(5000))
    best, score = [(0.0, [])], {p: (i, v) for i, (p, v, _) in enumerate(m.rows) if i}
    for e in range(1, len(word) + 1):
        best.append(max(((best[s][0] + score[word[s:e]][1], (s, score[word[s:e]][0])) for s in range(max(0, e - 3), e) if word[s:e] in score), key=lambda x: x[0]))
    ids = m.viterbi_long(word)
    assert "".join(m.rows[i][0] for i in ids) == word
    assert sum(m.rows[i][1] for i in ids) == pytest.approx(best[-1][0])


def test_words_of_thousands_of_characters(spark, sp):
    rnd = random.Random(5)
    rows = [(1, "ab" * 450), (2, "".join(rnd.choice("abcde") for _ in range(1000))), (3, "x" + "a" * 1500), (4, "".join(rnd.choice("ab1_") for _ in range(2500)))]
    text = dict(rows)
    for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["ids"] == sp.encode(text[r["doc_id"]])
    m = pieces.PieceModel([("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("ba", -5.5, 1), ("▁ab", -6.0, 1), ("bab", -5.0, 1)], pieces.UNIGRAM)
    word = "".join(rnd.choice("ab") for _ in range(5000))
    got = pieces.encode(spark.createDataFrame([(1, word)], "doc_id long, text string"), m).first()["ids"]
    assert "".join(m.rows[i][0] for i in got) == "▁" + word
    assert sum(m.rows[i][1] for i in got) == pytest.approx(sum(m.rows[i][1] for i in m.viterbi_long("▁" + word)))


def test_decoding_keeps_a_column_named_decoded(spark):
    df = pieces.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).selectExpr("doc_id", "ids", "7 AS decoded")
    assert pieces.decode(df).columns == ["doc_id", "ids", "decoded", "decoded_"] and pieces.decode(df).first()["decoded_"] == "a b"


def test_rows_that_wait_for_rare_words_hold_one_document(spark, sp, monkeypatch):
    kept, cut = [], pieces.cut
    monkeypatch.setattr(pieces, "cut", lambda df, name, stay=False: kept.append((stay, cut(df, name, stay=stay))) or kept[-1][1])
    rnd = random.Random(8)
    rows = [(k, " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(20)) if k % 9 else None) for k in range(300)]
    text = dict(rows)
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), table=400).collect()
    assert len(got) == 300 and all(r["ids"] == sp.encode(text[r["doc_id"]] or "") for r in got)
    for df in [df for stay, df in kept if stay]:
        assert df.selectExpr("max(length(to_json(struct(*))))").first()[0] < 3000
