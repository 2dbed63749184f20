"""Exact copies, SimHash links, repeated byte strings: against brute force, and odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import exact_dedup, queries, simhash, suffix_dedup
from vecloom.llm.common import components

ODD = [(1, "a  b\tc"), (1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (None, "a b c"), (5, " "), (6, "x" * 5000), (7, "x" * 5000), (8, "one two three four five")]
CLASH = "doc_id long, text string, source string, _keep int, _key int, _row int, key int, norm int, bucket int, fp int, size int"


def odd(spark, rows=None):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in (ODD if rows is None else rows)], CLASH)


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# ---- exact ----------------------------------------------------------------------------------


def groups_of(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return by


def test_exact_dedup_of_documents(spark, sf_dir):
    by = groups_of(documents(spark, sf_dir))
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in queries.op4_exact_dedup(spark, sf_dir).collect()}
    assert got == want


def test_exact_dedup_of_odd_rows(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(odd(spark), capacity=1).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    want = []
    for g in groups_of(ODD).values():
        least = min(i for i in g if i is not None)
        want += [(i, least, len(g), i == least) for i in g]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 8]
    assert exact_dedup.exact_dedup(odd(spark, [])).count() == 0 and exact_dedup.keep_first(odd(spark, [])).count() == 0


def test_a_text_stays_once_whatever_repeats(spark):
    a, b = "five words of one text", "five words  of\none text"
    rows = [(4, a), (4, a), (4, b), (None, b), (None, b), (5, a), (None, "alone"), (None, "alone")]
    got = exact_dedup.keep_first(odd(spark, rows)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in got) == [(0, "alone"), (4, "five")]
    many = odd(spark, [(k % 700, a) for k in range(1500)] + [(k, f"text {k}") for k in range(30)])  # over the hot bound
    got = exact_dedup.exact_dedup(many).groupBy("keep_id", "group_size").count().collect()
    assert sorted(map(tuple, got)) == sorted([(0, 1500, 1500)] + [(k, 1, 1) for k in range(30)])
    assert exact_dedup.keep_first(many).count() == 31


def test_the_directory_splits_overfull_buckets_only(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"), F.lit(1).alias("n"))
    d = exact_dedup.directory(keys, 100, 12)
    k = keys.withColumn("prefix", exact_dedup.prefix_of(12)).join(d, "prefix")
    load = k.groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in load) == 2000 and max(r["count"] for r in load) <= 100
    assert exact_dedup.directory(keys, 10_000, 12).select("bucket").distinct().count() == 1


def test_the_directory_decides(spark):
    """A directory that lacks prefixes, or sends equal keys to different owners, shows in the result."""
    df = spark.createDataFrame([(k, f"text {k % 40}") for k in range(120)], "doc_id long, text string")
    right = {tuple(r) for r in exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size").collect()}
    assert right == {(k, k % 40, 3) for k in range(120)}
    half = lambda *a: exact_dedup.directory(*a).where("prefix % 2 = 0")
    assert exact_dedup.exact_dedup(df, spread=half).count() < 120
    twice = lambda *a: (d := exact_dedup.directory(*a)).union(d.selectExpr("prefix", "depth", "bucket + 1000000"))
    assert exact_dedup.exact_dedup(df, spread=twice).count() == 240


# ---- SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text, k=4):
    ws = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [" ".join(ws)] if ws else []
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if n[b] * 2 > len(sh))


def plain_components(rows, radius=4):
    root = {f: f for f, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for f, i in rows:
        r = find(f)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f"{f:016x}", least[find(f)]) for f, i in rows]


def test_simhash_of_documents(spark, sf_dir):
    rows = [(plain_fingerprint(t), i) for i, t in documents(spark, sf_dir)]
    got = [tuple(r) for r in queries.op7_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(plain_components(rows))


@pytest.mark.parametrize("cell, refine", [(4096, 65_536), (3, 65_536), (5, 4)])
def test_links_of_dense_fingerprints(spark, cell, refine):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(6)] + [0]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 7))) for b in base for _ in range(40)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    c = components(simhash.links(df, cell=cell, refine=refine)).collect()
    got = defaultdict(set)
    for r in c:
        got[r["root"]].add(r["v"] % (1 << 64))
    want = defaultdict(set)
    for _, f, i in plain_components([(f, n) for n, f in enumerate(sorted(fps))]):
        want[i].add(int(f, 16))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_bit_sliced_pairs_are_all_pairs_within_the_radius():
    rnd = np.random.default_rng(5)
    f = rnd.integers(0, 1 << 63, 150, dtype=np.uint64) & np.uint64(0x3F00FF)
    ends = np.repeat([90, 91, 150], [90, 1, 59])
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(f, ends) for i, j in zip(a, b)}
    want = {(i, j) for i in range(150) for j in range(i + 1, int(ends[i])) if int(f[i] ^ f[j]).bit_count() <= 4}
    assert got == want


def test_simhash_of_odd_rows(spark):
    got = sorted(map(tuple, simhash.simhash_components(odd(spark)).select("doc_id", simhash.hex_of(), "component_id").collect()), key=str)
    assert got == sorted(plain_components([(plain_fingerprint(t), i) for i, t in ODD]), key=str)
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 8]
    assert simhash.simhash_components(odd(spark, [])).count() == 0


def test_one_row_of_a_component_stays_whatever_ids_repeat(spark):
    a, b = "aa bb cc dd ee ff", "gg hh ii jj kk ll mm"
    for rows in ([(1, a), (2, b), (2, a)], [(1, a), (None, a), (None, b)], [(3, a), (3, a), (3, b), (3, b)], [(None, a), (None, a)]):
        got = sorted(r["text"] for r in simhash.keep_one(odd(spark, rows)).collect())
        assert got == sorted({t for _, t in rows})


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    got = defaultdict(set)
    for r in components(e).collect():
        got[r["root"]].add(r["v"])
    assert sorted(map(sorted, got.values())) == [list(range(61)), [200, 201]]


# ---- suffix arrays --------------------------------------------------------------------------


def plain_removal(rows, length):
    c = Counter(t[k : k + length] for t in rows for k in range(len(t) - length + 1))
    out = []
    for t in rows:
        m = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if c[t[k : k + length]] > 1:
                m[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        out.append((len(t), int(m.sum()), len(suffix_dedup._runs(m)[0]), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = dict(zip([i for i, _ in docs], plain_removal([t.encode() for _, t in docs], 400)))
    assert {r[0]: tuple(r)[1:] for r in queries.op9_suffix_dedup(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup_of_odd_rows(spark, hot):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(40))
    shared = word() + word()
    rows = [*ODD, (20, word() + shared + word()), (21, shared + word()), (22, word() + shared), (23, "ü" * 90), (24, "a" * 30 + "ü" * 90), (25, "abcde" * 40)]
    got = sorted(map(tuple, suffix_dedup.suffix_dedup(odd(spark, rows), 32, 8, hot).collect()), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain_removal([(t or "").encode() for _, t in rows], 32))), key=str)
    assert got == want
    assert suffix_dedup.suffix_dedup(odd(spark, []), 32, 8, hot).count() == 0


def test_long_texts_are_anchored_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    rnd = random.Random(9)
    rows = ["".join(rnd.choice("ab") for _ in range(700)) for _ in range(3)]
    rows.append(rows[0][50:400] + rows[1][:300])
    raw = [r.encode() for r in rows]
    seen = defaultdict(list)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([bytes([k]) * 16 for k in range(4)], pa.binary()), pa.array(raw, pa.binary())], ["row", "text"])
    for b in suffix_dedup._occurrences(iter([batch]), 32, 8):
        for r in b.to_pylist():
            for s in r["starts"]:
                seen[r["row"][0]] += range(s, s + r["n"])
    assert all(sorted(seen[k]) == list(range(len(raw[k]) - 31)) for k in range(4))  # each window once


def test_suffix_arrays_and_prefixes():
    rnd = random.Random(1)
    for _ in range(150):
        k = rnd.choice([1, 2, 3, 8])
        t = np.array([rnd.randint(1, k) for _ in range(rnd.randint(1, 60))] + [0])
        sa = suffix_dedup.suffix_array(t, rnd.choice([3, 4096]) if k > 2 else 4096)
        assert list(sa) == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = suffix_dedup.common_prefixes(t, sa)
        for a, b in zip(sa, sa[1:]):
            m = 0
            while max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert lcp[b] == m
