"""Mixing, licenses, media, the two classifiers and the pipeline."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.llm.test_dedup import ODD, odd
from vecloom.llm import licenses, media, mixing, quality, queries, toxicity

# ---- mixing ---------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: 2 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and share[s] >= 2 * sizes[s]}
        if not over:
            return share
        full |= over


def check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = plain_targets(dict(sizes))
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) + 1e-6
    assert all(0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in rows)


def test_mixing_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check_mix(rows)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode().split()) for r in rows)
    again = {r["doc_id"]: r["taken"] for r in queries.op5_mixing(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}


def test_mixing_of_many_sources_with_a_hot_one(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rnd.randint(0, 9))), "hot" if i % 3 else f"é{i % 40}") for i in range(700)] + [(900, None, "z"), (901, "a b", None), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mix(df).collect())
    plan = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(df).collect()}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in plan.items() if n}


def test_expected_copies_are_fair(spark):
    rows = spark.createDataFrame([(i, 1, 10.0, 0.3) for i in range(200)], "id long, grp long, size double, p double")
    taken, draws = np.zeros(200), 12
    for seed in range(draws):
        x = {r["id"]: r["extra"] for r in mixing.pivotal(rows, seed).collect()}
        assert 59 <= sum(x.values()) <= 61
        taken += [x[i] for i in range(200)]
    # each is drawn 3.6 times of 12 on average; the spread is that of independent draws
    assert taken.max() < 11 and (taken > 0).mean() > 0.93
    assert 0.6 < taken.var() / (draws * 0.3 * 0.7) < 1.5


def test_equal_rows_are_documents_of_their_own(spark):
    rows = [(1, "w " * 300, "a")] * 30 + [(k, "w " * (10 + k % 50), "b") for k in range(2, 120)] + [(500, "w " * 410, "b")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= (300 if s == "a" else 60)
    copies = {r["copies"] for r in got if r["doc_id"] == 500}
    assert max(copies) - min(copies) <= 1
    plan = defaultdict(int)
    for r in got:
        plan[r["doc_id"]] += r["copies"]
    out = {r["doc_id"]: r["count"] for r in mixing.mixed_rows(df).groupBy("doc_id").count().collect()}
    assert out == {i: n for i, n in plan.items() if n}


def test_small_sources_come_near_their_targets(spark, sf_dir):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(abs(taken[s] - target[s]) > 0.05 * target[s] for s in target) <= len(target) // 4


def test_mixing_of_odd_rows(spark):
    assert mixing.mix(odd(spark)).count() == len(ODD)
    assert mixing.mix(odd(spark, [])).count() == 0 and mixing.mixed_rows(odd(spark, [])).count() == 0
    assert mixing.mixed_rows(odd(spark)).columns == odd(spark).columns


# ---- licenses -------------------------------------------------------------------------------


def test_licenses_of_documents(spark, sf_dir):
    same(queries.op6_licenses(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op6_licenses"])


def test_edited_and_odd_license_texts(spark):
    rnd = random.Random(6)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    mit = dict((t, x) for t, _, x in licenses.TEMPLATES)["mit-grant"].split()
    near, far = list(mit), list(mit)
    near[20] = "oddword"
    for k in range(3, len(far), 6):
        far[k] = f"odd{k}"
    rows = [*ODD, (40, noise(200) + " " + " ".join(near) + " " + noise(50)), (41, " ".join(far)), (42, "RELEASED   under\nthe MIT License!"), (43, "under the MIT License released")]
    got = {(r["doc_id"], r["template"]) for r in licenses.license_scan(odd(spark, rows)).collect()}
    assert got == {(40, "mit-grant"), (42, "mit-line")}
    r = licenses.license_scan(odd(spark, rows)).where("doc_id = 40").first()
    assert r["first_word"] == 200 and 0.8 <= r["containment"] < 1
    assert licenses.license_scan(odd(spark, [])).count() == 0


def test_templates_edited_at_the_edges_or_in_parts(spark, tmp_path):
    texts = []
    for _, _, text in licenses.TEMPLATES:
        w = text.split()
        half = len(w) // 2
        texts += [" ".join(x) for x in (w[1:], w[:-1], ["odd", *w[1:]], [*w[:-1], "odd"], w[1:-1], [*w[half - 3 :], "odd", *w[: half + 1]])]
    noise = " ".join(f"n{k}" for k in range(40))
    texts += [f"{noise} {x} {noise}" for x in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op6_licenses(spark, str(tmp_path)), connect_parts(tmp_path), queries.ORACLE_SQL["op6_licenses"])


def shingle(words):
    """Spark's xxhash64 of five words, signed."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (h >> 63 << 64)


def test_templates_of_eight_shingles_without_the_least(spark):
    rnd, templates = random.Random(9), []
    while len(templates) < 4:  # the first shingle is the least under either mask: only it is negative
        w = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
        if [shingle(w[k : k + 5]) < 0 for k in range(8)] == [True] + [False] * 7:
            templates.append((f"t{len(templates)}", "x", " ".join(w)))
    df = spark.createDataFrame([(k, text.split(" ", 1)[1]) for k, (_, _, text) in enumerate(templates)], "doc_id long, text string")
    got = {(r["doc_id"], r["template"], r["containment"]) for r in licenses.license_scan(df, templates).collect()}
    assert got == {(k, f"t{k}", 0.875) for k in range(4)}


def connect_parts(path):
    con = duckdb.connect()
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con

# ---- media ----------------------------------------------------------------------------------


def test_copies_of_scenes_are_found(spark):
    rng = np.random.default_rng(8)
    vec = [rng.normal(0, 0.12, 64).astype("<f4").tolist() for _ in range(160)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vec)] + [(168, vec[0]), (169, vec[0])], "vec_id long, embedding array<float>")
    got = {r["id"]: r for r in media.media_copies(media.pictured(df)).collect()}
    crops = [i for i in range(160) if i % 8 == 7]
    assert sum(got[i]["class_id"] == i - 1 for i in crops) >= 0.9 * len(crops)
    assert got[168]["class_id"] == got[169]["class_id"] == got[0]["class_id"] == 0 and got[0]["copies"] == 3
    clean = [i for i in range(160) if i % 8 not in (6, 7)]
    assert all(got[i]["class_id"] == i for i in clean)


def test_odd_pictures(spark):
    flat = media.write_picture(np.full((60, 60), 7.0))
    rows = [(1, None), (2, b""), (3, b"junk"), (4, flat), (5, flat), (6, b"P5 9"), (7, media.write_picture(np.zeros((1, 1)))), (None, flat)]
    df = spark.createDataFrame(rows, "id long, image binary")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in media.media_copies(df).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (4, 0), 5: (4, 0), 6: (6, 0), 7: (7, 0), None: (4, 0)}
    assert media.media_copies(df.where("id < 0")).count() == 0


def test_pictures_read_as_written():
    p = np.arange(12.0).reshape(3, 4)
    assert (media.read_picture(media.write_picture(p)) == p).all()
    assert media.read_picture(b"P6 # note\n2 1\n255\n" + bytes([3, 3, 3, 9, 9, 9])).tolist() == [[3.0, 9.0]]
    odd = [b"P5 99999999999999999999999 1 255 ", b"P5 4000000000 4000000000 255 x", b"P5 2 2 255 abc", b"P6 2 2 255 " + b"x" * 11, b"P5 0 5 255 ", b"P5 2 2 65535 abcdefgh", b"P5 # no end", b"P5 1 1 999999999999 a", b"P5 -1 2 255 ab", b"P5"]
    assert [media.read_picture(raw) for raw in odd] == [None] * len(odd)
    assert media.read_picture(b"P5 2 2 255 abcdef").shape == (2, 2)  # bytes behind the picture are left alone


def seen(p, degrees, scale):
    """The largest square of ``p``, turned and scaled about its middle."""
    a, n = np.deg2rad(degrees), min(p.shape) * scale
    n = int(n if degrees % 90 == 0 else n / (abs(np.cos(a)) + abs(np.sin(a))))
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    x, y = (np.cos(a) * x - np.sin(a) * y) / scale + (p.shape[1] - 1) / 2, (np.sin(a) * x + np.cos(a) * y) / scale + (p.shape[0] - 1) / 2
    x, y = np.clip(x, 0, p.shape[1] - 1.001), np.clip(y, 0, p.shape[0] - 1.001)
    i, j, fy, fx = y.astype(int), x.astype(int), y % 1, x % 1
    return (p[i, j] * (1 - fx) + p[i, j + 1] * fx) * (1 - fy) + (p[i + 1, j] * (1 - fx) + p[i + 1, j + 1] * fx) * fy


def large_pictures_and_crops(n):
    """Pictures of 320 pixels, then crops to half and a quarter of their area, plain or scaled and turned."""
    rng = np.random.default_rng(4)
    whole = [media._box(media.scene(rng.normal(0, 0.12, 64).astype("<f4").tobytes(), 320), 1) for _ in range(n)]
    rows, of = [(i, p) for i, p in enumerate(whole)], {}
    for i, p in enumerate(whole):
        for side in (226, 160):
            for degrees, scale in ((0, 1), (90, 1), (30, 1), (0, 0.7071), (0, 0.8)):
                y, x = rng.integers(0, 320 - side, 2)
                q = seen(p[y : y + side, x : x + side], degrees, scale)
                of[len(rows)] = i
                rows.append((len(rows), np.clip(q * 0.95 + 5 + rng.normal(0, 1, q.shape), 0, 255)))
    return rows, of


def test_crops_of_large_pictures_are_found(spark):
    rows, of = large_pictures_and_crops(4)
    df = spark.createDataFrame([(i, media.write_picture(p)) for i, p in rows], "id long, image binary")
    got = {r["id"]: r["class_id"] for r in media.media_copies(df).collect()}
    assert sum(got[i] == w for i, w in of.items()) >= 0.95 * len(of)
    assert all(got[i] == i for i in range(4))


def test_every_pair_of_a_group_within_the_radius_is_found():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (300, 32), np.uint8)
    flips = np.zeros((300, 256), np.uint8)
    for k in range(300):
        flips[k, rng.choice(256, k % 50, replace=False)] = 1
    words = np.concatenate((a, a ^ np.packbits(flips, axis=1))).view(np.uint64)
    apart = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2, dtype=int)
    grp, side, pic = np.repeat(np.array([3, 4], np.uint64), 300)[np.argsort(rng.permutation(600) % 2, kind="stable")], rng.random(600) < 0.5, np.arange(600) // 2
    order = np.argsort(grp, kind="stable")
    got = {(min(i, j), max(i, j)) for x, y in media.near_pairs(grp[order], side[order], pic[order], words[order]) for i, j in zip(order[x].tolist(), order[y].tolist())}
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(apart <= media.RADIUS))) if i < j and grp[i] == grp[j] and pic[i] != pic[j] and (grp[i] & 1 or side[i] != side[j])}
    assert got == want and got


def test_recall_of_links_against_all_pairs(spark, monkeypatch):
    rows, _ = large_pictures_and_crops(3)
    df = spark.createDataFrame([(i, media.write_picture(p)) for i, p in rows], "id long, image binary")
    known = media.described(df).select(F.col("id").alias("pic"), "feats").cache()
    want, pics = {}, [(r["pic"], r["feats"]) for r in known.collect()]
    for a, fa in pics:  # all pairs of descriptors, all votes
        for b, fb in pics:
            if a < b:
                cells = defaultdict(set)
                wa, wb = (np.array([[f[f"b{k}"] for k in range(4)] for f in fs]).view(np.uint64) for fs in (fa, fb))
                for i, j in zip(*np.nonzero(np.bitwise_count(wa[:, None] ^ wb[None]).sum(axis=2, dtype=int) <= media.RADIUS)):
                    x, y = fa[i], fb[j]
                    s, turn = y["scale"] / x["scale"], (y["angle"] - x["angle"]) % (2 * np.pi)
                    c, d = s * np.cos(turn), s * np.sin(turn)
                    tx, ty = y["x"] - (c * x["x"] - d * x["y"]), y["y"] - (d * x["x"] + c * x["y"])
                    for h in (0, 0.5):
                        cells[h, np.floor(np.log2(s) * 2 + 0.5), np.floor(turn / (np.pi / 6) + h) % 12, np.floor(tx / 16 + h), np.floor(ty / 16 + h)].add(x["no"])
                most = max(map(len, cells.values()), default=0)
                if most >= media.VOTES:
                    want[a, b] = most
    assert len(want) > 50
    got = {heavy: {(r["a"], r["b"]): r["n"] for r in media.links(known, heavy=heavy).collect()} for heavy in (media.HEAVY, 40)}
    assert got[media.HEAVY] == got[40]  # cutting frequent keys changes nothing
    got = got[40]
    assert all(k in want and n <= want[k] for k, n in got.items())
    assert len(got) >= 0.9 * len(want)
    for bits in (18, 26, 34):  # keys as the features of check_l, of 30 GB and of two terabytes get
        monkeypatch.setattr(media, "key_bits", lambda n, bits=bits: bits)
        got = {(r["a"], r["b"]): r["n"] for r in media.links(known).collect()}
        assert all(k in want and n <= want[k] for k, n in got.items())
        assert len(got) >= 0.9 * len(want)
    known.unpersist()


def test_tables_keep_their_chance_as_keys_grow():
    from math import comb

    n = [media.tables_for(bits) for bits in range(8, 41)]
    assert n == sorted(n) and n[0] <= 8 and n[-1] <= 256
    for bits, tables in zip(range(8, 41), n):
        assert 1 - (1 - comb(256 - media.DIFFER, bits) / comb(256, bits)) ** tables >= media.SURE or tables == 256


def test_corners_grow_with_the_picture():
    vector = np.random.default_rng(5).normal(0, 0.12, 64).astype("<f4").tobytes()
    small, large = (len(media.describe(media.scene(vector, side))) for side in (80, 320))
    assert large > 8 * small


# ---- classifiers ----------------------------------------------------------------------------


def area(df, labels, label):
    """The area under the curve of held-out labelled rows: how often a row of label 1 scores above one of label 0."""
    rows = df.where("held_out").join(labels, "doc_id").select("score", label).collect()
    one, zero = (np.array([r["score"] for r in rows if r[label] == v]) for v in (1, 0))
    assert len(one) >= 10 and len(zero) >= 10
    return ((one[:, None] > zero).mean() + (one[:, None] == zero).mean() / 2), rows


def test_classifiers_on_the_held_out_fold(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    quality_area, _ = area(queries.op10_quality(spark, big), labels, "quality")
    toxic_area, rows = area(queries.op8_toxicity(spark, big), labels, "toxic")
    assert quality_area > 0.93 and toxic_area > 0.8


def test_toxicity_learns_pairs_that_linear_weights_miss():
    rnd = random.Random(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for _ in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        text = " ".join(rnd.sample(words, 6) + ["insult"] * a + ["group"] * b)
        rows.append((int(a and b), text))
    m = toxicity.train(rows[:1200], (900, 300))
    z = m.logits([toxicity.slots_of(t) for _, t in rows[1200:]])
    assert np.mean((z > 0) == np.array([y for y, _ in rows[1200:]])) > 0.95


@pytest.mark.parametrize("label, fit, score", [("quality", quality.fit_quality, quality.score_quality), ("toxic", toxicity.fit_toxicity, toxicity.score_toxicity)])
def test_classifiers_on_odd_rows(spark, label, fit, score):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, None), (8, 0), (None, 1)], f"doc_id long, {label} int")
    out = score(odd(spark), fit(odd(spark), labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    none = labels.where("doc_id < 0")
    assert score(odd(spark, []), fit(odd(spark, []), none)).count() == 0
    assert {round(r["score"], 6) for r in score(odd(spark), fit(odd(spark), none)).collect()} == {0.5}
    assert quality.keep_good(odd(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).columns == odd(spark).columns


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as p
    from vecloom.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in p.STAGES:
        out = cut(stage(spark, docs, sf_dir))
        if name != p.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        seen.append((docs, out))
        docs = out
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    model = quality.fit_quality(seen[0][0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score_quality(seen[0][0], model).where("predicted = 1").collect()}
    assert ids(seen[0][1]) == good
    from vecloom.llm import exact_dedup, simhash

    assert ids(seen[1][1]) == ids(exact_dedup.exact_dedup(seen[1][0]).where("kept"))
    assert ids(seen[2][1]) == ids(simhash.simhash_components(seen[2][0]).where("doc_id = component_id"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3][0]).collect()}
    assert {r["doc_id"]: r["count"] for r in seen[3][1].groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert seen[4][1].count() == seen[4][0].count() and seen[4][1].where(~F.col("round_trip")).count() == 0


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and repeated texts, a long one, extra columns that clash, and an empty table."""
    import corpus_pipeline as p

    good = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row int, _key int, bucket int, copies int, chunk int"
    rows = [(k, t, "en", "a", len(t), 1, 2, 3, 4, 5) for k, t in enumerate(good)]
    rows += [(0, good[0], "en", "a", 1, 1, 2, 3, 4, 5), (20, good[1], None, None, None, None, None, None, None, None), (None, good[2], None, None, None, 1, 2, 3, 4, 5)]
    rows += [(21, None, "en", "b", 0, 1, 2, 3, 4, 5), (22, "", "en", "b", 0, 1, 2, 3, 4, 5), (23, " \n", None, "b", 0, 1, 2, 3, 4, 5), (24, "word " * 300_000, "en", "b", 1, 1, 2, 3, 4, 5), (None, None, None, None, None, None, None, None, None, None)]
    for k, own in enumerate((rows, [])):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(own, kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(12)] if own else [], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in p.STAGES:
            before, docs = docs, stage(spark, docs, d)
            assert docs.count() >= 0 if own else docs.count() == 0
            if name != p.STAGES[-1][0]:
                assert docs.columns == before.columns, name
            if name == "exact dedup":
                texts = [" ".join((r["text"] or "").split(" ")) for r in docs.collect()]
                assert len(texts) == len(set(texts))
        assert docs.where("not round_trip").count() == 0
