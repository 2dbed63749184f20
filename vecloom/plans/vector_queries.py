"""Recall, scoring and vector algebra over the vector records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vector as V
from ..functions import vector_udf as U
from ..operators import bake as B
from ..operators import index as X
from ..operators import recall as R
from ..sources.tables import records
from .registry import query

K = 10
D = 64

REC = """
 rec AS (SELECT vec_id, 'rec:' || vec_id AS concept, label, list_transform(embedding, lambda x: x::DOUBLE) AS q,
   (vec_id * 37 % 100) / 100.0::DOUBLE AS reliability, (vec_id * 17 % 100) / 100.0::DOUBLE AS drift, vec_id % 12 AS mass FROM embeddings),
 qv AS (SELECT q AS query FROM rec WHERE vec_id = 0),
 s AS (SELECT *, greatest(-1.0, least(1.0, list_cosine_similarity(q, query))) AS c FROM rec, qv)
"""


def _top(expr: str, source: str = "s", more: str = "", k: int = K) -> str:
    return f"WITH {REC} {more} SELECT concept, round({expr}, 6) AS score FROM {source} ORDER BY score DESC, concept LIMIT {k}"


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    return r, R.query_vector(r, 0)


@query(_top("c"))
def recall_topk_cosine(spark, sf_dir):
    return R.recall(*_base(spark, sf_dir), K)


_STAB = "greatest(0.0, least(1.0, 1 - drift))"
_W = f"greatest(0.05, least(1.0, reliability * {_STAB}))"
_TAIL = f"0.14 * reliability + 0.10 * {_STAB} + 0.02 * least(mass, 10) / 10.0"


@query(_top(f"0.62 * (c + 1) / 2 + 0.12 * (c + 1) / 2 * {_W} + {_TAIL}"))
def recall_scored_canonical(spark, sf_dir):
    return R.recall(*_base(spark, sf_dir), K, R.ranked())


@query(_top(f"0.74 * (c + 1) / 2 + {_TAIL}"))
def recall_scored_no_precision(spark, sf_dir):
    return R.recall(*_base(spark, sf_dir), K, R.ranked(precision=False))


_BAND = """, d AS (SELECT *, list_transform(range(1, 65), lambda i: q[i] - query[i]) AS dif FROM s),
 l AS (SELECT *, sqrt(list_dot_product(dif, dif)) AS len FROM d),
 n AS (SELECT *, CASE WHEN len < 0.5 THEN 4 WHEN len < 1.5 THEN 8 ELSE 16 END AS n FROM l),
 b AS (SELECT *, CASE WHEN len <= 1e-8 THEN 1.0 ELSE greatest(0.05, least(1.0, list_sum(list_transform(dif[1:n], lambda x: 1 / (1 + abs(x)))) / n / (1 + greatest(0.0, least(10.0, len))))) END AS bw FROM n)"""


@query(_top(f"0.62 * (c + 1) / 2 + 0.12 * (c + 1) / 2 * greatest(0.05, least(1.0, {_W} * bw)) + {_TAIL}", "b", _BAND))
def recall_precision_bands(spark, sf_dir):
    return R.recall(*_base(spark, sf_dir), K, R.ranked(bands=True))


@query(
    _top(
        f"0.62 * (c + 1) / 2 + 0.12 * (c + 1) / 2 * {_W} + 0.14 * reliability + 0.10 * (0.6 * {_STAB} + 0.4 * (greatest(-1.0, least(1.0, list_cosine_similarity(q, frame))) + 1) / 2) + 0.02 * least(mass, 10) / 10.0",
        "f",
        ", f AS (SELECT s.*, r.q AS frame FROM s, rec r WHERE r.vec_id = 1)",
    )
)
def recall_framed(spark, sf_dir):
    r, q = _base(spark, sf_dir)
    return R.recall(r.crossJoin(F.broadcast(R.query_vector(r, 1, "frame"))), q, K, R.ranked(frame=F.col("frame")))


@query(f"WITH {REC} SELECT concept, round(list_sum(list_transform(range(0, 32), lambda i: 1 / (1 + abs(q[i * 2 + 1] - query[i * 2 + 1])))) / 32, 6) AS sigma FROM s")
def precision_strided(spark, sf_dir):
    r, q = _base(spark, sf_dir)
    return R.with_query(r, q).select("concept", F.round(S.strided_precision(F.col("q"), F.col("query"), D), 6).alias("sigma"))


@query(f"WITH {REC} SELECT concat_ws('::', label, concept) AS concept, round(c, 6) AS score FROM s ORDER BY score DESC, concept LIMIT {K}")
def recall_federated(spark, sf_dir):
    return R.federated(*_base(spark, sf_dir), K)


@query(
    f"WITH {REC}, lens AS (SELECT q AS lens FROM rec WHERE vec_id = 1), b AS (SELECT list_transform(range(1, 65), lambda i: query[i] * lens[i]) AS v FROM qv, lens) SELECT concept, round(greatest(-1.0, least(1.0, list_cosine_similarity(q, v))), 6) AS score FROM rec, b ORDER BY score DESC, concept LIMIT {K}"
)
def recall_lens(spark, sf_dir):
    r, q = _base(spark, sf_dir)
    lensed = q.crossJoin(R.query_vector(r, 1, "lens")).select(V.normalise(V.multiply(F.col("query"), F.col("lens"))).alias("query"))
    return R.recall(r, lensed, K)


@query(
    f"WITH {REC}, p AS (SELECT vec_id - 1 AS vec_id, q AS p FROM rec), m AS (SELECT s.*, coalesce(p.p, s.q) AS p FROM s LEFT JOIN p USING (vec_id) ORDER BY c DESC, concept LIMIT 20) SELECT concept, round(greatest(-1.0, least(1.0, 0.8 * c + 0.2 * greatest(-1.0, least(1.0, list_cosine_similarity(p, query))))), 6) AS score FROM m ORDER BY score DESC, concept LIMIT {K}"
)
def recall_momentum(spark, sf_dir):
    r, q = _base(spark, sf_dir)
    nxt = r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("_p"))
    return R.momentum(r.join(nxt, "vec_id", "left").withColumn("p", F.coalesce("_p", "q")), q, K)


_VOL = "(vec_id % 20) / 20.0::DOUBLE"


@query(_top(f"((c + 1) / 2) * CASE WHEN {_VOL} <= 0 THEN 1.0 ELSE 1 / (1 + 0.35 * greatest(0.01, least(1.0, {_VOL}))) END"))
def recall_volatility_damped(spark, sf_dir):
    sim = (V.cosine(F.col("q"), F.col("query")) + 1) / 2
    return R.recall(*_base(spark, sf_dir), K, S.damped(sim, (F.col("vec_id") % 20) / 20.0, F.col("concept")))


@query(f"WITH {REC} SELECT concept, round(c, 6) AS score, reliability FROM s WHERE reliability >= 0.74 ORDER BY score DESC, concept LIMIT {K}")
def recall_grounded(spark, sf_dir):
    r, q = _base(spark, sf_dir)
    s = R.with_query(r.where("reliability >= 0.74"), q).withColumn("score", F.round(V.cosine(F.col("q"), F.col("query")), 6))
    return R.top_k(s, K, "reliability")


_CODE = "list_transform({v}, lambda x: greatest(-127.0, least(127.0, round(x * 127))))"
_I8 = "list_transform(range(1, 65), lambda i: greatest(-127.0, least(127.0, round({v}[i] * 127))) / 127.0 * 0.5)"


@query(
    f"WITH {REC}, i AS (SELECT concept, {_I8.format(v='q')} AS a, {_I8.format(v='query')} AS b FROM s), "
    "n AS (SELECT *, least(list_dot_product(a, a), 0.9999) AS na, least(list_dot_product(b, b), 0.9999) AS nb, list_transform(range(1, 65), lambda i: a[i] - b[i]) AS d FROM i) "
    f"SELECT concept, round(1 / (1 + acosh(greatest(1.0, 1 + 2 * list_dot_product(d, d) / greatest((1 - na) * (1 - nb), 1e-4)))), 6) AS score FROM n ORDER BY score DESC, concept LIMIT {K}"
)
def recall_int8_hyperbolic(spark, sf_dir):
    half = lambda c: F.transform(V.int8_codes(F.col(c), D).cast("array<double>"), lambda x: x / 127.0 * 0.5)
    return R.recall(*_base(spark, sf_dir), K, V.hyperbolic_score(half("q"), half("query")))


@query(
    f"""WITH {REC}, i AS (SELECT concept, c, list_dot_product({_CODE.format(v='q')}, {_CODE.format(v='query')}) AS near FROM s), b AS (SELECT concept, c FROM i ORDER BY near DESC, concept LIMIT {8 * K})
    SELECT concept, round(c, 6) AS score FROM b ORDER BY score DESC, concept LIMIT {K}"""
)
def recall_two_phase_int8(spark, sf_dir):
    return R.two_phase(*_base(spark, sf_dir), K)


@query()
def recall_indexed(spark, sf_dir):
    """Every record whose id is divisible by 100, against all records, through an index with as many probes as it measures to need."""
    r, _ = _base(spark, sf_dir)
    index = X.Index.build(spark, r.select("concept", "q"))
    asked = r.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("q").alias("query"))
    return index.search(asked, K, index.calibrate(K))


_MANY = f"""WITH {REC}, a AS (SELECT vec_id AS query_id, q AS asked FROM rec WHERE vec_id % 10 = 0),
 m AS (SELECT query_id, concept, round(greatest(-1.0, least(1.0, list_cosine_similarity(q, asked))), 6) AS score FROM rec, a),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept) AS rank FROM m)"""


def _asked(spark, sf_dir):
    r = records(spark, sf_dir)
    return r, r.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("q").alias("query"))


@query(f"{_MANY} SELECT query_id, concept, score, rank FROM r WHERE rank <= {K}")
def recall_many(spark, sf_dir):
    """Every tenth record asks all records, in one pass."""
    return B.recall_many(*_asked(spark, sf_dir), K)


@query(
    f"""{_MANY}, t AS (SELECT concept, max(score) AS score FROM r WHERE rank <= 15 GROUP BY 1 ORDER BY score DESC, concept LIMIT 15), n AS (SELECT concept, vec_id FROM rec ORDER BY vec_id DESC LIMIT 15)
    SELECT 'fixed' AS section, x.position, x.concept, NULL::DOUBLE AS score FROM (VALUES (1, 'rec:3'), (2, 'rec:none'), (3, 'rec:1')) AS x(position, concept) JOIN rec USING (concept)
    UNION ALL SELECT 'top', row_number() OVER (ORDER BY score DESC, concept), concept, score FROM t UNION ALL SELECT 'recent', row_number() OVER (ORDER BY vec_id DESC), concept, NULL FROM n"""
)
def context_bake(spark, sf_dir):
    r, asked = _asked(spark, sf_dir)
    return B.context_bake(r.select("concept", "q", F.col("vec_id").alias("ts")), asked, ["rec:3", "rec:none", "rec:1"], 15)


@query()
def recall_srht_b4(spark, sf_dir):
    return R.srht(*_base(spark, sf_dir), K, D)


def _pair(how: str) -> str:
    return f"WITH {REC}, o AS (SELECT q AS other FROM rec WHERE vec_id = 1), b AS (SELECT list_transform(range(1, 65), lambda i: {how}) AS v FROM qv, o) SELECT concept, round(greatest(-1.0, least(1.0, list_cosine_similarity(q, v))), 6) AS score FROM rec, b ORDER BY score DESC, concept LIMIT {K}"


def _composed(spark, sf_dir, how):
    r, q = _base(spark, sf_dir)
    both = q.crossJoin(R.query_vector(r, 1, "other")).select(V.normalise(how(F.col("query"), F.col("other"))).alias("query"))
    return R.recall(r, both, K)


@query(_pair("query[i] + other[i]"))
def trace_add(spark, sf_dir):
    return _composed(spark, sf_dir, V.add)


@query(_pair("query[i] * other[i]"))
def trace_bind(spark, sf_dir):
    return _composed(spark, sf_dir, V.multiply)


@query(f"WITH {REC} SELECT vec_id, list_transform(q[1:8], lambda x: round(x, 6) + 0.0) AS preview, round(sqrt(list_dot_product(q, q)), 6) AS norm, abs(sqrt(list_dot_product(q, q)) - 1) < 0.05 AS unit FROM rec")
def record_projection(spark, sf_dir):
    r = records(spark, sf_dir)
    n = V.norm(F.col("q"))
    return r.select("vec_id", F.transform(F.slice("q", 1, 8), lambda x: F.round(x, 6) + 0.0).alias("preview"), F.round(n, 6).alias("norm"), (F.abs(n - 1) < 0.05).alias("unit"))


# ---- algebra: z = (q, reversed q), w = the same of record 0; each result as four numbers ---------

_Z = f"""WITH {REC}, z AS (SELECT vec_id, drift, q AS ar, list_reverse(q) AS ai, query AS br, list_reverse(query) AS bi FROM s)"""


def _digest_sql(re: str, im: str, unit: bool = True) -> str:
    n = "sqrt(list_dot_product(re, re) + list_dot_product(im, im))"
    by = n if unit else "1.0"
    return f"""{_Z}, v AS (SELECT vec_id, list_transform(range(1, 65), lambda i: {re}) AS re, list_transform(range(1, 65), lambda i: {im}) AS im FROM z),
      u AS (SELECT *, {by} AS n FROM v)
      SELECT vec_id, round(re[1] / n, 6) + 0.0 AS re_first, round(im[64] / n, 6) + 0.0 AS im_last, round(list_sum(re) / n, 6) + 0.0 AS re_sum, round({n} / n, 6) AS norm FROM u WHERE n > 1e-8"""


def _digest(spark, sf_dir, op) -> DataFrame:
    r, q = _base(spark, sf_dir)
    s = R.with_query(r, q)
    a, b = V.Z(F.col("q"), F.reverse("q")), V.Z(F.col("query"), F.reverse("query"))
    z = op(a, b)
    s = s.select("vec_id", z.re.alias("re"), z.im.alias("im")).where("re is not null")
    n = F.sqrt(V.dot(F.col("re"), F.col("re")) + V.dot(F.col("im"), F.col("im")))
    r6 = lambda c: F.round(c, 6) + 0.0
    return s.select("vec_id", r6(F.get("re", F.lit(0))).alias("re_first"), r6(F.get("im", F.lit(D - 1))).alias("im_last"), r6(V.total(F.col("re"))).alias("re_sum"), F.round(n, 6).alias("norm"))


@query(_digest_sql("ar[i] + br[i]", "ai[i] + bi[i]"))
def vec_add(spark, sf_dir):
    return _digest(spark, sf_dir, V.superpose)


@query(_digest_sql("ar[i] * br[i] - ai[i] * bi[i]", "ar[i] * bi[i] + ai[i] * br[i]"))
def vec_bind(spark, sf_dir):
    return _digest(spark, sf_dir, V.bind)


@query(_digest_sql("ar[i] * br[i] + ai[i] * bi[i]", "ai[i] * br[i] - ar[i] * bi[i]"))
def vec_unbind(spark, sf_dir):
    return _digest(spark, sf_dir, V.unbind)


@query(_digest_sql("-ar[i]", "-ai[i]"))
def vec_invert(spark, sf_dir):
    return _digest(spark, sf_dir, lambda a, b: V.invert(a))


@query(_digest_sql("ar[(i - 48 + 64) % 64 + 1]", "ai[(i - 48 + 64) % 64 + 1]", unit=False))
def vec_shift(spark, sf_dir):
    return _digest(spark, sf_dir, lambda a, b: V.shift(a, 47, D))


@query(_digest_sql("br[i] * ar[i] + bi[i] * ai[i]", "bi[i] * ar[i] - br[i] * ai[i]"))
def vec_deduce(spark, sf_dir):
    return _digest(spark, sf_dir, V.deduce)


@query(_digest_sql("ar[i] * br[i]", "ai[i] * br[i]"))
def vec_attend(spark, sf_dir):
    return _digest(spark, sf_dir, lambda a, b: V.attend(a, b.re))


@query(_digest_sql("ar[i] * br[i] + ai[i] * bi[i]", "ai[i] * br[i] - ar[i] * bi[i]"))
def vec_compose(spark, sf_dir):
    return _digest(spark, sf_dir, lambda a, b: V.zunit(V.product(a, V.conjugate(b))))


@query(_digest_sql("(ar[i] - ai[i]) * sqrt(0.5)", "(ar[i] + ai[i]) * sqrt(0.5)", unit=False))
def vec_dynamis(spark, sf_dir):
    return _digest(spark, sf_dir, lambda a, b: V.rotate(a, 0.7853981633974483))


@query(_digest_sql("ar[i] * cos(vec_id * pi() / 432) + ai[i] * sin(vec_id * pi() / 432)", "ai[i] * cos(vec_id * pi() / 432) - ar[i] * sin(vec_id * pi() / 432)", unit=False))
def vec_temporal_phase(spark, sf_dir):
    return _digest(spark, sf_dir, lambda a, b: V.aged(a, F.col("vec_id")))


_IN = "list_dot_product(ar, br) + list_dot_product(ai, bi)"
_BB = "(list_dot_product(br, br) + list_dot_product(bi, bi))"


@query(
    f"""{_Z}, m AS (SELECT *, {_IN} AS pr, list_dot_product(ai, br) - list_dot_product(ar, bi) AS pi, {_BB} AS bb FROM z),
    v AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (pr * br[i] - pi * bi[i]) / bb) AS re, list_transform(range(1, 65), lambda i: (pr * bi[i] + pi * br[i]) / bb) AS im FROM m)
    SELECT vec_id, round(re[1], 6) + 0.0 AS re_first, round(im[64], 6) + 0.0 AS im_last, round(list_sum(re), 6) + 0.0 AS re_sum, round(sqrt(list_dot_product(re, re) + list_dot_product(im, im)), 6) AS norm FROM v"""
)
def vec_project(spark, sf_dir):
    return _digest(spark, sf_dir, V.project)


@query(
    f"""{_Z}, n AS (SELECT *, sqrt(list_dot_product(ar, ar) + list_dot_product(ai, ai)) * sqrt{_BB} AS n FROM z)
    SELECT vec_id, round(CASE WHEN n <= 1e-8 THEN 0 ELSE least(1.0, sqrt(pow({_IN}, 2) + pow(list_dot_product(ai, br) - list_dot_product(ar, bi), 2)) / n) END, 6) AS hermitian,
      round(greatest(-1.0, least(1.0, ({_IN}) / n)), 6) + 0.0 AS cosine FROM n"""
)
def vec_hermitian(spark, sf_dir):
    s = R.with_query(*_base(spark, sf_dir))
    a, b = V.Z(F.col("q"), F.reverse("q")), V.Z(F.col("query"), F.reverse("query"))
    return s.select("vec_id", F.round(V.hermitian(a, b), 6).alias("hermitian"), (F.round(V.zcosine(a, b), 6) + 0.0).alias("cosine"))


@query(f"WITH {REC}, d AS (SELECT vec_id, list_transform(range(1, 65), lambda i: q[i] - query[i]) AS d FROM s) SELECT vec_id, round(sqrt(list_dot_product(d, d)), 6) AS length, list_transform(d[1:16], lambda x: round(x, 5) + 0.0) AS residual FROM d")
def vec_residual(spark, sf_dir):
    s = R.with_query(*_base(spark, sf_dir))
    n, d = V.residual(F.col("q"), F.col("query"))
    return s.select("vec_id", F.round(n, 6).alias("length"), F.transform(d, lambda x: F.round(x, 5) + 0.0).alias("residual"))


@query(f"WITH {REC}, b AS (SELECT vec_id AS axis, q AS a FROM rec WHERE vec_id < 4) SELECT vec_id, axis, round(greatest(-1.0, least(1.0, list_cosine_similarity(q, a))), 6) + 0.0 AS cosine FROM rec, b")
def vec_measure(spark, sf_dir):
    r = records(spark, sf_dir)
    basis = r.where("vec_id < 4").select(F.col("vec_id").alias("axis"), F.col("q").alias("a"))  # four axes
    return r.crossJoin(F.broadcast(basis)).select("vec_id", "axis", (F.round(V.cosine(F.col("q"), F.col("a")), 6) + 0.0).alias("cosine"))


@query(
    f"WITH {REC}, p AS (SELECT vec_id + 1 AS vec_id, q AS before FROM rec), x AS (SELECT vec_id, c, greatest(-1.0, least(1.0, list_cosine_similarity(before, query))) AS cb FROM s JOIN p USING (vec_id)) SELECT vec_id, round(0.7 * (1 - c) + 0.3 * abs(c - cb), 6) AS curvature FROM x"
)
def vec_curvature(spark, sf_dir):
    r, q = _base(spark, sf_dir)
    before = r.select((F.col("vec_id") + 1).alias("vec_id"), F.col("q").alias("before"))
    s = R.with_query(r.join(before, "vec_id"), q)
    return s.select("vec_id", F.round(V.curvature(F.col("q"), F.col("query"), F.col("before")), 6).alias("curvature"))


@query(f"WITH {REC} SELECT vec_id, sqrt(list_dot_product(q, q)) BETWEEN 0.95 AND 1.05 AS well_formed, abs(c) < 0.1 AS orthogonal FROM s")
def vec_gates(spark, sf_dir):
    s = R.with_query(*_base(spark, sf_dir))
    return s.select("vec_id", V.well_formed(F.col("q")).alias("well_formed"), V.quasi_orthogonal(F.col("q"), F.col("query")).alias("orthogonal"))


@query(f"WITH {REC}, c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: greatest(-127.0, least(127.0, round(q[i] * 127)))::INT) AS c FROM rec) SELECT vec_id, c AS codes, list_transform(range(0, 16), lambda i: (c[i*4+1] & 255)::BIGINT + ((c[i*4+2] & 255)::BIGINT << 8) + ((c[i*4+3] & 255)::BIGINT << 16) + ((c[i*4+4] & 255)::BIGINT << 24)) AS packed FROM c")
def vec_int8_pack(spark, sf_dir):
    c = V.int8_codes(F.col("q"), D).cast("array<int>")
    return records(spark, sf_dir).select("vec_id", c.alias("codes")).select("vec_id", "codes", V.pack_int8(F.col("codes"), D).alias("packed"))


@query(f"WITH {REC} SELECT vec_id, list_transform(range(0, 8), lambda i: round(CASE WHEN i % 2 = 0 THEN q[i // 2 + 1] ELSE q[64 - i // 2] END, 6) + 0.0) AS flat FROM rec")
def vec_flatten(spark, sf_dir):
    z = V.Z(F.col("q"), F.reverse("q"))
    return records(spark, sf_dir).select("vec_id", F.transform(F.slice(V.flatten(z), 1, 8), lambda x: F.round(x, 6) + 0.0).alias("flat"))


def _iterative(spark, sf_dir, udf) -> DataFrame:
    s = R.with_query(*_base(spark, sf_dir))
    return s.select("vec_id", udf("q", "query").alias("v")).select("vec_id", F.transform(F.slice("v", 1, 4), lambda x: F.round(x, 6) + 0.0).alias("head"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def _unit(v: str, n: str) -> str:
    return f"list_transform({v}, lambda x: CASE WHEN {n} > 1e-8 THEN x / {n} ELSE 0.0 END)"


def _heads(source: str) -> str:
    return f"SELECT vec_id, list_transform(range(1, 5), lambda i: round(v[i], 6) + 0.0) AS head, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM {source}"


def _stages(h: float) -> str:
    """One Runge-Kutta step of ``q`` towards ``query`` as nested selects."""
    step = "SELECT *, list_transform(range(1, 65), lambda i: query[i] - list_dot_product(query, q) * q[i]) AS k1 FROM w"
    for k, by in ((2, h / 2), (3, h / 2), (4, h)):
        moved = f"SELECT *, list_transform(range(1, 65), lambda i: q[i] + {by} * k{k - 1}[i]) AS y{k} FROM ({step})"
        x = f"SELECT *, {_unit(f'y{k}', f'sqrt(list_dot_product(y{k}, y{k}))')} AS x{k} FROM ({moved})"
        step = f"SELECT *, list_transform(range(1, 65), lambda i: query[i] - list_dot_product(query, x{k}) * x{k}[i]) AS k{k} FROM ({x})"
    return f"SELECT vec_id, s + 1 AS s, query, list_transform(range(1, 65), lambda i: q[i] + {h / 6} * (k1[i] + 2 * k2[i] + 2 * k3[i] + k4[i])) AS y FROM ({step})"


_RK4 = f"""w AS (SELECT vec_id, 0 AS s, query, {_unit('q', 'sqrt(list_dot_product(q, q))')} AS q FROM rec, qv
    UNION ALL SELECT vec_id, s, query, {_unit('y', 'sqrt(list_dot_product(y, y))')} FROM ({_stages(0.1)}) WHERE s <= 4)"""
_EASED = f"""z AS (SELECT vec_id, 0 AS s, query, {_unit('q', 'sqrt(list_dot_product(q, q))')} AS q FROM rec, qv
    UNION ALL SELECT vec_id, s + 1, query, {_unit('y', 'sqrt(list_dot_product(y, y))')} FROM (SELECT vec_id, s, query, list_transform(range(1, 65), lambda i: (1 - greatest(0.30 - 0.017 * s, 0.10)) * q[i] + greatest(0.30 - 0.017 * s, 0.10) * query[i]) AS y FROM z WHERE s < 12))"""


@query(
    f"""WITH {REC}, g AS (SELECT vec_id, list_transform(range(1, 65), lambda i: q[i] - list_dot_product(q, query) / greatest(list_dot_product(query, query), 1e-8) * query[i]) AS y FROM rec, qv),
    u AS (SELECT vec_id, {_unit('y', 'sqrt(list_dot_product(y, y))')} AS v FROM g) {_heads('u')}"""
)
def vec_gram_schmidt(spark, sf_dir):
    return _iterative(spark, sf_dir, U.gram_schmidt())


@query(f"WITH RECURSIVE {REC}, {_RK4} {_heads('(SELECT vec_id, q AS v FROM w WHERE s = 4)')}")
def vec_rk4(spark, sf_dir):
    return _iterative(spark, sf_dir, U.rk4(steps=4))


@query(f"WITH RECURSIVE {REC}, {_EASED} {_heads('(SELECT vec_id, q AS v FROM z WHERE s = 12)')}")
def vec_reconcile(spark, sf_dir):
    return _iterative(spark, sf_dir, U.reconcile(12))


@query(
    f"""WITH RECURSIVE {REC}, g AS (SELECT 0 AS i, 7::HUGEINT AS x UNION ALL SELECT i + 1, (x * 6364136223846793005 + 1) % 18446744073709551616::HUGEINT FROM g WHERE i < 64),
    t AS (SELECT list(CASE WHEN x >= 9223372036854775808::HUGEINT THEN -1.0 ELSE 1.0 END::DOUBLE ORDER BY i) AS t FROM g WHERE i > 0),
    u AS (SELECT vec_id, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: CASE WHEN bit_count((i & j)::INT) % 2 = 0 THEN q[j + 1] * t[j + 1] ELSE -q[j + 1] * t[j + 1] END)) / 8.0) AS v FROM rec, t) {_heads('u')}"""
)
def vec_srht(spark, sf_dir):
    return _iterative(spark, sf_dir, U.srht(D))


@query(
    f"""WITH RECURSIVE {REC}, g AS (SELECT 0 AS i, 7::HUGEINT AS x UNION ALL SELECT i + 1, (x * 6364136223846793005 + 1) % 18446744073709551616::HUGEINT FROM g WHERE i < 64),
    t AS (SELECT list(((x // 4294967296)::DOUBLE / 4294967295.0::DOUBLE * 2 - 1) * 0.05::DOUBLE ORDER BY i) AS t FROM g WHERE i > 0),
    b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: q[i] * query[i] * cos(t[i])) || list_transform(range(1, 65), lambda i: q[i] * query[i] * sin(t[i])) AS y FROM rec, qv, t),
    u AS (SELECT vec_id, {_unit('y', 'sqrt(list_dot_product(y, y))')} AS v FROM b) {_heads('u')}"""
)
def vec_bind_stochastic(spark, sf_dir):
    return _iterative(spark, sf_dir, U.bind_noisy(D))


@query(
    f"""WITH {REC}, h AS (SELECT k, xor(k, 1162757970)::HUGEINT AS h FROM range(192) t(k)), a AS (SELECT k, (xor(h::BIGINT, h::BIGINT >> 16)::HUGEINT * 2246822507) % 4294967296 AS h FROM h),
    b AS (SELECT k, (xor(h::BIGINT, h::BIGINT >> 13)::HUGEINT * 3266489909) % 4294967296 AS h FROM a), w AS (SELECT list(xor(h::BIGINT, h::BIGINT >> 16)::DOUBLE / 4294967295.0::DOUBLE * 2 - 1 ORDER BY k) AS w FROM b)
    SELECT vec_id, list_transform(range(0, 3), lambda j: round(list_sum(list_transform(range(0, 64), lambda i: abs(q[i + 1]) * w[i * 3 + j + 1])), 6)) AS position FROM rec, w"""
)
def vec_project_3d(spark, sf_dir):
    return records(spark, sf_dir).select("vec_id", U.project_3d(D)("q").alias("p")).select("vec_id", F.transform("p", lambda x: F.round(x, 6)).alias("position"))


_UNIX = "(vec_id * 977 % 700000)"


@query(
    f"""WITH {REC} SELECT concept, round(reliability * 0.40 + greatest(0.0, least(1.0, exp(-{_UNIX} / 3600.0))) * 0.30 + (CASE vec_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 WHEN 4 THEN 0.2 ELSE 0.1 END) * 0.20 + CASE WHEN mass > 6 THEN 0.05 ELSE 0.10 END, 6) AS promote,
    round((1 - reliability) * 0.45 + least({_UNIX} / 86400.0, 1.0) * 0.35 + least(vec_id % 7 / 10.0, 1.0) * 0.20, 6) AS demote,
    round(reliability * 0.55 + 0.35 / ({_UNIX} + 1), 6) AS evict,
    CASE WHEN {_UNIX} < 3600 THEN 0.12 WHEN {_UNIX} < 86400 THEN 0.06 WHEN {_UNIX} < 604800 THEN 0.02 ELSE 0.0 END AS boost FROM rec"""
)
def residency_scores(spark, sf_dir):
    idle, far = F.col("vec_id") * 977 % 700000, F.col("vec_id") % 7
    r = records(spark, sf_dir)
    return r.select(
        "concept",
        F.round(S.promote_score(F.col("reliability"), idle, far, F.col("mass") > 6), 6).alias("promote"),
        F.round(S.demote_priority(F.col("reliability"), idle, far), 6).alias("demote"),
        F.round(S.eviction_score(F.col("reliability"), idle, F.col("concept")), 6).alias("evict"),
        S.recency_boost(idle).alias("boost"),
    )


@query(
    f"""WITH {REC}, r AS (SELECT *, row_number() OVER (ORDER BY vec_id % 100 DESC, concept) - 1 AS rk FROM rec),
    b AS (SELECT concept, reliability * 0.35 + CASE WHEN mass > 8 THEN 0.18 ELSE 0 END + 0.12 / (1 + rk) + drift * 0.15 + CASE WHEN vec_id % 11 = 0 THEN 0.36 WHEN vec_id % 7 = 0 THEN 0.22 WHEN vec_id % 5 = 0 THEN 0.18 ELSE 0 END AS base, vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0 AS free, {_VOL} AS vol FROM r)
    SELECT concept, round(greatest(0.0, least(1.5, base * CASE WHEN free OR vol <= 0 THEN 1.0 ELSE 1 / (1 + 0.35 * greatest(0.01, least(1.0, vol))) END)), 6) AS score FROM b ORDER BY score DESC, concept LIMIT 25"""
)
def injection_rank(spark, sf_dir):
    r = records(spark, sf_dir)
    ranks = R.recency_ranks(r.select("concept", (F.col("vec_id") % 100).alias("ts")))
    i = F.col("vec_id")
    score = S.injection_score(F.col("reliability"), F.col("mass") > 8, F.coalesce("recency_rank", F.lit(999)), F.col("drift"), i % 11 == 0, i % 7 == 0, i % 5 == 0, (i % 20) / 20.0)
    return R.top_k(r.join(ranks, "concept", "left").withColumn("score", F.round(score, 6)), 25)


@query(
    f"""WITH {REC}, c AS (
      SELECT concept, round(c, 6) + 0.0 AS score, 'similar' AS source FROM s WHERE c > 0.2
      UNION ALL SELECT concept, reliability, 'reliable' FROM rec WHERE reliability >= 0.9
      UNION ALL SELECT concept, mass / 12.0::DOUBLE, 'massive' FROM rec WHERE mass >= 10),
    m AS (SELECT concept, max(score) AS score, arg_max(source, (score, source)) AS source FROM c GROUP BY concept)
    SELECT concept, round(score, 6) AS score, source FROM m ORDER BY score DESC, concept LIMIT 20"""
)
def presentation_rank(spark, sf_dir):
    """Candidates from several sources, the best of each concept kept."""
    r, q = _base(spark, sf_dir)
    sim = R.with_query(r, q).select("concept", (F.round(V.cosine(F.col("q"), F.col("query")), 6) + 0.0).alias("score"), F.lit("similar").alias("source")).where("score > 0.2")
    rel = r.where("reliability >= 0.9").select("concept", F.col("reliability").alias("score"), F.lit("reliable").alias("source"))
    big = r.where("mass >= 10").select("concept", (F.col("mass") / 12.0).alias("score"), F.lit("massive").alias("source"))
    best = sim.unionByName(rel).unionByName(big).groupBy("concept").agg(F.max(F.struct("score", "source")).alias("m"))
    return best.select("concept", F.round("m.score", 6).alias("score"), "m.source").orderBy(F.desc("score"), "concept").limit(20)


@query(
    f"""WITH {REC}, b AS (SELECT concept, CASE vec_id % 5 WHEN 0 THEN 0.94 WHEN 1 THEN 0.88 WHEN 2 THEN 0.80 WHEN 3 THEN 0.78 ELSE 0.86 END AS base, reliability, drift, mass, vec_id FROM rec),
    t AS (SELECT *, base + 0.04 * (reliability - 0.85) - least(drift * 0.15, 0.12) + least(mass * 0.01, 0.05) - least(vec_id / 720.0 * 0.05, 0.05) AS s FROM b)
    SELECT concept, round(CASE WHEN vec_id % 50 = 0 THEN 1.0 ELSE greatest(0.74, least(0.99, s)) END, 6) AS reliability,
      round(greatest(0.40, greatest(0.74, least(0.99, reliability - least(drift * 0.15, 0.12))) - drift * 0.1), 6) AS after_dead_end FROM t"""
)
def reliability_dynamic(spark, sf_dir):
    i = F.col("vec_id")
    role = F.when(i % 5 == 0, "session_handoff").when(i % 5 == 1, "thought_tile").when(i % 5 == 2, "relation").when(i % 5 == 3, "lexicon").otherwise("other")
    s = S.reliability(S.role_base(role), F.col("reliability"), F.col("drift"), F.col("mass"), i, i % 50 == 0)
    return records(spark, sf_dir).select("concept", F.round(s, 6).alias("new"), F.round(S.reliability_after_dead_end(F.col("reliability"), F.col("drift")), 6).alias("after_dead_end")).withColumnRenamed("new", "reliability")


@query(
    f"""WITH {REC}, f AS (SELECT vec_id, vec_id % 2 = 0 AS g, vec_id % 3 = 0 AS m, vec_id % 5 AS n, vec_id % 7 > 2 AS c, vec_id % 4 > 0 AS i, vec_id % 9 > 0 AS r, reliability FROM rec),
    fs AS (SELECT *, greatest(0.0, least(1.0, 0.25 * g::INT + 0.25 * CASE WHEN m THEN 0.5 + 0.5 * least(n / 3.0, 1.0) ELSE 0.25 * least(n / 3.0, 1.0) END + 0.15 * c::INT + 0.20 * (i::INT + r::INT) / 2.0 + 0.15 * greatest(0.0, least(1.0, (reliability - 0.74) / 0.26)))) AS s FROM f),
    p AS (SELECT vec_id, least(1.0, 0.65 * reliability + 0.35 * 0.5) AS p FROM f)
    SELECT vec_id, round(s, 6) AS fidelity, CASE WHEN s >= 0.7 THEN '' ELSE coalesce(nullif(concat_ws(',', CASE WHEN NOT g THEN 'missing_goal' END, CASE WHEN NOT m THEN 'empty_manifest' END, CASE WHEN n = 0 THEN 'no_trusted_summaries' END, CASE WHEN NOT c THEN 'no_chain_head' END, CASE WHEN NOT i THEN 'index_not_ready' END, CASE WHEN NOT r THEN 'recall_not_ready' END), ''), 'low_hub_or_partial') END AS reasons,
      round(p, 6) AS pressure, greatest(30 - round(p * 12)::INT, 8) AS turns FROM fs JOIN p USING (vec_id)"""
)
def session_fidelity(spark, sf_dir):
    i = F.col("vec_id")
    f = records(spark, sf_dir).select("vec_id", "reliability", (i % 2 == 0).alias("g"), (i % 3 == 0).alias("m"), (i % 5).alias("n"), (i % 7 > 2).alias("c"), (i % 4 > 0).alias("i"), (i % 9 > 0).alias("r"))
    flags = [F.col(x) for x in "gmncir"]
    s = S.cold_start_fidelity(*flags, F.col("reliability"))
    p = S.pressure(F.col("reliability"), F.lit(0.5))
    return f.withColumn("s", s).select("vec_id", F.round("s", 6).alias("fidelity"), F.array_join(S.low_fidelity_reasons(F.col("s"), *flags), ",").alias("reasons"), F.round(p, 6).alias("pressure"), S.effective_turns(p).alias("turns"))




@query(f"WITH {REC} SELECT concept, reliability FROM rec ORDER BY reliability DESC, concept LIMIT 25 OFFSET 50")
def galaxy_page(spark, sf_dir):
    return R.page(records(spark, sf_dir).select("concept", "reliability"), 50, 25, F.desc("reliability"), F.col("concept"))
