"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, exact_dedup, licenses, main_text, media, mixing, negatives, pieces, quality, simhash, suffix_dedup, token_store, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(_read(spark, sf_dir, "documents"))


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_copies(media.pictured(_read(spark, sf_dir, "embeddings")))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(_read(spark, sf_dir, "documents"))
    return out.withColumn("containment", F.round("containment", 6))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.fit_quality(docs, labels))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_read(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_media_copies": op2_media_copies,
    "op3_pieces": op3_pieces,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_main_text": op12_main_text,
    "op13_alignment": op13_alignment,
}

_TEMPLATE_ROWS = ", ".join("('{}', '{}', '{}')".format(*t) for t in licenses.TEMPLATES)

ORACLE_SQL: dict[str, str] = {
    "op6_licenses": rf"""
        WITH t AS (SELECT template, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_TEMPLATE_ROWS}) AS x(template, license, text)),
        ts AS (SELECT DISTINCT template, license, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t)),
        n AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
        d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
        ds AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
        m AS (SELECT doc_id, template, license, count(DISTINCT s) AS n_matched, min(i) - 1 AS first_word FROM ds JOIN ts USING (s) GROUP BY ALL)
        SELECT doc_id, template, license, n_matched, round(n_matched / n, 6) AS containment, first_word FROM m JOIN n USING (template) WHERE n_matched / n >= 0.8""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS row
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.row AS anchor, a.label AS own, b.vec_id, b.row, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS k FROM s WHERE label = own AND row <> anchor QUALIFY k <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.k, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id, s.row) AS rank
          FROM p JOIN s ON s.anchor = p.anchor AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, k::INT AS positive_rank FROM n""",
}
