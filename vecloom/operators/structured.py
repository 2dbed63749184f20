"""Structured queries over record metadata: predicates, then order, then limit."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """All given conditions must hold. ``related_to`` keeps the seed and what an edge joins to it."""

    prefix: str | None = None
    least: float | None = None
    most: float | None = None
    stem: str | None = None
    path_contains: str | None = None
    related_to: str | None = None
    label: str | None = None
    direction: str = "both"
    order: str = "reliability"
    limit: int = 20

    @staticmethod
    def of(spec: dict) -> Query:
        """From loose JSON-like input: unknown keys are ignored, the limit is kept within 1..200."""
        known = {k: v for k, v in spec.items() if k in Query.__dataclass_fields__ and v is not None}
        known["limit"] = max(1, min(200, int(known.get("limit", 20))))
        if known.get("order") not in (None, "reliability", "recency"):
            known.pop("order")
        return Query(**known)


def stem_of(path: Column) -> Column:
    """File name before its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def related(edges: DataFrame, seed: str, label: str | None, direction: str) -> DataFrame:
    """``concept``: the seed and its neighbours."""
    e = edges if label is None else edges.where(F.col("label") == label)
    out = e.where(F.col("src") == seed).select(F.col("dst").alias("concept"))
    back = e.where(F.col("dst") == seed).select(F.col("src").alias("concept"))
    parts = {"out": out, "in": back}.get(direction, out.union(back))
    return parts.union(edges.sparkSession.createDataFrame([(seed,)], "concept string")).distinct()


def run(rows: DataFrame, q: Query, edges: DataFrame | None = None) -> DataFrame:
    """``rows``: concept, reliability, recency, path. Ties go by concept."""
    if q.prefix:
        rows = rows.where(F.col("concept").startswith(q.prefix))
    if q.least is not None:
        rows = rows.where(F.col("reliability") >= q.least)
    if q.most is not None:
        rows = rows.where(F.col("reliability") <= q.most)
    if q.stem:
        rows = rows.where((stem_of(F.col("path")) == q.stem) | F.col("concept").contains(q.stem))
    if q.path_contains:
        rows = rows.where(F.col("path").contains(q.path_contains))
    if q.related_to and edges is not None:
        rows = rows.join(related(edges, q.related_to, q.label, q.direction), "concept", "left_semi")
    return rows.orderBy(F.desc(q.order), "concept").limit(q.limit)


def glob_to_regex(pattern: str) -> str:
    """``*`` matches anything; the rest is literal."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def glob(column: Column, pattern: str) -> Column:
    return column == pattern if "*" not in pattern else column.rlike(glob_to_regex(pattern))


#: Prefixes that may be shown on the surface.
SURFACE = (
    "goal:", "trace:", "tile:", "helper:", "handoff:", "session_end_", "session_start_", "compression_intent_", "compression_handoff_", "manifest:", "uncertainty:",
    "receipt:session_", "process:", "ritual:", "praxis:", "scar:", "local:", "host:", "env:", "tensor:", "design:",
)


def surface(concept: Column) -> Column:
    return (concept == "primary_goal") | concept.rlike("^(" + "|".join(SURFACE) + ")")


def kind_of(concept: Column) -> Column:
    return F.when(concept.contains(":"), F.substring_index(concept, ":", 1)).otherwise("plain")


def file_transform_allowed(dsl: Column, op: str) -> Column:
    """Contracts of version 0 allow all; else the list must name the operation or ``full``."""
    version, names = F.substring_index(dsl, ":", 1), F.transform(F.split(F.substring_index(dsl, ":", -1), r"\|"), F.trim)
    return (version == "0") | F.array_contains(names, op) | F.array_contains(names, "full")


def visible_in_branch(rows: DataFrame, tags: DataFrame, branch: str) -> DataFrame:
    """Rows without a branch tag, or with that of ``branch``."""
    t = tags.select("concept", F.col("branch").alias("_branch"))
    return rows.join(t, "concept", "left").where(F.col("_branch").isNull() | (F.col("_branch") == branch)).drop("_branch")


def foreign_filtered(rows: DataFrame, foreign: DataFrame, accepted: DataFrame) -> DataFrame:
    return rows.join(foreign.join(accepted, "concept", "left_anti"), "concept", "left_anti")
