"""Score and rule functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# ---- recall -------------------------------------------------------------------------------


def precision_weight(reliability: Column, stability: Column) -> Column:
    return clamp(clamp(reliability) * clamp(stability), 0.05, 1.0)


def band_count(length: Column) -> Column:
    return F.when(length < 0.5, 4).when(length < 1.5, 8).otherwise(16)


def banded_precision(residual: Column, length: Column) -> Column:
    """Mean of 1 / (1 + |r|) over the bands, damped by the residual's length; 1 without a residual."""
    n = band_count(length)
    acc = F.aggregate(F.slice(residual, F.lit(1), n), F.lit(0.0), lambda a, r: a + 1 / (1 + F.abs(r)))
    return F.when(length <= 1e-8, 1.0).otherwise(clamp(acc / n / (1 + clamp(length, 0.0, 10.0)), 0.05, 1.0))


def strided_precision(q: Column, frame: Column | None, width: int, dims: int = 32, length: Column | None = None) -> Column:
    """The same over ``dims`` strided components of the distance to the frame vector."""
    step = width // dims
    diff = lambda i: F.abs(F.get(q, i * step) - (F.get(frame, i * step) if frame is not None else 0.0))
    acc = F.aggregate(F.sequence(F.lit(0), F.lit(dims - 1)), F.lit(0.0), lambda a, i: a + 1 / (1 + diff(i)))
    damp = F.lit(1.0) if length is None else F.when(length > 1e-8, 1 / (1 + 0.25 * clamp(length, 0.0, 10.0))).otherwise(1.0)
    return clamp(acc / dims * damp, 0.05, 1.0)


def ranked_score(similarity: Column, reliability: Column, drift: Column, mass: Column, weight: Column | None, frame_similarity: Column | None = None) -> Column:
    """The multi-factor score; ``weight`` None leaves precision out."""
    s = (similarity + 1) / 2
    stability = clamp(1 - drift)
    depth = F.least(mass, F.lit(10)) / 10.0
    frame = stability if frame_similarity is None else 0.6 * stability + 0.4 * (frame_similarity + 1) / 2
    if weight is None:
        return 0.74 * s + 0.14 * reliability + 0.10 * frame + 0.02 * depth
    return 0.62 * s + 0.12 * s * weight + 0.14 * reliability + 0.10 * frame + 0.02 * depth


def volatility_damp(volatility: Column) -> Column:
    return F.when(volatility <= 0, 1.0).otherwise(1 / (1 + 0.35 * clamp(volatility, 0.01, 1.0)))


def damp_exempt(concept: Column) -> Column:
    return (concept == "primary_goal") | concept.startswith("scar:") | concept.startswith("helper:session_handoff") | concept.startswith("compression_handoff_")


def damped(score: Column, volatility: Column, concept: Column) -> Column:
    return F.when(damp_exempt(concept), score).otherwise(score * volatility_damp(volatility))


def momentum_score(q_score: Column, p_score: Column, volatility: Column | None = None, concept: Column | None = None) -> Column:
    base = clamp(0.8 * q_score + 0.2 * p_score, -1.0, 1.0)
    return base if volatility is None else clamp(damped(base, volatility, concept), -1.0, 1.0)


def injection_score(reliability: Column, hot: Column, recency_rank: Column, momentum: Column, dead_end: Column, handoff: Column, anchor: Column, volatility: Column) -> Column:
    extra = F.when(dead_end, 0.36).when(handoff, 0.22).when(anchor, 0.18).otherwise(0.0)
    base = clamp(reliability) * 0.35 + F.when(hot, 0.18).otherwise(0.0) + 0.12 / (1 + recency_rank) + clamp(momentum) * 0.15 + extra
    return clamp(F.when(dead_end | handoff | anchor, base).otherwise(base * volatility_damp(volatility)), 0.0, 1.5)


def recency_boost(age_seconds: Column) -> Column:
    """Null age (never accessed) earns nothing."""
    return F.when(age_seconds.isNull(), 0.0).when(age_seconds < 3600, 0.12).when(age_seconds < 86_400, 0.06).when(age_seconds < 604_800, 0.02).otherwise(0.0)


#: Bonus by summary type.
TYPE_BONUS = {"verified_sequence": 0.28, "state_machine": 0.24, "formal_spec": 0.20, "chain_summary": 0.18, "progress": 0.14, "knowledge_graph": 0.14}


def type_bonus(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_BONUS.items() for x in kv])[kind], F.lit(0.0))


def goal_distance(concept: Column) -> Column:
    """0 for goals to 6 for local facts, by prefix."""
    starts = lambda *p: concept.rlike("^(" + "|".join(p) + ")")
    return (
        F.when((concept == "primary_goal") | starts("goal:"), 0)
        .when(starts("helper:session_", "process:", "ritual:", "trace:", "manifest:", "tile:session_boundary"), 1)
        .when(starts("tile:", "scar:"), 2)
        .when(starts("metric:", "receipt:"), 5)
        .when(starts("local:", "geo_context:"), 6)
        .otherwise(3)
    )


def _distance_share(d: Column) -> Column:
    return F.when(d == 0, 1.0).when(d == 1, 0.7).when(d == 2, 0.5).when(d == 3, 0.3).when(d == 4, 0.2).otherwise(0.1)


def promote_score(reliability: Column, idle_seconds: Column, distance: Column, pressed: Column) -> Column:
    recent = clamp(F.exp(-idle_seconds / 3600.0)) * 0.30
    return clamp(reliability) * 0.40 + recent + _distance_share(distance) * 0.20 + F.when(pressed, 0.05).otherwise(0.10)


def demote_priority(reliability: Column, idle_seconds: Column, distance: Column) -> Column:
    """High for what is unreliable, idle for a day and far from goals; for use under capacity pressure."""
    return (1 - clamp(reliability)) * 0.45 + F.least(idle_seconds / 86400.0, F.lit(1.0)) * 0.35 + F.least(distance / 10.0, F.lit(1.0)) * 0.20


def eviction_score(reliability: Column, age_seconds: Column, concept: Column) -> Column:
    kept = F.when(concept.rlike("^(trace|tile|helper|ritual):"), 0.4).otherwise(0.0)
    return reliability * 0.55 + 0.35 / (age_seconds + 1) + kept


def keyword_score(text: Column, concept: Column) -> Column:
    """A base, plus credit for reconciling, affirming and denying passages and for structured kinds, within 0.40..0.97."""
    low = F.lower(text)
    hits = F.regexp_count(low, F.lit("reconcile:")) + F.regexp_count(low, F.lit(r"\*\*reconcile\*\*")) + F.regexp_count(low, F.lit("reconcile "))
    has = lambda *w: F.when(low.rlike("|".join(w)), 1.0).otherwise(0.0)
    score = 0.48 + hits * 0.17 + 0.06 * has("affirm:", r"\*\*affirm\*\*") + 0.06 * has("deny:", r"\*\*deny\*\*")
    return clamp(score + F.when(concept.rlike("^(trace|tile|goal):"), 0.09).otherwise(0.0), 0.40, 0.97)


# ---- reliability --------------------------------------------------------------------------

#: Base reliability by role.
ROLE_BASE = {
    "session_handoff": 0.94, "rehydration_manifest": 0.92, "session_receipt": 0.93, "thought_tile": 0.88, "tensor_mirror": 0.85, "sentinel_state": 0.88, "operational": 0.86,
    "relation": 0.80, "dead_end_demotion": 0.70, "frame_remember": 0.74, "praxis": 0.95, "lexicon": 0.78, "research_dead_end": 0.78,
}
GATE = 0.74


def role_base(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_BASE.items() for x in kv])[role], F.lit(0.86))


def reliability(base: Column, frame: Column | None = None, residual: Column | None = None, confirmations: Column | None = None, age_hours: Column | None = None, pinned: Column | None = None) -> Column:
    s = clamp(base)
    if frame is not None:
        s = s + F.coalesce(0.04 * (clamp(frame) - 0.85), F.lit(0.0))
    if residual is not None:
        s = s - F.coalesce(F.least(F.greatest(residual, F.lit(0.0)) * 0.15, F.lit(0.12)), F.lit(0.0))
    if confirmations is not None:
        s = s + F.least(confirmations * 0.01, F.lit(0.05))
    if age_hours is not None:
        s = s - F.coalesce(F.least(F.greatest(age_hours, F.lit(0.0)) / 720.0 * 0.05, F.lit(0.05)), F.lit(0.0))
    s = clamp(s, GATE, 0.99)
    return s if pinned is None else F.when(pinned, 1.0).otherwise(s)


def reliability_after_dead_end(prior: Column, magnitude: Column, floor: float = 0.40) -> Column:
    m = clamp(magnitude)
    return F.greatest(reliability(clamp(prior), residual=m) - m * 0.1, F.lit(floor))


# ---- sessions -----------------------------------------------------------------------------


def cold_start_fidelity(goal: Column, manifest: Column, summaries: Column, chain: Column, index_ready: Column, recall_ready: Column, hub: Column) -> Column:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    share = clamp(summaries / 3.0)
    body = F.when(manifest, 0.5 + 0.5 * share).otherwise(0.25 * share)
    ready = (one(index_ready) + one(recall_ready)) / 2
    hubs = F.coalesce(clamp((clamp(hub) - 0.74) / 0.26), F.lit(0.5))
    return clamp(0.25 * one(goal) + 0.25 * body + 0.15 * one(chain) + 0.20 * ready + 0.15 * hubs)


def low_fidelity_reasons(score: Column, goal: Column, manifest: Column, summaries: Column, chain: Column, index_ready: Column, recall_ready: Column, threshold: float = 0.70) -> Column:
    why = {"missing_goal": ~goal, "empty_manifest": ~manifest, "no_trusted_summaries": summaries == 0, "no_chain_head": ~chain, "index_not_ready": ~index_ready, "recall_not_ready": ~recall_ready}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in why.items()]), lambda x: x.isNotNull())
    found = F.when(F.size(found) == 0, F.array(F.lit("low_hub_or_partial"))).otherwise(found)
    return F.when(score >= threshold, F.array().cast("array<string>")).otherwise(found)


def pressure(residual: Column, drift: Column, weight: float = 0.65) -> Column:
    return clamp(weight * clamp(residual) + (1 - weight) * clamp(F.coalesce(drift, F.lit(0.0))))


def effective_turns(p: Column, most: int = 30, cut: int = 12, least: int = 8) -> Column:
    return F.greatest(F.lit(most) - F.round(p * cut).cast("int"), F.lit(least))


def nudge(turns: Column, minutes: Column, p: Column, most: int = 30, most_minutes: int = 120) -> Column:
    over = turns >= effective_turns(p, most)
    return F.when(over & (p >= 0.5) & (turns < most), "surprise").when(over, "turns").when(minutes >= most_minutes, "time").otherwise("")
