"""Continuity of a session: wake digests, goal rebinding, leases, coherence, ranked actions, receipts.

All are column expressions or joins on keys; what is listed is bounded by the report (a top-k, a slot, a
fixed number of neighbours), never by the store.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .aggregate import beside, ranks_within

# Thresholds of alignment, surprise, promotion and consolidation.
ALIGNED = 0.08
FULL_SURPRISE = 0.5
PROMOTE_RELIABILITY = 0.74
STALE_DRIFT = 0.15


def overlap(a: Column, b: Column) -> Column:
    return T.overlap(T.tokens(a), T.tokens(b))


def goal_aligned(intent: Column, goal: Column) -> Column:
    """Whether an intent fits the standing goal: by shared tokens, or because it names the goal or its last part."""
    low, named = F.lower(intent), F.lower(goal)
    return (intent == "") | (goal == "") | (overlap(intent, goal) >= ALIGNED) | low.contains(named) | low.contains(F.substring_index(named, ":", -1))


def digest_warnings(aligned: Column, mode: Column, large: Column) -> Column:
    bounded = mode.contains("sampled") | (mode == "linear") | mode.contains("bounded")
    return F.array_compact(F.array(F.when(~aligned, "intent_differs_from_goal"), F.when(large & bounded, F.concat(F.lit("recall_"), mode))))


def wake_digest(sessions: DataFrame, scars: DataFrame, actions: DataFrame) -> DataFrame:
    """``session, aligned, warnings, top_actions, top_scars``: three actions by priority, the two scars nearest to the intent.

    ``sessions``: session, intent, goal, mode, large. ``scars`` (concept, preview) are the few open ones and
    ``actions`` (name, priority) the few suggested ones of a report; each is one row when broadcast.
    """
    first = actions.orderBy("priority", "name").limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "name"))), lambda x: x["name"]).alias("top_actions"))
    few = scars.limit(5).agg(F.collect_list(F.struct("concept", "preview")).alias("_scars"))
    s = sessions.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(few))  # one row each
    aligned = goal_aligned(F.col("intent"), F.col("goal"))
    score = lambda x: F.when(F.col("intent") == "", 1.0).otherwise(overlap(F.col("intent"), F.concat_ws(" ", x["concept"], x["preview"])))
    near = F.transform(F.slice(F.array_sort(F.transform("_scars", lambda x: F.struct((-score(x)).alias("k"), x["concept"].alias("c")))), 1, 2), lambda x: x["c"])
    return s.select("session", aligned.alias("aligned"), digest_warnings(aligned, F.col("mode"), F.col("large")).alias("warnings"), "top_actions", near.alias("top_scars"))


def rebind(mode: Column, intent: Column, sticky: Column, handoff: Column) -> Column:
    """``decision, goal``: keep the standing goal, take the handed-over one, or suggest it."""
    other = (handoff != "") & (handoff != sticky)
    better = other & goal_aligned(intent, handoff) & (overlap(intent, handoff) > overlap(intent, sticky))
    keep = (mode == "off") | (sticky == "") | goal_aligned(intent, sticky)
    decision = F.when(keep, "none").when((mode == "auto") & better, "auto").otherwise("suggest")
    return F.struct(decision.alias("decision"), F.when(~keep & other, handoff).alias("goal"))


# ---- leases ---------------------------------------------------------------------------------


def _held(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Requests (concept, agent, at) with ``holder``, if a lease (concept, holder, expires) is still alive then."""
    l = leases.select("concept", "holder", "expires")
    j = requests.join(l, "concept", "left")
    return j.withColumn("holder", F.when(F.col("expires") > F.col("at"), F.col("holder"))).drop("expires")


def released(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """What becomes of requests to release: only the holder may; without a live lease there is nothing to do."""
    h = F.col("holder")
    return _held(requests, leases).withColumn("outcome", F.when(h.isNull(), "no_lease").when(h == F.col("agent"), "released").otherwise("not_holder"))


def write_checks(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Whether writes are allowed; a write against another's live lease is refused and becomes a conflict row."""
    h = _held(requests, leases)
    refused = F.col("holder").isNotNull() & (F.col("holder") != F.col("agent"))
    return h.withColumn("allowed", ~refused).withColumn("conflict", F.when(refused, F.concat(F.lit("conflict:"), "concept", F.lit("-"), F.col("at").cast("string"))))


# ---- coherence ------------------------------------------------------------------------------


def coherence(q: Column, encoded: Column) -> Column:
    """How well a vector still stands for its text: the cosine with the text's encoding, 0 at least."""
    return F.greatest(F.lit(0.0), V.cosine(q, encoded))


def update_coherence(mode: Column, q: Column, new: Column, encoded: Column) -> Column:
    """Appending is checked after the vectors are added, replacing before."""
    return F.when(mode == "append", coherence(V.normalise(V.add(q, new)), encoded)).otherwise(coherence(q, encoded))


# ---- ranks and scores -----------------------------------------------------------------------


def action_rank(nudge: Column, reason: Column, concept: Column, priority: Column, injection: Column) -> Column:
    """Fixed ranks by reason, else the concept's injection score, else what its priority gives."""
    return (
        F.when(nudge, 100.0)
        .when(reason.contains("portable rehydration manifest"), 95.0)
        .when(reason.contains("manifest primary_goal"), 90.0)
        .when(reason.contains("manifest trace_chain_head"), 85.0)
        .when(concept == "", 0.05 + 1.0 / (1.0 + priority))
        .otherwise(injection)
    )


def ranked_actions(actions: DataFrame, by: str) -> DataFrame:
    """``actions`` (with ``rank`` and ``name``) renumbered from 1 within each report ``by``."""
    return ranks_within(actions, by, [F.desc("rank"), F.asc("name")], "priority")


def open_scars(rows: DataFrame, recent: DataFrame, most: int = 5) -> DataFrame:
    """Reliable ``scar:`` rows: of the 96 last accessed (concept, ts) the newest, or any if none of those is one."""
    own = rows.where(F.col("concept").startswith("scar:") & (F.col("reliability") >= 0.5))
    last = recent.groupBy("concept").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "concept").limit(96)
    new = own.join(F.broadcast(last), "concept").withColumn("source", F.lit("recent"))
    any_ = own.withColumn("ts", F.lit(None).cast("long")).withColumn("source", F.lit("prefix"))
    both = new.select("concept", "reliability", "ts", "source").unionByName(any_.select("concept", "reliability", "ts", "source"))
    top = both.orderBy(F.desc("source"), F.desc_nulls_last("ts"), "concept").limit(most)
    first = both.agg(F.max("source").alias("_best"))  # one row
    return top.crossJoin(F.broadcast(first)).where(F.col("source") == F.col("_best")).drop("_best")


def completeness(slots: dict[str, Column]) -> Column:
    """``score, filled, missing`` of named slots."""
    flags = [F.when(c, 0).otherwise(1) for c in slots.values()]
    gaps = sum(flags[1:], flags[0])
    n = len(slots)
    return F.struct(((n - gaps) / float(n)).alias("score"), (n - gaps).alias("filled"), F.array_compact(F.array(*[F.when(~c, k) for k, c in slots.items()])).alias("missing"))


def surprise(residuals: Column) -> Column:
    """The mean of the positive residuals against full scale, 0 to 1; an aggregate."""
    return F.least(F.lit(1.0), F.coalesce(F.avg(F.when(residuals > 0, residuals)), F.lit(0.0)) / FULL_SURPRISE)


def boosted(reliability: Column, score: Column) -> Column:
    return reliability * 0.55 + score * 0.45


def score_summary(rows: DataFrame, most: int = 4) -> DataFrame:
    """``high, mean, top`` of ``rows`` (concept, score): how many are above 0.7, the mean, the best few."""
    top = rows.orderBy(F.desc("score"), "concept").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "concept"))), lambda x: x["concept"]).alias("top"))
    return rows.agg(F.count_if(F.col("score") > 0.7).alias("high"), F.coalesce(F.avg("score"), F.lit(0.5)).alias("mean")).crossJoin(top)  # one row each


def promotion_reasons(reliability: Column, violations: Column, recalls: Column) -> Column:
    """Why a scaffold may not be promoted; empty if it may."""
    return F.array_compact(F.array(F.when(reliability < PROMOTE_RELIABILITY, "reliability"), F.when(violations > 0, "writes_without_prior_recall"), F.when(recalls < 1, "no_recall")))


def draft_outcome(draft: Column, passed: Column, pin: Column) -> Column:
    """``status, name`` of a skill draft that is to be promoted."""
    bare = F.regexp_replace(draft, "^skill_draft:", "")
    status = F.when(~draft.startswith("skill_draft:"), "not_a_draft").when(~passed, "scarred").when(pin, "pinned").otherwise("promoted_pending_pin")
    name = F.when(status == "scarred", F.concat(F.lit("scar:skill_draft_failed_"), bare)).when(status != "not_a_draft", F.concat(F.lit("receipt:skill_promote_"), bare))
    return F.struct(status.alias("status"), name.alias("name"))


# ---- derived rows ---------------------------------------------------------------------------


def derivatives(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scrubbed copies of ``rows`` (concept, body, reliability) under names of their digest, and the edges to them."""
    clean = T.scrub(F.col("body"))["text"]
    head = F.concat(F.lit("# Scrubbed training derivative\n\n**source:** "), "concept", F.lit("\n**sovereignty:** training_ok\n**export_policy:** scrub_then_allow\n\n"))
    d = rows.select(F.col("concept").alias("source"), F.concat(head, clean).alias("body"), F.least("reliability", F.lit(0.95)).alias("reliability"))
    d = d.withColumn("concept", F.concat(F.lit("pattern:export_"), F.substring(F.sha2("body", 256), 1, 16)))
    return d, d.select(F.col("source").alias("src"), F.lit("scrub_exported_to").alias("label"), F.col("concept").alias("dst"))


def drift_notes(rows: DataFrame) -> DataFrame:
    """Entries that drifted too far get a note appended and are promoted. ``rows``: concept, body, drift."""
    note = F.concat(F.col("body"), F.lit("\n\n[solid-tensor-consolidation OP_ADD p_drift="), F.format_number("drift", 3), F.lit("]"))
    return rows.where(F.col("drift") >= STALE_DRIFT).select("concept", note.alias("body"), F.lit(True).alias("promoted"))


def episodics(turns: DataFrame, facts: Column) -> tuple[DataFrame, DataFrame]:
    """A row for each fact of a turn (session, turn), and the edges from the session to it."""
    rows = turns.select("session", "turn", F.posexplode(facts).alias("k", "body"))
    rows = rows.select(F.concat_ws("_", F.concat(F.lit("episodic:"), F.col("session").cast("string")), F.col("turn").cast("string"), F.col("k").cast("string")).alias("concept"), "body", "session")
    return rows, rows.select(F.concat(F.lit("session:"), F.col("session").cast("string")).alias("src"), F.lit("recorded").alias("label"), F.col("concept").alias("dst"))


def auto_related(new: DataFrame, goal: str = "primary_goal") -> DataFrame:
    """An edge from the goal to each new concept."""
    return new.select(F.lit(goal).alias("src"), F.lit("documents").alias("label"), F.col("concept").alias("dst"))


def glued(items: DataFrame) -> DataFrame:
    """Items of one file, in order, each linked to the next. ``items``: concept, file, start. As many edges as items."""
    near = beside(items.select("concept", "file", "start"), "file", [F.asc("start"), F.asc("concept")], 1, dst="concept")
    return near.where("dst is not null").select(F.col("concept").alias("src"), F.lit("same_file").alias("label"), "dst")


def fetch_or_encode(asked: DataFrame, stored: DataFrame, encoded: DataFrame) -> DataFrame:
    """``concept, q, fetched``: the stored vector of each asked name, else the encoding of the name itself."""
    a = asked.join(stored.select("concept", F.col("q").alias("_q")), "concept", "left").join(encoded.select("concept", F.col("q").alias("_e")), "concept", "left")
    return a.select("concept", F.coalesce("_q", "_e").alias("q"), F.col("_q").isNotNull().alias("fetched"))


def tiered(version: Column, tier: Column) -> Column:
    """A schema number with the tier in its high byte."""
    return F.shiftleft(tier.cast("int"), 24).bitwiseOR(version.bitwiseAND(F.lit(0x00FFFFFF)))


def anchored(q: Column, shadow: Column) -> Column:
    """``q`` drawn towards a shorter vector in its first components, at unit length."""
    return V.normalise(F.transform(q, lambda x, i: x + F.coalesce(F.get(shadow, i), F.lit(0.0))))


def sentinel_turns(events: DataFrame, by: str, order: list[str], handoff: Column) -> DataFrame:
    """``events`` with ``turns``, those since the last handoff of the key, the handoff itself being 0."""
    w = Window.partitionBy(by).orderBy(*order)
    run = F.sum(F.when(handoff, 1).otherwise(0)).over(w)
    x = events.withColumn("_run", run)
    return x.withColumn("turns", F.row_number().over(Window.partitionBy(by, "_run").orderBy(*order)) - F.when(F.col("_run") > 0, 1).otherwise(0)).drop("_run")


# ---- parsing --------------------------------------------------------------------------------


def pin_token(query: Column) -> Column:
    """The first word of a query that names a tensor entry, without the punctuation around it."""
    words = F.transform(F.split(F.trim(query), r"[\s,;]+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[^\p{L}\p{N}:_-]+", ""), r"[^\p{L}\p{N}:_-]+$", ""))
    return F.get(F.filter(words, lambda w: w.rlike("^(tensor|design|tile):")), F.lit(0))


def scout_key(query: Column, ts: Column) -> Column:
    bare = F.substring(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.concat_ws("__", F.lit("scout"), ts.cast("string"), bare)


def _json_between(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def packet(body: Column) -> Column:
    """The JSON of the latest handoff packet in a grown body, or null."""
    last = F.element_at(F.filter(F.split(body, "SESSION HANDOFF PACKET"), lambda s: s.contains("{")), -1)
    parsed = lambda t: F.when(F.try_parse_json(_json_between(t)).isNotNull(), _json_between(t))
    return F.when(body.contains("{"), F.coalesce(parsed(last), parsed(body)))


def rehydration(body: Column) -> Column:
    """The JSON of a rehydration manifest, if it says that it is one."""
    j = _json_between(body)
    known = (F.get_json_object(j, "$.version") == "rehydration_manifest_v1") | F.get_json_object(j, "$.manifest_concept").startswith("manifest:rehydration_")
    return F.when(F.coalesce(known, F.lit(False)), j)


def embedded_metrics(body: Column) -> Column:
    return F.get_json_object(_json_between(body), "$.metamemory")


def next_vector(summary: Column) -> Column:
    """The next step a handoff names: as a JSON field, under a heading, or on a line of its own, in this order."""
    ok = lambda v: F.when((F.octet_length(F.trim(v)) >= 3) & ~F.trim(v).rlike(r"^[,*;]") & v.rlike(r"[\p{L}\p{N}]"), v)
    field = F.regexp_extract(summary, r'(?i)"next_vector"\s*:\s*"([^"\n]+)"', 1)
    under = F.regexp_extract(summary, r"(?im)^\s*#+\s*[*`]*next[_ ]vector[*`]*:?\s*$\s*^(?!\s*#)\s*[-*+]*\s*[`\"]*([^\n]*?)[`\"]*\s*$", 1)
    line = F.regexp_extract(summary, r"(?im)^\s*[-*+]*\s*\**\s*next[_ ]vector:\s*\**\s*[*`\"]*([^\n]*?)[*`\"]*\s*$", 1)
    return F.coalesce(ok(field), ok(under), ok(line))


def etymology(note: Column, ts: Column) -> Column:
    return F.concat(F.lit("--- etymology @ "), ts.cast("string"), F.lit(" ---\netymology: "), note)


def without_tools(actions: DataFrame, avoided: list[str]) -> DataFrame:
    """Actions but for those of the listed tools; an action without a tool stays."""
    return actions.where(F.col("tool").isNull() | ~F.col("tool").isin(*avoided))


def few_neighbours(edges: DataFrame, slots: DataFrame, most_slots: int = 16, most: int = 8) -> DataFrame:
    """``slot, label, other``: of at most so many slots (slot, rank) at most so many edges each."""
    kept = slots.orderBy("rank", "slot").limit(most_slots).select("slot")
    e = edges.join(F.broadcast(kept), edges["src"] == kept["slot"])
    w = Window.partitionBy("slot").orderBy("label", "dst")
    return e.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("slot", "label", F.col("dst").alias("other"))


# ---- lists of a report ----------------------------------------------------------------------


def recent(access: DataFrame, most: int) -> DataFrame:
    """The last accessed names (concept, ts), the newest first."""
    last = access.groupBy("concept").agg(F.max("ts").alias("ts"))
    return last.orderBy(F.desc("ts"), "concept").limit(most)


def uncertainty_receipts(rows: DataFrame, access: DataFrame, near: DataFrame, most: int) -> DataFrame:
    """``uncertainty:`` rows: those among the last 200 accessed first, then those a recall found (concept, score),
    at least 4 in all if there are so many. ``rows``: concept, reliability."""
    own = rows.where(F.col("concept").startswith("uncertainty:"))
    a = own.join(F.broadcast(recent(access, 200)), "concept").select("concept", "reliability", F.lit(0).alias("source"), (-F.col("ts")).cast("double").alias("k"))
    b = own.join(near.select("concept", "score"), "concept").select("concept", "reliability", F.lit(1).alias("source"), (-F.col("score")).cast("double").alias("k"))
    first = a.unionByName(b).groupBy("concept").agg(F.min_by(F.struct("reliability", "source", "k"), F.struct("source", "k")).alias("x")).select("concept", "x.*")
    return first.orderBy("source", "k", "concept").limit(max(most, 4)).select("concept", "reliability", "source")


def active_groups(rows: DataFrame, access: DataFrame, most: int = 25) -> DataFrame:
    """``kind, concepts`` of the last accessed names: tiles, traces and goals, the newest first."""
    c = F.col("concept")
    kind = F.when(c.startswith("tile:"), "tiles").when(c.startswith("trace:"), "traces").when(c.startswith("goal:") | (c == "primary_goal"), "goals")
    r = recent(access, most).join(rows.select("concept"), "concept", "left_semi").withColumn("kind", kind).where("kind is not null")
    return r.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ts")).alias("k"), "concept"))), lambda x: x["concept"]).alias("concepts"))


def hotspots(traces: DataFrame, items: DataFrame, most: int = 24) -> DataFrame:
    """The newest located rows: traces (concept, ts, file, line) and items of source (concept, ts, file, line)."""
    both = traces.withColumn("kind", F.lit("trace")).unionByName(items.withColumn("kind", F.lit("item"))).where("file <> ''")
    return both.orderBy(F.desc("ts"), "concept").limit(most).select("concept", "kind", "file", "line", "ts")


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def external_pointer(uri: Column, content_hash: Column, size: Column, metadata: Column) -> Column:
    """The name, descriptor and reliability of a row that points to data elsewhere."""
    text = F.concat(F.lit("EXTERNAL_POINTER_V1\nuri: "), uri, F.lit("\ncontent_hash: "), content_hash, F.lit("\nsize_bytes: "), size.cast("string"), F.lit("\nmetadata: "), F.when(metadata == "", "{}").otherwise(metadata), F.lit("\n"))
    return F.struct(F.concat(F.lit("pointer:"), T.slug(F.substring_index(uri, "/", -1), 48)).alias("concept"), text.alias("body"), F.lit(0.91).alias("reliability"))


# ---- words ----------------------------------------------------------------------------------


def symbolic(z: V.Z) -> V.Z:
    """Phases from each component's angle, times its place, plus its length; at unit length."""
    angle = F.zip_with(z.im, z.re, lambda i, r: F.atan2(i, r))
    length = F.zip_with(z.re, z.im, lambda r, i: F.sqrt(r * r + i * i))
    phase = F.zip_with(F.transform(angle, lambda a, k: a * k), length, lambda a, n: a + n)
    return V.zunit(V.Z(F.transform(phase, lambda p: F.cos(p)), F.transform(phase, lambda p: F.sin(p))))


def compressed(words: DataFrame, by: str, coeff: str, re: str, im: str) -> DataFrame:
    """``by, re, im``: half of each word's coefficients bound with its phases, summed over the bundle, at unit length.

    ``words``: a row for each word of a bundle, its coefficients padded to the width of its phase vector.
    """
    n = words.select(by, F.posexplode(F.arrays_zip(F.col(coeff).alias("c"), F.col(re).alias("r"), F.col(im).alias("i"))).alias("k", "x"))
    s = n.groupBy(by, "k").agg(F.sum(F.col("x.c") * F.col("x.r") * 0.5).alias("re"), F.sum(F.col("x.c") * F.col("x.i") * 0.5).alias("im"))
    g = s.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("v"))  # as many as the width
    z = V.zunit(V.Z(F.transform("v", lambda x: x["re"]), F.transform("v", lambda x: x["im"])))
    return g.select(by, z.re.alias("re"), z.im.alias("im"))


def equivalence(a: V.Z, b: V.Z) -> Column:
    """The cosine of two compressed bundles: how far two presentations say the same."""
    return V.dot(a.re, b.re) + V.dot(a.im, b.im)


def lexicon_entry(word: V.Z, definition: V.Z, note: V.Z) -> V.Z:
    """A word bound with its definition and its history; unbinding gives either back."""
    return V.bind(V.bind(word, definition), note)


def lexicon_upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (word, body) with new ones: an unknown word is added, a known one's body grows by the new note."""
    n = new.select("word", F.col("body").alias("_new"))
    both = entries.join(n, "word", "full_outer")
    body = F.when(F.col("body").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("body")).otherwise(F.concat("body", F.lit("\n"), "_new"))
    return both.select("word", body.alias("body"), F.when(F.col("body").isNull(), "minted").when(F.col("_new").isNull(), "kept").otherwise("updated").alias("status"))


# ---- clocks and places ----------------------------------------------------------------------

#: Turns and minutes after which a session is due for a handoff.
MAX_TURNS, MAX_MINUTES = 30, 120


def sentinel_clock(events: DataFrame, by: str, order: list[str], ts: str, handoff: Column) -> DataFrame:
    """``events`` with ``turns`` and whole ``minutes`` since the key's last handoff (0 minutes before any), and whether one is ``due``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    last = F.last(F.when(handoff, micros), ignorenulls=True).over(w)
    x = sentinel_turns(events.withColumn("_last", last), by, order, handoff)
    minutes = F.coalesce(F.greatest(F.floor((micros - F.col("_last")) / 60_000_000), F.lit(0)), F.lit(0)).cast("long")
    return x.withColumn("minutes", minutes).withColumn("due", (F.col("turns") >= MAX_TURNS) | (F.col("minutes") >= MAX_MINUTES)).drop("_last")


#: The factors of the hash that places a concept.
FRAME_FACTOR, BYTE_FACTOR = 0x9E3779B97F4A7C15, 0x0100000001B3


def place(concept: Column, frame: int = 0) -> Column:
    """``lat, lng`` (radians) of a concept that is bound to no place: from a 64-bit hash of its bytes and the frame's number."""
    whole, room = F.lit(str(1 << 64)).cast("decimal(20,0)"), "decimal(20,0)"
    code = F.transform(F.filter(F.split(F.hex(F.encode(concept, "UTF-8")), "(?<=\\G..)"), lambda b: b != ""), lambda b: F.conv(b, 16, 10).cast("decimal(3,0)"))
    start = F.lit(str(frame * FRAME_FACTOR % (1 << 64))).cast(room)
    h = F.aggregate(code, start, lambda s, b: F.pmod((s * F.lit(BYTE_FACTOR).cast("decimal(14,0)")).cast("decimal(37,0)") + b, whole).cast(room))
    turn = lambda x: F.pmod(x, F.lit(628)).cast("double") / 100.0
    lat = F.sin(turn(h) - F.lit(math.pi / 2)) * 0.88
    lng = turn(F.floor(h / F.lit(65536))) * F.lit(2 * math.pi) - F.lit(math.pi)
    return F.when(concept.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))
