"""Composed reports over named records: classifiers, anchors, rankings, loci, views, drafts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

# ---- classifiers ----------------------------------------------------------------------------


def node_kind(concept: Column) -> Column:
    return F.when(concept.startswith("tile:"), "tile").when(concept.startswith("trace:"), "trace").when(concept.rlike("^goal:|^primary_goal$"), "goal").when(concept.startswith("process:"), "process").otherwise("memory")


def category(concept: Column) -> Column:
    return F.when(concept.startswith("trace:"), "trace").when(concept.startswith("tile:"), "tile").when(concept.startswith("praxis"), "praxis").when(concept.startswith("scar:"), "dead_end").otherwise("other")


def tensor_eligible(concept: Column) -> Column:
    return concept.rlike("^(tensor|design|tile):")


def tensor_name(concept: Column) -> Column:
    return F.when(concept.contains(":"), concept).otherwise(F.concat(F.lit("tensor:"), concept))


def high_value(concept: Column) -> Column:
    return concept.rlike("^(tile:|trace:|handoff:|session_end_|compression_intent_|goal:)|^primary_goal$|ritual:")


def demo_noise(concept: Column) -> Column:
    return concept.rlike("^(tile:consciousness:live-demo:|world_state:snapshot:live:)")


def arc_stability(drifts: Column) -> Column:
    """Of the last two drifts: falling, rising or level."""
    a, b = F.element_at(drifts, -2), F.element_at(drifts, -1)
    return F.when((F.size(drifts) < 2) | (F.abs(a - b) < 1e-9), "stable").when(b < a, "converging").otherwise("in_flux")


def drift_label(drift: Column) -> Column:
    return F.when(drift < 0.05, "converging").when(drift < 0.15, "drifting").otherwise("volatile")


#: Keywords that suggest a tool, and a kind of task.
TOOL_HINTS = {"recall": "remember|recall|memory", "edit": "edit|change|fix", "test": "test|verify|check", "search": "find|search|where"}
TASKS = {"debug": "bug|error|fix", "design": "design|plan|architecture", "research": "paper|study|compare"}


def tool_hints(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in TOOL_HINTS.items()]))


def task_kind(text: Column) -> Column:
    low, out = F.lower(text), None
    for t, p in TASKS.items():
        out = F.when(low.rlike(p), t) if out is None else out.when(low.rlike(p), t)
    return out.otherwise("general")


def payload_issues(body: Column, needed: list[str]) -> Column:
    """What a JSON body lacks: ``not_json``, or ``missing_x`` per absent or empty field."""
    have = F.try_parse_json(body)
    miss = F.array_compact(F.array(*[F.when(F.coalesce(F.get_json_object(body, f"$.{n}"), F.lit("")) == "", F.lit(f"missing_{n}")) for n in needed]))
    return F.when(have.isNull(), F.array(F.lit("not_json"))).otherwise(miss)


# ---- rankings -------------------------------------------------------------------------------

#: Trusted summaries, the best first.
TRUSTED = ["verified_sequence", "state_machine", "formal_spec", "chain_summary", "progress", "knowledge_graph"]


def name_number(concept: Column) -> Column:
    """The first run of digits in a name, 0 if there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(concept, r"(\d{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0))


def trusted_summaries(rows: DataFrame, most: int = 6) -> DataFrame:
    """``rows``: concept, reliability, type."""
    rank = F.array_position(F.array(*map(F.lit, TRUSTED)), F.col("type"))
    s = rows.where(F.col("concept").startswith("tile:") & (F.col("reliability") >= 0.85)).withColumn("rank", rank).where("rank > 0")
    return s.orderBy("rank", F.desc(name_number(F.col("concept"))), F.desc("reliability"), "concept").limit(most).select("concept", "type", "reliability")


def prioritised(parts: list[DataFrame], most: int) -> DataFrame:
    """Union of sources in order; a concept keeps its first source. Parts: concept, ts. Newest first within a source."""
    out = None
    for k, p in enumerate(parts):
        p = p.select("concept", "ts", F.lit(k).alias("source"))
        out = p if out is None else out.unionByName(p)
    best = out.groupBy("concept").agg(F.min(F.struct("source", (-F.col("ts")).alias("age"))).alias("b"))
    return best.select("concept", "b.source", (-F.col("b.age")).alias("ts")).orderBy("source", F.desc("ts"), "concept").limit(most)


def serving(rows: DataFrame, edges: DataFrame, goal: str, most: int) -> DataFrame:
    own = edges.where((F.col("label") == "serves") & (F.col("dst") == goal)).select(F.col("src").alias("concept"))
    return rows.join(own, "concept", "left_semi").orderBy(F.desc("reliability"), "concept").limit(most)


def curated(rows: DataFrame, most: int) -> DataFrame:
    """Recent rows: no demos if enough is left, valuable names first, then the newest."""
    c = F.col("concept")
    return rows.orderBy(demo_noise(c).cast("int"), F.desc(high_value(c).cast("int")), F.desc("ts"), "concept").limit(most)


def demoted(rows: DataFrame, priority: Column, most: int) -> DataFrame:
    return rows.withColumn("priority", F.round(priority, 6)).orderBy(F.desc("priority"), "concept").limit(most)


# ---- joins ----------------------------------------------------------------------------------


def detail(rows: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """``rows`` with counts of both directions and their least bonds."""
    def side(own: str, other: str, name: str) -> DataFrame:
        w = Window.partitionBy(own).orderBy("label", other)
        e = edges.withColumn("_r", F.row_number().over(w))
        kept = F.when(F.col("_r") <= most, F.concat_ws(">", "label", other))
        return e.groupBy(F.col(own).alias("concept")).agg(F.count("*").alias(f"n_{name}"), F.array_sort(F.collect_list(kept)).alias(name))

    j = rows.join(side("src", "dst", "out"), "concept", "left").join(side("dst", "src", "in"), "concept", "left")
    none = F.array().cast("array<string>")
    return j.withColumns({"n_out": F.coalesce("n_out", F.lit(0)), "n_in": F.coalesce("n_in", F.lit(0)), "out": F.coalesce("out", none), "in": F.coalesce("in", none)})


def overlapping(spans: DataFrame, windows: DataFrame, width: int = 64) -> DataFrame:
    """Line-window overlap as an equi-join on buckets. ``spans``: path, concept, lo, hi; ``windows``: path, wid, first, last."""
    cells = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    j = cells(spans, "lo", "hi").join(cells(windows, "first", "last"), ["path", "_b"]).where("lo <= last and hi >= first")
    return j.select("wid", "concept", "path").distinct()


#: Spans and windows of a cell (a part of a file's pairs), windows that are sorted together, pairs that a row of spans makes, and the
#: fewest pairs of a task, on average; windows of a row.
SPANS, WINDOWS, BLOCK, ROWS, PAIRS, CYCLE = 1 << 13, 1 << 13, 1 << 10, 1 << 16, 1 << 20, 256


def locus_tiers(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """``wid, concept, tier``: 0 where the lines overlap, else 1 in the same file."""
    # a concept with one span and an id with one window meet once at most: their pairs, as many as files make them, are joined
    # and never sorted or shuffled; the others' pairs are grouped
    again = lambda df, key: cut(df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k"), "locus")
    of = lambda df, key, names, how: df.join(names, F.col(key).eqNullSafe(F.col("_k")), how)
    s2, w2 = again(spans, "concept"), again(windows, "wid")
    s1, w1 = of(spans, "concept", s2, "left_anti"), of(windows, "wid", w2, "left_anti")
    rest = _met(of(spans, "concept", s2, "left_semi"), windows).unionByName(_met(s1, of(windows, "wid", w2, "left_semi")))
    return _met(s1, w1).unionByName(rest.groupBy("wid", "concept").agg(F.min("tier").alias("tier")))


def _met(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """``wid, concept, tier`` of each span and window of a file, cell by cell.

    A file's spans and windows are dealt out to as many parts as their numbers need, and each pair of parts is a cell. In a cell rows of
    several spans meet rows of at most ``CYCLE`` windows, sorted by line, so that what a cell takes in is a small share of its pairs, and
    the pairs come as runs of a concept and of a tier and as short cycles of ids, which files of columns hold in little space.
    """
    n = lambda df, name: df.where("path is not null").groupBy("path").agg(F.count("*").alias(name))
    parts = lambda count, size: F.ceil(F.col(count) / size)
    sizes = n(spans, "_s").join(n(windows, "_w"), "path", "full").withColumns({"_ps": parts("_s", SPANS), "_pw": parts("_w", WINDOWS), "_pb": parts("_w", BLOCK)})
    sizes = cut(sizes.withColumn("_pk", F.ceil(F.col("_s") * F.least("_w", F.lit(WINDOWS)) / ROWS)), "locus")
    met = sizes.agg(F.sum("_s"), F.sum(F.col("_s") * F.col("_w")), F.sum(F.col("_ps") * F.col("_pw"))).first()
    # four tasks for each cell, so that few of them get more than one by chance
    tasks = max(1, min(4 * (met[2] or 0), -(-(met[1] or 0) // PAIRS)), -(-(met[0] or 0) // PAIRS))
    # a row for each SPANS or BLOCK rows at most; of the files that have it, those without spans or windows meet nothing
    large = F.broadcast(sizes.where((F.col("_ps") > 1) | (F.col("_pb") > 1)).select("path", "_ps", "_pw", "_pk", "_pb"))
    usual = {"_ps": 1, "_pw": 1, "_pk": -(-SPANS * BLOCK // ROWS), "_pb": 1}
    sized = lambda df: df.where("path is not null").join(large, "path", "left").where("(_ps is null) = (_pw is null)").fillna(usual)
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    cell = ["path", "_i", "_j"]
    s = sized(spans).withColumn("_k", F.pmod(F.xxhash64("concept", "lo", "hi"), F.col("_pk"))).select("path", "concept", "lo", "hi", "_k", F.pmod("_k", "_ps").alias("_i"), each("_pw").alias("_j"))
    s = s.repartition(tasks, *cell).groupBy(*cell, "_k").agg(F.collect_list(F.struct("concept", "lo", "hi")).alias("_s")).drop("_k")
    w = sized(windows).withColumn("_k", F.pmod(F.xxhash64("wid", "first", "last"), F.col("_pb"))).groupBy("path", "_ps", "_pw", "_k").agg(F.sort_array(F.collect_set(F.struct("first", "last", "wid"))).alias("_w"))
    # ids of a cycle of whole bytes repeat in a packed column byte for byte
    w = w.withColumn("_w", F.explode(F.expr(f"transform(sequence(0, cast((size(_w) - 1) / {CYCLE} as int)), n -> slice(_w, n * {CYCLE} + 1, {CYCLE}))")))
    w = w.select("path", "_w", each("_ps").alias("_i"), F.pmod("_k", "_pw").alias("_j")).repartition(tasks, *cell)
    pairs = s.join(w.hint("shuffle_hash"), cell).select(F.explode("_s").alias("_s"), "_w").select("_s", F.explode("_w").alias("_w"))
    overlap = F.coalesce((F.col("_s.lo") <= F.col("_w.last")) & (F.col("_s.hi") >= F.col("_w.first")), F.lit(False))
    return pairs.select("_w.wid", "_s.concept", F.when(overlap, 0).otherwise(1).alias("tier"))


def mentions(rows: DataFrame, files: list[str], most: int = 16) -> DataFrame:
    """The first of (at most 16) files that each row's body names by path or base name."""
    first = None
    for f in files[:most]:
        hit = F.col("body").contains(f) | F.col("body").contains(f.rsplit("/", 1)[-1])
        first = F.when(hit, f) if first is None else first.when(hit, f)
    return rows.select("concept", first.alias("file")).where("file is not null")


def containing(rows: DataFrame, needle: str, most: int) -> DataFrame:
    if len(needle) < 10:
        raise ValueError("a needle has at least ten characters")
    return rows.where(F.contains(F.lower("body"), F.lit(needle.lower()))).orderBy("concept").limit(most)


def lineage_issues(traces: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """``concept, issues``: unreliable, unsigned, or no predecessor edge. ``traces``: concept, reliability, digest."""
    prev = edges.where("label = 'prev_in_trace'").select(F.col("src").alias("concept"), F.lit(True).alias("_e")).distinct()
    i = F.array_compact(F.array(F.when(F.col("reliability") < least, F.lit("unreliable")), F.when(F.coalesce("digest", F.lit("")) == "", F.lit("unsigned")), F.when(F.col("_e").isNull(), F.lit("no_predecessor"))))
    return traces.join(prev, "concept", "left").select("concept", i.alias("issues"))


# ---- views, drafts, inserts -----------------------------------------------------------------


def merged_views(parts: list[DataFrame]) -> DataFrame:
    """Saved views of slots (concept, reliability, preview); of each concept the first view's slot."""
    out = None
    for k, p in enumerate(parts):
        p = p.select("concept", F.struct(F.lit(k).alias("k"), "reliability", "preview").alias("s"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("concept").agg(F.min("s").alias("s")).select("concept", "s.reliability", "s.preview")


def view_reliability(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("n"), F.round(F.least(F.max("reliability"), F.lit(0.99)), 6).alias("reliability"))


def chain_drafts(chains: DataFrame, most: int = 16) -> DataFrame:
    """``head, n, kind, steps``: bodies from the oldest on, empty ones skipped. ``chains``: head, depth, body."""
    c = chains.where((F.col("depth") < most) & (F.trim("body") != ""))
    g = c.groupBy("head").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("o"), "body"))).alias("xs"))
    n = F.size("xs")
    return g.select("head", n.alias("n"), F.when(n >= 4, "verified_sequence").when(n >= 2, "state_machine").otherwise("research_offload").alias("kind"), F.transform("xs", lambda x: x["body"]).alias("steps"))


def mirror_edges(rows: DataFrame) -> DataFrame:
    """Two mirror edges a row, one to its goal if it has one, and one per reference. ``rows``: concept, twin, goal, refs."""
    edge = lambda s, l, d: F.struct(s.alias("src"), F.lit(l).alias("label"), d.alias("dst"))
    c, t = F.col("concept"), F.col("twin")
    fixed = F.array(edge(c, "mirrors", t), edge(t, "mirrored_by", c), F.when(F.col("goal").isNotNull(), edge(c, "serves", F.col("goal"))))
    refs = F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda r: F.struct(c.alias("src"), F.when(r.startswith("file:"), "in_file").otherwise("refers_to").alias("label"), r.alias("dst")))
    return rows.select(F.explode(F.concat(F.array_compact(fixed), refs)).alias("e")).select("e.*")


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that are not there yet."""
    return new.join(rows.select("concept"), "concept", "left_anti")


def enriched(turns: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Missing fields filled from ``extra``; what is there stays."""
    names = [c for c in extra.columns if c != key]
    e = extra.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return turns.join(e, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in names else F.col(c) for c in turns.columns])


def condensation_due(edges: DataFrame, summaries: DataFrame, least: int = 6) -> DataFrame:
    """Goals with so many serving traces and no summary. ``summaries``: goal."""
    n = edges.where("label = 'serves'").groupBy(F.col("dst").alias("goal")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(summaries, "goal", "left_anti")


def export_audit(rows: DataFrame, least: float = 0.74) -> DataFrame:
    """One row: how many pass a coherence gate, and their mean."""
    ok = F.col("coherence") >= least
    return rows.agg(F.count("*").alias("checked"), F.sum(ok.cast("int")).alias("passed"), F.sum((~ok).cast("int")).alias("failed"), F.round(F.avg("coherence"), 6).alias("mean"))


# ---- word bundles ---------------------------------------------------------------------------


def differentiated(words: Column) -> Column:
    """Each word's coefficients shrink by the golden ratio less 0.05, its text is marked."""
    return F.transform(words, lambda w: F.struct(F.concat(F.lit("d("), w["text"], F.lit(")")).alias("text"), F.transform(w["coeff"], lambda c: c * 0.618034 - 0.05).alias("coeff")))


def integrated(bundles: Column) -> Column:
    """Words one after another, with a glue patch between neighbours (ids from 1000)."""
    words = F.flatten(F.transform(bundles, lambda b: b["words"]))
    glue = F.transform(F.sequence(F.lit(1), F.size(bundles)), lambda i: 999 + i)
    return F.struct(words.alias("words"), F.slice(glue, F.lit(1), F.size(bundles) - 1).alias("patches"))


def composed(bundles: Column, names: Column) -> Column:
    """As ``integrated``, with a named patch for every step (ids from 2000)."""
    steps = F.transform(names, lambda n, i: F.struct((2000 + i).alias("id"), n.alias("morphism")))
    return F.struct(F.flatten(F.transform(bundles, lambda b: b["words"])).alias("words"), steps.alias("patches"))


def attestation(version: Column, contract: Column, reliability: Column, op: str) -> Column:
    return F.sha2(F.concat_ws("|", version.cast("string"), contract, F.format_number(reliability, 4), F.lit(op)), 256)


def guarded(allowed: Column, value: Column, otherwise: Column) -> Column:
    """The operation's value where the contract allows it."""
    return F.when(allowed, value).otherwise(otherwise)
