"""Text operators over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode as E
from ..operators import integrity as I
from ..operators import overlap as N
from ..sources import chunks as K
from ..sources.tables import edges, table
from .registry import query


def _sql_scrub(column: str, steps) -> str:
    for _, pattern, token in steps:
        column = f"regexp_replace({column}, '{pattern}', '{token}', 'g')"
    return column


def _sql_found(column: str, steps) -> str:
    out = []
    for k, (label, pattern, _) in enumerate(steps):
        out.append(f"CASE WHEN regexp_matches({_sql_scrub(column, steps[:k])}, '{pattern}') THEN '{label}' END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


_LINES = "length(t) - length(replace(t, chr(10), ''))"


@query(f"SELECT doc_id, {_sql_scrub('text', T.SCRUB[:3])} AS clean FROM documents")
def scrub_rest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.scrub(F.col("text"), T.SCRUB[:3])["text"].alias("clean"))


@query(f"SELECT doc_id, sha256({_sql_scrub('text', T.SCRUB)}) AS clean, {_sql_found('text', T.SCRUB)} AS redacted FROM documents")
def scrub_export_pipeline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(T.export_denied(F.concat(F.lit("doc:"), "doc_id"), F.col("text")).isNull())
    s = d.select("doc_id", T.scrub(F.col("text")).alias("s"))
    return s.select("doc_id", F.sha2("s.text", 256).alias("clean"), F.col("s.found").alias("redacted"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'local_only_prefix' WHEN contains(text, '/home/') AND doc_id % 10 = 1 THEN 'handoff_may_contain_paths' END AS reason FROM documents")
def sovereignty_reason(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 10 == 0, F.concat(F.lit("local:host:"), i)).when(i % 10 == 1, "helper:session_handoff_latest").otherwise(F.concat(F.lit("doc:"), i))
    return table(spark, sf_dir, "documents").select("doc_id", T.export_denied(name, F.col("text")).alias("reason"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 3))"


@query(
    f"""WITH d AS (SELECT doc_id, {_TOK.format(t="text")} AS a FROM documents), b AS (SELECT item_id, {_TOK.format(t="text")} AS b FROM benchmark),
    j AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM d, b)
    SELECT doc_id, max(round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE n / (na + nb - n) END, 6)) AS overlap FROM j GROUP BY doc_id"""
)
def jaccard_intent(spark, sf_dir):
    """Best token overlap of each document with any intent."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("a"))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("b"))
    return N.best_overlap(d, b).select("doc_id", F.round("overlap", 6).alias("overlap"))


_L = "list_transform(regexp_split_to_array({t}, '\\r?\\n'), lambda t: trim(t))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, text, trim(text) AS u FROM conversations), f AS (SELECT conv_id, turn,
      list_filter([CASE WHEN u <> '' AND strlen(u) <= 280 THEN 'User: ' || u WHEN u <> '' THEN 'User: ' || u[1:200] || '…' END], lambda x: x IS NOT NULL) AS own,
      list_filter({_L.format(t="text")}, lambda t: strlen(t) BETWEEN 12 AND 400 AND (starts_with(lower(t), '- ') OR starts_with(lower(t), '* ') OR regexp_matches(lower(t), 'implemented|shipped|decided|fixed|goal:') OR contains(t, '.rs') OR contains(t, 'docs/'))) AS telling FROM c)
    SELECT conv_id, turn, list_sort(list_distinct(list_concat(own, telling)[1:6]))[1:5] AS facts FROM f"""
)
def fact_lines(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.fact_lines(F.lit(""), t, t).alias("facts"))


@query(f"SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform({_L.format(t='text')}, lambda t: trim(regexp_replace(regexp_replace(t, '^[-*\\s]+', ''), '^[0-9.)]+', ''))), lambda t: strlen(t) BETWEEN 8 AND 400)))[1:5] AS facts FROM conversations")
def listed_facts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.listed_facts(F.col("text")).alias("facts"))


_DEC = "'- keep ' || replace(text[1:40], chr(10), ' ') || chr(10) || '* drop it' || chr(10) || 'why not?' || chr(10) || '- and this?' || chr(10)"


@query(f"WITH c AS (SELECT conv_id, turn, {_L.format(t=_DEC)} AS l FROM conversations) SELECT conv_id, turn, list_transform(list_filter(l, lambda t: regexp_matches(t, '^[-*] ') AND NOT contains(t, '?')), lambda t: trim(t[3:])) AS decisions, list_filter(l, lambda t: contains(t, '?')) AS questions FROM c")
def handoff_decisions(spark, sf_dir):
    body = F.concat(F.lit("- keep "), F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")), F.lit("\n* drop it\nwhy not?\n- and this?\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.decisions(body).alias("decisions"), T.questions(body).alias("questions"))


@query("SELECT doc_id, array_to_string(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ')[1:12], ' ') AS decision FROM documents")
def decision_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalised_decision(F.col("text")).alias("decision"))


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, -1 AS part, 0 AS a, 0 AS e FROM documents
      UNION ALL SELECT doc_id, t, part + 1, e, CASE WHEN e + 2000 >= length(t) THEN length(t) WHEN regexp_matches(sub, '[ 
	]') THEN e + 1 + length(sub) - length(regexp_extract(sub, '[^ 
	]*$')) ELSE e + 2000 END
      FROM (SELECT *, substring(t, e + 2, 1999) AS sub FROM w WHERE e < length(t)))
    SELECT doc_id, part, 'doc' || doc_id || '_part' || part AS name, e - a AS n_chars FROM w WHERE part >= 0"""
)
def chunk_text(spark, sf_dir):
    """Whole texts in chunks of at most 2000 characters, cut after white space."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.lateralJoin(K.ChunkText(F.concat(F.lit("doc"), F.col("doc_id").outer()), F.col("text").outer(), F.lit(2000))).select("doc_id", "part", "name", F.length("chunk").alias("n_chars"))


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, ({_LINES.replace("length(t)", "length(coalesce(text, ''))").replace("replace(t,", "replace(coalesce(text, ''),")})::INT AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, 'frontmatter' AS kind, 0 AS level, '' AS title, 1 AS start, 3 AS stop FROM d UNION ALL SELECT doc_id, 'section', 1, 'Head', 4, 10 + n FROM d
    UNION ALL SELECT doc_id, 'section', 2, 'Sub', 6 + n, 10 + n FROM d UNION ALL SELECT doc_id, 'code', 0, 'py', 7 + n, 9 + n FROM d"""
)
def markdown_items(spark, sf_dir):
    md = F.concat(F.lit("---\nid: "), F.col("doc_id"), F.lit("\n---\n# Head\n"), F.col("text"), F.lit("\n## Sub\n```py\nx = 1\n```\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", md.alias("md"))
    return d.lateralJoin(K.ExtractItems(F.lit("md"), F.col("md").outer())).select("doc_id", "kind", "level", "title", "start", "stop")




@query(
    f"""WITH d AS (SELECT doc_id, lang, replace(coalesce(text, ''), '*/', '') AS t FROM documents), n AS (SELECT *, ({_LINES})::INT AS n FROM d)
    SELECT doc_id, 'impl' AS kind, 'Doc' || doc_id AS title, '' AS owner, 1 AS start, 9 + n AS stop, '' AS doc FROM n
    UNION ALL SELECT doc_id, 'fn', 'read_' || lang, 'Doc' || doc_id, 3, 8 + n, 'reads {{' FROM n
    UNION ALL SELECT doc_id, 'struct', 'End', '', 10 + n, 10 + n, '' FROM n"""
)
def code_items(spark, sf_dir):
    """Each text as a comment of a method, between strings and characters with braces."""
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit(""))
    parts = ["impl Doc", F.col("doc_id"), " {\n    /// reads {\n    pub fn read_", F.col("lang"), "(&self) -> &'static str {\n        let c = '{'; // }\n        let s = r#\"} \"{\"#;\n        /* /* nested */ ", t, " */\n        \"}\"\n    }\n}\npub struct End;\n"]
    code = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    d = table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    return d.lateralJoin(K.ExtractItems(F.lit("rs"), F.col("code").outer())).select("doc_id", "kind", "title", "owner", "start", "stop", "doc")


_BARE = "trim(regexp_replace(trim(ltrim({v}, '-*+')), '^[`\"]+|[`\"]+$', '', 'g'))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, trim(string_split(coalesce(text, ''), chr(10))[1]) AS first FROM conversations), b AS (SELECT *, {_BARE.format(v="'- ' || first")} AS bare FROM c)
    SELECT conv_id, turn, list_filter([CASE WHEN strlen(bare) >= 3 AND NOT regexp_matches(bare, '^[\\[{{]') AND regexp_matches(bare, '[\\p{{L}}\\p{{N}}]') THEN bare END, '2) `turn ' || turn || ' fails', 'a "quoted] ' || conv_id, 'one ' || turn, 'two', 'this would reverse it'], lambda x: x IS NOT NULL) AS falsifiers FROM b"""
)
def handoff_falsifiers(spark, sf_dir):
    """Each turn's first line as a bullet of the section, between other forms and noise."""
    c = table(spark, sf_dir, "conversations")
    first = F.trim(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)))
    parts = [
        F.coalesce("text", F.lit("")), "\nship: falsifier parse\n### Falsifiers:\n- ", first, "\n2) `turn ", F.col("turn"), " fails`\n- ab\n{ \"falsifiers\": [\"a \\\"quoted] ", F.col("conv_id"), "\", \"[no\", \"x\"], \"other\": [\"not this\"] }\n"
        "# Next\n- not in the section\n* falsifiers: one ", F.col("turn"), "; two; x\n- falsifiers:\n- this would reverse it\n- this would reverse it\n",
    ]
    summary = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return c.select("conv_id", "turn", T.falsifiers(summary).alias("falsifiers"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, t, CASE doc_id % 3 WHEN 0 THEN '**justification:** ' || t WHEN 1 THEN 'x' || chr(10) || 'Decision_point:  ' || t ELSE chr(10) || '**head**' || chr(10) || t END AS body FROM d),
    r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN replace(trim(('** ' || t)[1:105], ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)), chr(10), ' ') WHEN 1 THEN replace(trim(('  ' || t)[1:105], ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)), chr(10), ' ') END AS cut,
      list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda l: l <> '' AND NOT starts_with(l, '**') AND NOT starts_with(l, 'goal:'))[1] AS line FROM b)
    SELECT doc_id, CASE WHEN cut IS NOT NULL AND strlen(cut) > 3 THEN CASE WHEN strlen(cut) > 100 THEN cut[1:97] || '…' ELSE cut END ELSE coalesce(line[1:90], body[1:85]) END AS reason FROM r
    WHERE doc_id % 3 <> 2 OR NOT regexp_matches(lower(body), 'justification:|decision_point:|decision:')"""
)
def justification_excerpts(spark, sf_dir):
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    body = F.when(i % 3 == 0, F.concat(F.lit("**justification:** "), t)).when(i % 3 == 1, F.concat(F.lit("x\nDecision_point:  "), t)).otherwise(F.concat(F.lit("\n**head**\n"), t))
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return d.where((i % 3 != 2) | ~F.lower("body").rlike("justification:|decision_point:|decision:")).select("doc_id", T.justification(F.col("body")).alias("reason"))


_FLD = "'**decision:** ' || lang || ' first' || chr(10) || 'x' || chr(10) || '**spatial:** src/' || source || '.rs:' || doc_id || chr(10) || '**recorded_at:** 12'"


@query(
    f"""WITH b AS (SELECT doc_id, lang, source FROM documents) SELECT doc_id, lang || ' first' AS decision, 'src/' || source || '.rs' AS path, doc_id AS line, source || '.rs' AS stem, '' AS missing, left(md5(source), 0) || replace(lower(lang || '_' || source), '_', '-') AS slug FROM b"""
)
def field_extract(spark, sf_dir):
    body = F.concat(F.lit("**decision:** "), "lang", F.lit(" first\nx\n**spatial:** src/"), "source", F.lit(".rs:"), "doc_id", F.lit("\n**recorded_at:** 12"))
    b = table(spark, sf_dir, "documents").select("doc_id", body.alias("b"), F.concat_ws("_", "lang", "source").alias("k"))
    at = T.field(F.col("b"), "spatial")
    p = T.locus(at)
    return b.select("doc_id", T.field(F.col("b"), "decision").alias("decision"), p["path"].alias("path"), p["line"].alias("line"), T.locus_stem(at).alias("stem"), T.field(F.col("b"), "absent").alias("missing"), T.slug(F.col("k"), 40).alias("slug"))


@query(
    """WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tile:' || doc_id WHEN 1 THEN 'helper:session_handoff_latest' WHEN 2 THEN 'a__fn__b' ELSE 'plain' END AS concept, trim(text) AS new FROM documents),
    m AS (SELECT *, CASE WHEN concept = 'helper:session_handoff_latest' THEN 'replace' ELSE 'append' END AS mode FROM k),
    b AS (SELECT doc_id, mode, CASE WHEN mode = 'replace' THEN new WHEN new = '' THEN 'old body' ELSE 'old body' || chr(10) || chr(10) || '--- update @ ' || doc_id || ' ---' || chr(10) || new END AS body FROM m)
    SELECT doc_id, mode, sha256(CASE WHEN length(body) <= 96000 THEN body ELSE '[provlog truncated — ' || (length(body) - 95936) || ' chars removed from head]' || chr(10) || chr(10) || substring(body, length(body) - 95936 + 1) END) AS body FROM b"""
)
def splice_append(spark, sf_dir):
    i = F.col("doc_id")
    concept = F.when(i % 4 == 0, F.concat(F.lit("tile:"), i)).when(i % 4 == 1, "helper:session_handoff_latest").when(i % 4 == 2, "a__fn__b").otherwise("plain")
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("new"), T.splice_mode(concept, F.lit("prose")).alias("mode"))
    return d.select("doc_id", "mode", F.sha2(T.spliced(F.lit("old body "), F.col("new"), F.col("mode"), i), 256).alias("body"))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS body FROM pages"""
)
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("SELECT doc_id, greatest(ceil(length(text) / 4)::BIGINT, 1) AS tokens, CASE WHEN length(text) > 60 THEN text[1:60] || '…' ELSE text END AS short FROM documents")
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(t).alias("tokens"), T.shortened(t, 60).alias("short"))


# ---- encoding -------------------------------------------------------------------------------

_DIMS = 8


@query(
    f"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS w FROM benchmark),
    a AS (SELECT item_id, i, ('0x' || md5(w || '#' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS a FROM w, range({_DIMS}) t(i)),
    s AS (SELECT item_id, i, sum(cos(a)) AS re, sum(sin(a)) AS im FROM a GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(re * re + im * im)) AS n FROM s GROUP BY item_id)
    SELECT item_id, round(max(CASE WHEN i = 0 THEN re / n END), 6) + 0.0 AS re_first, round(max(CASE WHEN i = {_DIMS - 1} THEN im / n END), 6) + 0.0 AS im_last FROM s JOIN n USING (item_id) GROUP BY item_id"""
)
def encode_text_lanes(spark, sf_dir):
    e = E.encode_lanes(table(spark, sf_dir, "benchmark"), "text", _DIMS, "item_id")
    r6 = lambda c, i: F.round(F.get(c, F.lit(i)), 6) + 0.0
    return e.select("item_id", r6("re", 0).alias("re_first"), r6("im", _DIMS - 1).alias("im_last"))


@query()
def encode_text_xof(spark, sf_dir):
    v = E.encode_xof(64)("text")
    return table(spark, sf_dir, "benchmark").select("item_id", v.alias("v")).select("item_id", F.size("v").alias("n"), F.transform(F.slice("v", 1, 4), lambda x: F.round(x, 5)).alias("head"))


# ---- integrity ------------------------------------------------------------------------------

_D = "sha256(concat_ws(chr(31), doc_id::VARCHAR, text, source))"


@query(f"SELECT doc_id, {_D} AS digest FROM documents")
def seal_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.digest(F.col("doc_id"), F.col("text"), F.col("source")).alias("digest"))


@query(
    """WITH s AS (SELECT CASE WHEN doc_id % 97 = 5 THEN 'structural' WHEN doc_id % 31 = 0 THEN 'legacy_unsealed' WHEN doc_id % 53 = 1 THEN 'mismatch' ELSE 'valid' END AS status FROM documents),
    t AS (SELECT count(*) AS checked, sum((status = 'valid')::INT)::BIGINT AS valid, sum((status = 'legacy_unsealed')::INT)::BIGINT AS legacy_unsealed, sum((status = 'mismatch')::INT)::BIGINT AS mismatch, sum((status = 'structural')::INT)::BIGINT AS structural FROM s)
    SELECT *, CASE WHEN mismatch = 0 AND structural = 0 THEN 'healthy' WHEN mismatch + structural > checked / 10 THEN 'critical' ELSE 'needs_review' END AS health FROM t"""
)
def integrity_status(spark, sf_dir):
    i, d = F.col("doc_id"), I.digest(F.col("doc_id"), F.col("text"), F.col("source"))
    seal = F.when(i % 31 == 0, "").when(i % 53 == 1, "0" * 64).otherwise(d)
    s = table(spark, sf_dir, "documents").select(I.status(seal, d, i % 97 != 5).alias("status"))
    return I.overall(s)


@query("SELECT doc_id, [md5('c'), md5('b'), md5('a')] || CASE WHEN doc_id % 2 = 0 THEN [''] ELSE ['x', 'y'] END AS slots, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 5 END AS depth FROM documents")
def chain_advance(spark, sf_dir):
    old = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    slots = old
    for s in ("a", "b", "c"):
        slots = I.advance(slots, F.md5(F.lit(s).cast("binary")))
    d = table(spark, sf_dir, "documents").select("doc_id", slots.alias("slots"))
    return d.where(I.plausible(F.col("slots"))).select("doc_id", "slots", I.depth(F.col("slots")).alias("depth"))


@query(
    """WITH e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, c_custkey % 9 = 0 AS stale FROM customer)
    SELECT src, dst, NOT stale AS current FROM e"""
)
def relation_lineage(spark, sf_dir):
    from ..operators import relations as G

    e = edges(spark, sf_dir).where("label = 'located_in'").select("src", "dst")
    names = e.select(F.col("src").alias("concept")).union(e.select("dst")).distinct()
    fresh = G.with_roots(e, names.select("concept", F.sha2("concept", 256).alias("digest")))
    k = F.substring_index("src", ":", -1).cast("long")
    stored = fresh.withColumn("root", F.when(k % 9 == 0, "stale").otherwise(F.col("expected")))
    return stored.select("src", "dst", G.lineage_current().alias("current"))


@query("SELECT doc_id, sha256(text) AS body, strlen(text) + 28 AS sealed_bytes, true AS foreign_key_fails, true AS foreign_name_fails FROM documents")
def sealed_bodies(spark, sf_dir):
    key, other, name = F.lit(b"0123456789abcdef").cast("binary"), F.lit(b"fedcba9876543210").cast("binary"), F.concat(F.lit("doc:"), F.col("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", I.sealed(F.col("text"), key, name).alias("s"), name.alias("name"))
    return d.select("doc_id", F.sha2(I.opened(F.col("s"), key, F.col("name")), 256).alias("body"), F.octet_length(F.unbase64("s")).cast("long").alias("sealed_bytes"), I.opened(F.col("s"), key, F.lit("doc:other")).isNull().alias("foreign_name_fails"), I.opened(F.col("s"), other, F.col("name")).isNull().alias("foreign_key_fails"))
