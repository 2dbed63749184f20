"""Text functions as column expressions: scrubbing, fields, facts, splices, slugs, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import let

# What is scrubbed, in this order, and what stands in for it.
SCRUB = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("cc", r"\b(?:\d[ -]*?){13,16}\b", "[REDACTED_CC]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("home_path", r"(?i)/home/[^\s/]+", "[REDACTED_PATH]"),
    ("tilde_path", r"~(?:/[A-Za-z0-9._-]+)+", "[REDACTED_PATH]"),
    ("rtsp", r"(?i)rtsp://[^\s]+", "[REDACTED_STREAM]"),
    ("api_secret", r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S+", "[REDACTED_SECRET]"),
]


def scrub(text: Column, steps: list = SCRUB) -> Column:
    """``text``, scrubbed, and ``found``, the labels of the steps that changed it. Each step reads the text once:
    what stands in for a finding never equals it."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))

    def one(label: str, pattern: str, token: str):
        def after(s: Column) -> Column:
            bare = F.regexp_replace(s["text"], pattern, token)
            return let(bare, lambda t: F.struct(t.alias("text"), F.when(t == s["text"], s["found"]).otherwise(F.concat(s["found"], F.array(F.lit(label)))).alias("found")))

        return after

    for step in steps:
        state = let(state, one(*step))
    return state


def export_denied(concept: Column, text: Column) -> Column:
    """Why a row must not leave, or null."""
    return (
        F.when(concept.rlike("^local:(host|user):"), "local_only_prefix")
        .when(text.contains("**sovereignty:** local_only") | text.contains("**export_policy:** deny"), "local_only_marker")
        .when(concept.startswith("helper:session_handoff") & text.contains("/home/"), "handoff_may_contain_paths")
    )


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def field(text: Column, name: str) -> Column:
    """The value of a ``**name:** value`` line; empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?m)^\*\*{name}:\*\*[ \t]*(.*)$", 1))


def without_footer(text: Column, name: str = "recorded_at") -> Column:
    at = F.length(text) - F.length(F.substring_index(text, f"**{name}:**", -1))
    return F.when(text.contains(f"**{name}:**"), F.regexp_replace(F.substring(text, F.lit(1), at - len(name) - 5), r"\s+$", "")).otherwise(text)


CUES = ("implemented", "shipped", "decided", "fixed", "goal:")


def fact_lines(summary: Column, user: Column, assistant: Column, most: int = 5) -> Column:
    """The summary, the user's words and telling lines of the answer, sorted, distinct, at most five.

    At most six are collected, as they come, before sorting. Lengths of answer lines are in bytes.
    """
    s, u = F.trim(summary), F.trim(user)
    own = F.array(
        F.when((s != "") & (F.octet_length(s) <= 512), s),
        F.when((u != "") & (F.octet_length(u) <= 280), F.concat(F.lit("User: "), u)).when(u != "", F.concat(F.lit("User: "), F.substring(u, 1, 200), F.lit("…"))),
    )
    low = lambda t: F.lower(t)
    cue = lambda t: low(t).startswith("- ") | low(t).startswith("* ") | low(t).rlike("|".join(CUES)) | t.contains(".rs") | t.contains("docs/")
    telling = F.filter(F.transform(lines(assistant), lambda t: F.trim(t)), lambda t: F.octet_length(t).between(12, 400) & cue(t))
    return F.slice(F.array_sort(F.array_distinct(F.slice(F.concat(F.array_compact(own), telling), 1, 6))), 1, most)


def listed_facts(text: Column, most: int = 5) -> Column:
    """Lines without their bullets and numbers, of 8 to 400 bytes, sorted, distinct, at most five."""
    bare = F.transform(lines(text), lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), r"^[-*\s]+", ""), r"^[0-9.)]+", "")))
    return F.slice(F.array_sort(F.array_distinct(F.filter(bare, lambda t: F.octet_length(t).between(8, 400)))), 1, most)


def decisions(text: Column) -> Column:
    """Bullet lines that are no questions."""
    bullets = F.filter(F.transform(lines(text), lambda t: F.trim(t)), lambda t: t.rlike(r"^[-*] ") & ~t.contains("?"))
    return F.transform(bullets, lambda t: F.trim(F.substring(t, F.lit(3), F.length(t))))


def questions(text: Column) -> Column:
    return F.filter(F.transform(lines(text), lambda t: F.trim(t)), lambda t: t.contains("?"))


def normalised_decision(text: Column, words: int = 12) -> Column:
    """Lower case, ASCII letters, digits and spaces only, the first twelve words."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return F.array_join(F.slice(F.split(bare, " "), 1, words), " ")


def locus_stem(locus: Column) -> Column:
    """The file name of a ``path:line`` locus."""
    return F.substring_index(F.substring_index(locus, ":", 1), "/", -1)


def locus(text: Column) -> Column:
    """``path``, ``line`` of a ``path:line`` locus."""
    return F.struct(F.regexp_extract(text, r"^(.*?)(?::(\d+))?$", 1).alias("path"), F.try_to_number(F.nullif(F.regexp_extract(text, r"^(.*?)(?::(\d+))?$", 2), F.lit("")), F.lit("9999999999")).cast("bigint").alias("line"))


def slug(text: Column, most: int) -> Column:
    return F.regexp_replace(F.lower(F.substring(text, 1, most)), "[^a-z0-9-]", "-")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def tokens(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= least))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.ceil(F.length(text) / 4), F.lit(1))


# ---- splices ------------------------------------------------------------------------------

# Which bodies are replaced and which grow; and the notice in `capped`.
REPLACED = r"^(helper:session_handoff_latest|helper:session_sentinel_state)$|^manifest:rehydration_"
GROWING = r"^(trace|design|progress|scar|tile|var|helper|goal|praxis|pattern):"
SOURCE_KEYS = r"__(fn|struct|impl|mod|enum|trait)__"


def source_snippet(text: Column) -> Column:
    t = F.trim(text)
    return (t != "") & (t.contains("fn ") | t.rlike(r"^(impl|struct|enum|mod|trait) ") | (t.contains("{") & t.contains("\n")))


def splice_mode(concept: Column, text: Column) -> Column:
    return (
        F.when(concept.endswith("__arc"), "append")
        .when(concept.rlike(REPLACED), "replace")
        .when(concept.rlike(GROWING), "append")
        .when(concept.rlike(SOURCE_KEYS) & source_snippet(text), "replace")
        .otherwise("append")
    )


BODY_CHARS = 96_000


def capped(text: Column, most: int = BODY_CHARS) -> Column:
    gone = F.length(text) - (most - 64)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("[provlog truncated — "), gone.cast("string"), F.lit(" chars removed from head]\n\n"), F.substring(text, gone + 1, F.lit(most))))


def spliced(existing: Column, new: Column, mode: Column, ts: Column) -> Column:
    old, delta = F.trim(existing), F.trim(new)
    grown = F.when(old == "", delta).when(delta == "", old).otherwise(F.concat(old, F.lit("\n\n--- update @ "), ts.cast("string"), F.lit(" ---\n"), delta))
    return capped(F.when(mode == "replace", new).otherwise(grown))


def segments(text: Column, last: int) -> Column:
    """The last so many segments of a grown body."""
    parts = F.split(text, r"\n*--- update @ \d+ ---\n")
    return F.slice(parts, F.greatest(F.size(parts) - last + 1, F.lit(1)), F.lit(last))


# ---- pages --------------------------------------------------------------------------------


def strip_html(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[\x20\x09-\x0D]+", " "))


def age_label(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))


def first_json(text: Column) -> Column:
    """The text from its first opening brace to its last closing one, if it parses."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


# ---- conditions that would overturn a decision ----------------------------------------------

_BULLET = r"^(?:[-*•+] |[0-9]+[.)] )"
_EDGES = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    """Without bullet marks, white space and quotes around it."""
    return F.trim(F.regexp_replace(F.trim(F.ltrim(line, F.lit("-*+")), F.lit(_EDGES)), r'^[`"]+|[`"]+$', ""), F.lit(_EDGES))


def _tells(v: Column) -> Column:
    t = F.trim(v, F.lit(_EDGES))
    return (F.octet_length(t) >= 3) & ~t.rlike(r"^[\[{]") & ~F.lower(t).isin("falsifiers", "falsifier") & t.rlike(r"[\p{L}\p{N}]")


def falsifiers(text: Column) -> Column:
    """What a summary says would overturn it, in order, each once.

    Bullets below a heading of that name, the strings of a JSON array behind the key ``"falsifiers"`` (up to its closing
    bracket; brackets and escaped quotes inside strings are text), values of lines that begin with ``falsifiers:``
    (parted by semicolons), and lines that say so in words. Headings, bare keys and mentions in other lines are noise.
    """
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        raw = F.trim(line, F.lit(_EDGES))
        low = F.lower(raw)
        head = F.rtrim(F.trim(F.ltrim(low, F.lit("#")), F.lit(_EDGES)), F.lit(":"))
        opens = head.isin("falsifiers", "falsifier", "would_falsify") | head.contains("would reverse")
        inner = F.regexp_extract(raw, r'(?i)"falsifiers"[^\[]*\[((?:[^"\]]|"(?:[^"\\]|\\.)*")*)', 1)
        items = F.transform(F.regexp_extract_all(inner, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda s: F.regexp_replace(s, r'\\(["\\/])', "$1"))
        bare = F.trim(F.ltrim(raw, F.lit("-*+")), F.lit(_EDGES))
        keyed = F.lower(bare).rlike("^falsifiers?:")
        value = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, "(?i)^falsifiers?:", ""), F.lit(_EDGES)), r'^[`"]+|[`"]+$', ""), F.lit(_EDGES))
        parted = F.when(_tells(value), F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p, F.lit(_EDGES))), _tells)).otherwise(F.array().cast("array<string>"))
        own = F.when(_tells(_bare(raw)), F.array(_bare(raw))).otherwise(F.array().cast("array<string>"))
        said = (acc["inside"] & raw.rlike(_BULLET)) | low.rlike("would reverse|would_falsify")
        more = F.when(low.contains('"falsifiers"'), F.filter(items, _tells)).when(keyed, parted).when(said, own).otherwise(F.array().cast("array<string>"))
        heading = raw.startswith("#")
        return F.when(raw == "", acc).otherwise(F.struct(F.when(heading, opens).otherwise(acc["inside"]).alias("inside"), F.when(heading, acc["out"]).otherwise(F.concat(acc["out"], more)).alias("out")))

    return F.array_distinct(F.aggregate(lines(F.coalesce(text, F.lit(""))), start, step)["out"])


def justification(text: Column) -> Column:
    """A short reason: what follows ``justification:``, else ``decision_point:``, else ``decision:``; else the first telling line."""
    out = None
    for key in ("justification:", "decision_point:", "decision:"):
        at = F.instr(F.lower(text), key)
        cut = F.regexp_replace(F.trim(F.substring(text, at + len(key), F.lit(105)), F.lit(_EDGES + "\n")), "\n", " ")
        short = F.when(F.octet_length(cut) > 100, F.concat(F.substring(cut, 1, 97), F.lit("…"))).otherwise(cut)
        hit = (at > 0) & (F.octet_length(cut) > 3)
        out = F.when(hit, short) if out is None else out.when(hit, short)
    telling = F.get(F.filter(F.transform(lines(text), lambda t: F.trim(t, F.lit(_EDGES))), lambda t: (t != "") & ~t.startswith("**") & ~t.startswith("goal:")), F.lit(0))
    return out.otherwise(F.coalesce(F.substring(telling, 1, 90), F.substring(text, 1, 85)))
