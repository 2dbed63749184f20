"""Main text of web pages: what repeats across the pages of a host, found in the host's suffix array, is taken away.

1. Each page is read into blocks of text in page order. A block is *declared* (inside the page's ``article``, else
   a body marked as its content, else ``main``), *marked* (navigation, headers, footers, asides, forms, comments,
   notices, adverts: by element, role or class) or *open*. Scripts, styles, hidden parts and markup are no text.
2. The words of all blocks that are not declared make the page's token stream. Pages of a host with equal text
   count once. A host's streams are concatenated (hosts of many words in several chunks), and their suffixes are sorted by
   their first ``WORDS`` words, by rank doubling; a run of that length on ``PAGES`` distinct pages repeats. Longer
   repeats are the union of such runs. Chunks of one host exchange the runs that they hold and how many pages have
   each, so that a run is found wherever its pages lie.
3. A block most of whose words are covered by repeats is boilerplate. Declared blocks stay (copies and passages that
   articles share are text), open blocks stay if they do not repeat, marked blocks go.

Edge cases: null and empty html give the empty text; a null url is a host of its own, shared by all pages without one;
broken markup is read as far as it goes (unclosed elements end with their parent, an unclosed script with the page);
very long texts are kept whole; rows that repeat each get their text; an empty table gives no rows; of extra columns
nothing is returned. References that are not complete (``&am``) stay as they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, left_join, slices, text_of

WORDS = 5
PAGES = 3
COVERED = 0.8
CHUNK = 1 << 17
SLICE = 4 << 20
OPEN, MARKED, DECLARED = 0, 1, 2

#: Elements whose text is never shown as text.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT_ELEMENTS = frozenset("nav footer aside form button select dialog menu svg object canvas video audio map datalist head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that mark what is not the article.
OUT_WORDS = frozenset(
    """ad ads adv advert advertisement adverts advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices
    newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer
    masthead topbar comment comments disqus respond replies reply login search popup modal overlay toolbar pagination pager""".split()
)
ARTICLE_OUT_WORDS = frozenset("ad ads advert advertisement sponsored promo related comment comments reply replies".split())
CONTENT_CLASS = re.compile(r"(?:^|\s)(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)(?:\s|$)", re.IGNORECASE)

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?][^>]*>?)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


# ---- blocks of a page ---------------------------------------------------------------------


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def standing(name: str, attrs: dict[str, str], in_article: bool) -> tuple[bool, bool, int]:
    """Of an element: whether it is hidden, whether it is marked as no part of the article, and how strongly it declares the article."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True, False, 0
    role = attrs.get("role", "").lower()
    label = attrs.get("class", "") + " " + attrs.get("id", "")
    words = {w.lower() for w in _PART.findall(label)}
    if name == "article" or role == "article":
        return False, bool(words & ARTICLE_OUT_WORDS), 3
    if name in ("html", "body"):
        return False, False, 0
    if name == "main" or role == "main":
        return False, False, 1
    out = name in OUT_ELEMENTS or role in OUT_ROLES or bool(words & OUT_WORDS) or (not in_article and (name == "header" or "header" in words))
    body = attrs.get("itemprop", "").lower() == "articlebody" or bool(CONTENT_CLASS.search(label))
    return False, out and not body, 2 if body else 0


def blocks_of(page: str) -> tuple[list[str], list[int]]:
    """The texts of the blocks in page order, and whether each is open, marked or declared."""
    texts: list[str] = []
    levels: list[int] = []  # -1: marked
    stack: list[tuple[str, bool, bool, int]] = []  # name, hidden, marked, level
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            t = " ".join("".join(held).split())
            held.clear()
            if t:
                _, _, marked, level = stack[-1] if stack else ("", False, False, 0)
                texts.append(t)
                levels.append(-1 if marked else level)

    def drop(k: int) -> None:
        if any(e[0] in BLOCKS or e[2] for e in stack[k:]):
            flush()
        del stack[k:]

    def shown(text: str) -> None:
        if text and not (stack and stack[-1][1]):
            held.append(entities.unescape(text))

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            shown(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a bare sign
            shown(page[at : lt + 1])
            at = lt + 1
            continue
        shown(page[at:lt])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                drop(k)
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            shown(" ")
            continue
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph, or item of the same list, ends here
                if stack[k][0] == "p" or (name == stack[k][0] == "li") or (name in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                    drop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m["attrs"].endswith("/") and name in ("svg", "path", "use", "circle", "rect", "line", "polygon", "g"):
            continue
        _, hidden, marked, level = stack[-1] if stack else ("", False, False, 0)
        own = standing(name, attributes(m["attrs"]), level == 3)
        if own[1] and not marked:
            flush()  # the text before it has another standing
        stack.append((name, hidden or own[0], marked or own[1], max(level, own[2])))
    flush()
    top = max((v for v in levels if v > 0), default=0)
    return texts, [MARKED if v < 0 else DECLARED if top and v >= top else OPEN for v in levels]


def read_pages(pages: DataFrame, schema: str, make) -> DataFrame:
    """``make`` of ``(page_id, url, host, digest, texts, kinds)`` for some pages at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(3), SLICE):
                got = [blocks_of(page) for page in b.column(3)[lo:hi].to_pylist()]
                digests = pa.array([xxhash.xxh64_intdigest("\0".join([*texts, *map(str, kinds)])) - (1 << 63) for texts, kinds in got], pa.int64())
                yield make(*(b.column(c)[lo:hi] for c in range(3)), digests, got)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), text_of("html").alias("html"))
    return rows.mapInArrow(run, schema)


def streams(pages: DataFrame) -> DataFrame:
    """``host, page, words, sizes`` of each distinct page with words to look at: their hashes, and how many each block has."""

    def make(page_id, url, host, digests, got) -> pa.RecordBatch:
        words = [[[] if k == DECLARED else t.split() for t, k in zip(*page)] for page in got]
        raw = pa.array([np.array([xxhash.xxh64_intdigest(w) for ws in page for w in ws], "<u8").tobytes() for page in words], pa.binary())
        sizes = pa.array([list(map(len, page)) for page in words], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([host, digests, raw, sizes], ["host", "page", "words", "sizes"])

    rows = read_pages(pages, "host string, page long, words binary, sizes array<int>", make).where(F.octet_length("words") > 0)
    return cut(rows.groupBy("host", "page").agg(F.first("words").alias("words"), F.first("sizes").alias("sizes")), "streams", stay=True)


def packed(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: the texts of its blocks, compressed, since they travel once; marked ones are left empty."""

    def make(page_id, url, host, digests, got) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=9)
        blobs = [pack.compress("\0".join("" if k == MARKED else t.replace("\0", " ") for t, k in zip(*page)).encode()) for page in got]
        kinds = pa.array([bytes(kinds) for _, kinds in got], pa.binary())
        return pa.RecordBatch.from_arrays([page_id, url, host, digests, pa.array(blobs, pa.binary()), kinds], ["page_id", "url", "host", "page", "texts", "kinds"])

    return read_pages(pages, "page_id long, url string, host string, page long, texts binary, kinds binary", make)


# ---- suffix arrays of hosts ---------------------------------------------------------------


class Suffixes:
    """The streams of some pages end to end, and their suffixes sorted by the first ``WORDS`` words."""

    def __init__(self, streams: list[np.ndarray]):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.words = np.concatenate([*streams, np.zeros(0, np.uint64)])
        self.page = np.repeat(np.arange(len(streams)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        n = len(self.words)
        # suffixes with fewer words than that before their page ends cannot begin a run
        full = np.repeat(self.starts + sizes, sizes) - np.arange(n) >= WORDS
        rank, width = np.unique(self.words, return_inverse=True)[1].astype(np.int64), 1
        while width < WORDS:
            step = min(width, WORDS - width)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) if n else rank
            width += step
        self.order = np.flatnonzero(full)[np.argsort(rank[full], kind="stable")]
        ordered = rank[self.order]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        # pages are in order of place, so that equal ones lie side by side within a class
        new = np.ones(len(self.order), bool)
        if len(self.order):
            new[1:] = (self.page[self.order[1:]] != self.page[self.order[:-1]]) | (ordered[1:] != ordered[:-1])
        self.pages = np.add.reduceat(new.astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)

    def runs(self) -> list[bytes]:
        """The words of each class of suffixes."""
        at = self.order[self.first][:, None] + np.arange(WORDS)
        return [w.tobytes() for w in self.words[at]] if len(at) else []

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which words lie in a run of the classes that repeat."""
        n = np.diff(np.append(self.first, len(self.order)))
        begins = self.order[np.repeat(repeated, n)]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + WORDS, -1)
        return np.cumsum(edge[:-1]) > 0


def _streams(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(w.as_buffer(), "<u8") for w in t.column("words")]


def repeats(pages: DataFrame) -> DataFrame:
    """``host, page, gone, n_repeated``: the blocks of each distinct page that repeats cover, and its covered words."""
    sized = streams(pages)
    parts = sized.groupBy("host").agg(F.ceil(F.sum(F.octet_length("words")) / (8 * CHUNK)).cast("int").alias("parts")).where("parts > 1")
    chunk = F.pmod(F.xxhash64("page"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = left_join(sized, parts, ["host"]).withColumn("chunk", chunk)

    def held(t: pa.Table) -> pa.Table:
        s = Suffixes(_streams(t))
        runs = s.runs()
        one = lambda c, kind: pa.array([t.column(c)[0].as_py()] * len(runs), kind)
        return pa.table([one("host", pa.string()), one("chunk", pa.int32()), pa.array(runs, pa.binary()), pa.array(s.pages)], ["host", "chunk", "run", "n"])

    mine = dealt.where("parts > 1").select("host", "chunk", "words").groupBy("host", "chunk").applyInArrow(held, "host string, chunk int, run binary, n long")
    mine = cut(mine, "runs", stay=True)
    often = mine.groupBy(F.col("host").alias("h"), F.col("run").alias("r")).agg(F.sum("n").alias("total")).where(F.col("total") >= PAGES)
    known = mine.join(often, (F.col("host") == F.col("h")) & (F.col("run") == F.col("r"))).select("host", "chunk", "run")
    out = "host string, page long, gone array<int>, n_repeated long"

    def cover(t: pa.Table, k: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64())], ["host", "page", "gone", "n_repeated"])
        s = Suffixes(_streams(t))
        repeated = s.pages >= PAGES
        if k.num_rows:
            others = set(k.column("run").to_pylist())
            repeated |= np.fromiter((r in others for r in s.runs()), bool, len(repeated))
        covered = np.concatenate(([0], np.cumsum(s.covered(repeated))))
        gone, n = [], []
        for start, sizes in zip(s.starts.tolist(), t.column("sizes").to_pylist()):
            ends = start + np.cumsum(sizes)
            own = covered[ends] - covered[ends - sizes]
            gone.append(np.flatnonzero((own >= COVERED * np.array(sizes)) & (own > 0)).tolist())
            n.append(int(own.sum()))
        return pa.table([t.column("host"), t.column("page"), pa.array(gone, pa.list_(pa.int32())), pa.array(n)], ["host", "page", "gone", "n_repeated"])

    left = dealt.select("host", "chunk", "page", "words", "sizes")
    right = known.select(*[F.col(c).alias(c) for c in known.columns])
    return left.groupBy("host", "chunk").cogroup(right.groupBy("host", "chunk")).applyInArrow(cover, out)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars`` and ``n_repeated``, the words that the host's suffix array covers."""
    both = left_join(packed(pages), repeats(pages), ["host", "page"]).select("page_id", "url", "texts", "kinds", "gone", "n_repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for lo, hi in slices(b.column(2), SLICE):
                part, out = b.slice(lo, hi - lo), []
                for blob, kinds, gone in zip(*(part.column(c).to_pylist() for c in (2, 3, 4))):
                    texts, away = unpack.decompress(blob).decode().split("\0"), set(gone or ())
                    out.append("\n\n".join(t for i, (t, k) in enumerate(zip(texts, kinds)) if k == DECLARED or (k == OPEN and i not in away)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64()), part.column(5).fill_null(0)], ["page_id", "url", "text", "n_chars", "n_repeated"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_repeated long")
