"""Main text of pages: the articles of the tables, the blocks of odd markup, and repeats against brute force."""

import html
import random
import re
from collections import defaultdict

import pytest

from vecloom.llm import main_text, queries

CLASH = "page_id long, url string, html string, row int, host string, page int, text int, words int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 2, 3, 4) for r in rows], CLASH)


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    parts = (html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", p))) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(" ".join(p.split()) for p in parts if p.split())


def test_articles_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op12_main_text(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = article(r["html"])
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], want, len(want))


def kept(page):
    texts, kinds = main_text.blocks_of(page)
    return [t for t, k in zip(texts, kinds) if k == main_text.DECLARED]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three</p><p>four &lt;b&gt; &eacute;&#233;&#xe9; &am</article>", ["A & B", "one two three", "four <b> éé\xe9 &am"]),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>x</p><div class='share-buttons'>s</div><aside>a</aside><p>y</p><section id='comments'><p>c</p></section></article>", ["T", "x", "y"]),
        ("<main><p>in main</p></main><p>out", ["in main"]),
        ("<main><p>teaser</p><article><p>in</p></article></main>", ["in"]),
        ("<div class='post-content'><p>body</p><form><label>f</label></form></div><div class='sidebar'>s</div>", ["body"]),
        ("<article><p>a</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><template><p>t</p></template><noscript>n</noscript><p hidden>h</p><p style='display: none'>d</p><p>b</p></article>", ["a", "b"]),
        ("<article><ul><li>one<li>two <b>three</b></ul><table><tr><td>c1<td>c2</table><p>p1<p>p2<div>d</div>tail</article>", ["one", "two three", "c1", "c2", "p1", "p2", "d", "tail"]),
        ("<article><p>a</p><div class='ad'>x</div><p class='notice'>n</p><nav><a>m</a></nav><p>b <span class='ad'>z</span> c</p></article><article class='comment'><p>c</p></article>", ["a", "b", "c"]),
        ("<article><p>1 < 2 and 3 > 2 <unclosed", ["1 < 2 and 3 > 2 <unclosed"]),
        ("<article class='has-sidebar'><p>" + "long " * 50_000 + "</p></article>", [("long " * 50_000).strip()]),
        ("<ARTICLE><P TITLE='a>b'>Caps</P></ARTICLE><footer>f</footer>", ["Caps"]),
    ],
)
def test_blocks_of_markup(page, want):
    assert kept(page) == want


def brute(rows):
    """Pages without declared text: words of blocks in a run of five that three distinct pages of the host hold."""
    hosts = defaultdict(dict)
    for _, url, page in rows:
        hosts[url.split("/")[2]][page] = [w for p in re.findall("<p>(.*?)</p>", page) for w in p.split()]
    out = {}
    for i, url, page in rows:
        has = defaultdict(set)
        for other, words in hosts[url.split("/")[2]].items():
            for k in range(len(words) - 4):
                has[tuple(words[k : k + 5])].add(other)
        words = hosts[url.split("/")[2]][page]
        covered = {j for k in range(len(words) - 4) if len(has[tuple(words[k : k + 5])]) >= 3 for j in range(k, k + 5)}
        at, text = 0, []
        for p in re.findall("<p>(.*?)</p>", page):
            n = len(p.split())
            if len(covered & set(range(at, at + n))) < 0.8 * n:
                text.append(p)
            at += n
        out[i] = ("\n\n".join(text), len(covered))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_repeats_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(main_text, "CHUNK", chunk)
    rnd = random.Random(5)
    word = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    menus, rows = [word(7) for _ in range(3)], []
    for k in range(90):
        body = [rnd.choice(menus), *(word(rnd.randrange(1, 9)) for _ in range(rnd.randrange(5))), rnd.choice(menus)]
        rows.append((k, f"https://h{k % 4}.example.com/{k}", "".join(f"<p>{p}</p>" for p in body)))
    rows += [(100 + k, f"https://copy.example.com/{k}", "<p>the same text on many pages of a host</p>") for k in range(20)]
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in main_text.main_text(pages(spark, rows)).collect()}
    assert got == brute(rows)
    assert got[100] == ("the same text on many pages of a host", 0)  # equal pages count once


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "not a url", "<article><p>x</p></article>"), (4, "https://u@h.example.com:80/", "plain"), (4, "https://u@h.example.com:80/", "plain")]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.main_text(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "", "", 0), (None, "not a url", "x", 1), (4, rows[3][1], "plain", 5), (4, rows[3][1], "plain", 5)], key=str)
    assert main_text.main_text(pages(spark, [])).count() == 0
