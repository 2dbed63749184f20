"""Table functions that cut text and source code into named items."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql.types import Row

from .code import LANGUAGES, code_items


def chunk_spans(text: str, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` characters, cut after the last white space if there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            space = max(text.rfind(c, at + 1, end) for c in " \n\t")
            end = space + 1 if space > at else end
        yield text[at:end]
        at = end


@F.udtf(returnType="part int, name string, chunk string")
class ChunkText:
    """``chunk_text(name, text, most)``: numbered chunks whose concatenation is the text."""

    def eval(self, name: str, text: str, most: int):
        for i, c in enumerate(chunk_spans(text or "", most)):
            yield i, f"{name}_part{i}", c


def markdown_items(text: str) -> Iterator[Row]:
    """Front matter, sections (each to the next heading of its level or above) and fenced code."""
    rows = text.split("\n")
    start = 0
    if rows and rows[0].strip() == "---":
        for k in range(1, len(rows)):
            if rows[k].strip() == "---":
                yield Row(kind="frontmatter", level=0, title="", start=1, stop=k + 1, body="\n".join(rows[1:k]), owner="")
                start = k + 1
                break
    fence, heads = None, []
    for k in range(start, len(rows)):
        mark = re.match(r"^(```|~~~)\s*(\S*)", rows[k])
        if mark and fence is None:
            fence = (k, mark[1], mark[2])
        elif mark and fence and rows[k].startswith(fence[1]):
            yield Row(kind="code", level=0, title=fence[2], start=fence[0] + 1, stop=k + 1, body="\n".join(rows[fence[0] + 1 : k]), owner="")
            fence = None
        elif fence is None and (h := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", rows[k])):
            heads.append((k, len(h[1]), h[2]))
    for n, (k, level, title) in enumerate(heads):
        stop = next((j for j, other, _ in heads[n + 1 :] if other <= level), len(rows))
        yield Row(kind="section", level=level, title=title, start=k + 1, stop=stop, body="\n".join(rows[k:stop]), owner=next((t for j, other, t in reversed(heads[:n]) if other < level), ""))


def toml_items(text: str) -> Iterator[Row]:
    rows = text.split("\n")
    heads = [(k, m[1], m[2]) for k, r in enumerate(rows) if (m := re.match(r"^\s*(\[\[?)\s*([^\]]+?)\s*\]\]?\s*(?:#.*)?$", r))]
    for n, (k, mark, title) in enumerate(heads):
        stop = heads[n + 1][0] if n + 1 < len(heads) else len(rows)
        yield Row(kind="table_array" if mark == "[[" else "table", level=0, title=title, start=k + 1, stop=stop, body="\n".join(rows[k:stop]).rstrip(), owner="")


def python_items(text: str) -> Iterator[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    rows, owners = text.split("\n"), {}
    for node in ast.walk(tree):
        own = getattr(node, "name", None) if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else owners.get(node, "")
        for child in ast.iter_child_nodes(node):
            owners[child] = own
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield Row(kind=kind, level=node.col_offset, title=node.name, start=node.lineno, stop=node.end_lineno, body="\n".join(rows[node.lineno - 1 : node.end_lineno]), owner=owners.get(node, ""))


def leading_comment(rows: list[str], start: int) -> str:
    """The contiguous comment lines just above a line (1-based)."""
    out = []
    for r in reversed(rows[: start - 1]):
        if not re.match(r"^\s*(///?!?|#(?!\[)|\*|/\*)", r):
            break
        out.append(re.sub(r"^\s*(///?!?|#|/?\*+/?)\s?", "", r).strip())
    return "\n".join(reversed(out))


@F.udtf(returnType="kind string, level int, title string, start int, stop int, body string, doc string, label string, owner string")
class ExtractItems:
    """``extract_items(language, text)``: items of markdown, TOML or source code."""

    def eval(self, language: str, text: str):
        text = text or ""
        by = {"md": markdown_items, "toml": toml_items, "py": python_items}
        items = by[language](text) if language in by else code_items(text, language) if language in LANGUAGES else ()
        rows = text.split("\n")
        for r in items:
            doc = leading_comment(rows, r.start) if language not in ("md", "toml") else ""
            head = r.body.split("\n", 1)[0].strip()
            yield r.kind, r.level, r.title, r.start, r.stop, r.body, doc, f"{r.title}: {doc} — {head}", r.owner


def register(spark) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("extract_items", ExtractItems)
