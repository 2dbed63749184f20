"""Items of source code with their owners: strings and comments are blanked, braces paired by a stack, headers found between.

A text is read once for the parts where a brace or a word is no code (comments, nested where the language nests them,
strings, raw strings, characters, template literals with the code inside them); these become spaces, so that places
hold. The braces that are left pair up; an item runs from its header to the end of its pair, or to the semicolon
before any brace. Its owner is the item it lies in most closely. Unbalanced code ends at its last line.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.types import Row

_CHAR = re.compile(r"'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'", re.DOTALL)


@dataclass
class Language:
    starts: re.Pattern  # what opens a part that is no code
    headers: list[tuple[str, re.Pattern]]  # kind ("" for that of the first group), and the header with its name last
    nested: bool = False  # block comments nest
    members: re.Pattern | None = None  # a method's header, inside the kinds of ``owners``
    owners: frozenset = field(default_factory=frozenset)


def _headers(*pairs: tuple[str, str]) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p, re.MULTILINE)) for kind, p in pairs]


#: Words that look like a method's name before a parenthesis and are none.
_NOT_NAMES = frozenset("if for while switch catch return function new throw else do sizeof super this await typeof with synchronized".split())
_WORD = r"[A-Za-z_$][\w$]{0,200}"
# headers have bounded parts, so that a search is linear in the text: blanked comments leave long white space
_W, _O = r"[ \t\n]{1,80}", r"[ \t\n]{0,80}"
_LINE = r"^[ \t]*+(?=\S)"
_ANGLE = r"(?:<[^<>{};]{0,300}(?:<[^<>{};]{0,300}>[^<>{};]{0,300}){0,9}>)?"
_ARGUMENTS = r"\([^;{}]{0,2000}\)"
_NOTES = rf"(?:@\w+(?:\([^)\n]{{0,300}}\))?{_W}){{0,9}}"
_C_FUNCTION = (
    rf"{_LINE}(?!return\b|else\b|typedef\b|using\b|namespace\b)(?:[A-Za-z_][\w:<>,*&~\[\] \t]{{0,200}}?[ \t\n*&])?(?:{_WORD}::){{0,9}}(~?{_WORD}){_O}{_ARGUMENTS}{_O}"
    rf"(?:(?:const|noexcept|override|final){_O}){{0,4}}(?::[^;{{}}]{{0,2000}})?(?={{)"
)

RUST = Language(
    re.compile(r"//|/\*|b?r#*\"|\"|'"),
    _headers(
        ("", rf"{_LINE}(?:pub(?:\([^)\n]{{0,99}}\))?{_W})?(?:(?:default|const|async|unsafe){_W}|extern{_W}){{0,5}}(fn|struct|enum|trait|mod){_W}({_WORD})"),
        ("impl", rf"{_LINE}(?:unsafe{_W})?impl\b{_O}{_ANGLE}{_O}(?:[^{{}};]{{0,500}}?\bfor{_W})?(?:\w{{1,99}}::){{0,9}}({_WORD})"),
    ),
    nested=True,
)
GO = Language(
    re.compile(r"//|/\*|`|\"|'"),
    _headers(
        ("method", rf"^func{_O}\([^)\n]{{0,300}}\){_O}({_WORD})"),
        ("function", rf"^func{_W}({_WORD})"),
        ("struct", rf"{_LINE}(?:type{_W})?({_WORD}){_O}(?:\[[^\]\n]{{0,300}}\])?{_W}struct\b"),
        ("interface", rf"{_LINE}(?:type{_W})?({_WORD}){_O}(?:\[[^\]\n]{{0,300}}\])?{_W}interface\b"),
    ),
)
SCRIPT = Language(
    re.compile(r"//|/\*|`|\"|'|[{}]"),
    _headers(
        ("", rf"{_LINE}(?:(?:export|default|declare|abstract|async){_W}){{0,5}}(function|class|interface)\b{_O}\*?{_O}({_WORD})"),
        ("function", rf"{_LINE}(?:export{_W})?(?:const|let){_W}({_WORD}){_O}(?::[^=;]{{0,300}})?={_O}(?:async{_O})?(?:{_ARGUMENTS}|{_WORD}){_O}(?::[^=;{{}}]{{0,300}})?=>"),
    ),
    members=re.compile(rf"{_LINE}(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set){_W}){{0,5}}\*?{_O}(#?{_WORD}){_O}{_ANGLE}{_O}\((?:[^;{{}}]|{{[^{{}};]{{0,300}}}}){{0,2000}}?\){_O}(?::[^;{{}}=]{{0,300}})?(?={{)", re.MULTILINE),
    owners=frozenset({"class"}),
)
JAVA = Language(
    re.compile(r'//|/\*|"""|"|\''),
    _headers(("", rf"{_LINE}{_NOTES}(?:(?:public|private|protected|static|final|abstract|sealed|strictfp){_W}){{0,6}}(class|interface|enum|record){_W}({_WORD})")),
    members=re.compile(rf"{_LINE}{_NOTES}(?:(?:public|private|protected|static|final|abstract|synchronized|native|default){_W}){{0,6}}{_ANGLE}{_O}(?:[\w.<>,?\[\]]{{1,200}}{_W}){{0,6}}({_WORD}){_O}{_ARGUMENTS}{_O}(?:throws{_W}[^;{{}}]{{0,300}})?(?=[{{;])", re.MULTILINE),
    owners=frozenset({"class", "interface", "enum", "record"}),
)
C = Language(
    re.compile(r"//|/\*|R\"[^()\\ ]{0,16}\(|\"|'"),
    _headers(("", rf"{_LINE}(?:typedef{_W})?(class|struct|enum|union){_W}(?:(?:class|struct){_W})?({_WORD})(?=[^;(){{}}]{{0,500}}{{)"), ("function", _C_FUNCTION)),
)
LANGUAGES = {"rs": RUST, "go": GO, "java": JAVA} | dict.fromkeys(("js", "jsx", "ts", "tsx"), SCRIPT) | dict.fromkeys(("c", "cpp", "cc", "cxx", "h", "hpp"), C)


def _comment_end(text: str, at: int, nested: bool) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        if m[0] == "*/":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0 or nested:
            depth += 1
    return len(text)


def _string_end(text: str, at: int, quote: str) -> int:
    """One past the closing quote; a string that its line does not close ends with the line."""
    m = re.compile(rf"(?:\\.|[^\\{quote}\n])*({quote}|(?=\n)|\Z)", re.DOTALL).match(text, at + 1)
    return m.end() if m else len(text)


def masked(text: str, lang: Language) -> str:
    """The text with all that is not code as spaces; lines stay."""
    out, last, at = [], 0, 0
    depth, templates = 0, []  # for template literals: the depths at which their text goes on

    def blank(a: int, b: int) -> int:
        nonlocal last
        out.append(text[last:a])
        out.append(re.sub(r"[^\n]", " ", text[a:b]))
        last = b
        return b

    def template(a: int) -> int:
        """From the text of a template literal to its end, or to the code inside it."""
        m = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*(`|\$\{|\Z)", re.DOTALL).match(text, a)
        if m[1] == "${":
            templates.append(depth)
        return m.end()

    while m := lang.starts.search(text, at):
        t, a = m[0], m.start()
        if t == "//":
            end = text.find("\n", a)
            at = blank(a, len(text) if end < 0 else end)
        elif t == "/*":
            at = blank(a, _comment_end(text, a, lang.nested))
        elif t in "{}":
            at = m.end()
            if t == "}" and templates and templates[-1] == depth:
                templates.pop()
                at = blank(a, template(at))
            else:
                depth += 1 if t == "{" else -1
        elif t == "`":
            at = blank(a, template(a + 1) if lang is SCRIPT else (text.find("`", a + 1) + 1 or len(text)))
        elif t == "'" and lang is not SCRIPT:
            c = _CHAR.match(text, a)
            at = blank(a, c.end()) if c else a + 1  # a lifetime, or a digit's mark
        elif t in ('"', "'"):
            if lang is RUST:  # runs over lines
                c = re.compile(r'(?:\\.|[^\\"])*("|\Z)', re.DOTALL).match(text, a + 1)
                at = blank(a, c.end())
            else:
                at = blank(a, _string_end(text, a, t))
        else:
            close = '"""' if t == '"""' else '"' + "#" * t.count("#") if lang is RUST else ")" + t[2:-1] + '"'
            end = text.find(close, m.end())
            at = blank(a, len(text) if end < 0 else end + len(close))
    return "".join(out) + text[last:]


def pairs(code: str) -> dict[int, int]:
    """One past the closing brace of each opening one; those left open end with the text."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | dict.fromkeys(stack, len(code))


def code_items(text: str, language: str) -> Iterator[Row]:
    """``kind, level, title, start, stop, body, owner`` (title of the item around it, or empty) in order of lines."""
    lang = LANGUAGES[language]
    code = masked(text, lang)
    closing = pairs(code)
    stops = sorted([*closing, *(m.start() for m in re.finditer(";", code))])
    found: dict[int, tuple[int, str, str]] = {}

    def put(begin: int, name_end: int, kind: str, title: str) -> None:
        k = bisect.bisect_left(stops, name_end)
        end = len(code.rstrip()) if k == len(stops) else closing.get(stops[k], stops[k] + 1)
        while code[begin : begin + 1].isspace():
            begin += 1
        found.setdefault(begin, (end, kind, title))

    for kind, pattern in lang.headers:
        for m in pattern.finditer(code):
            if m[m.lastindex] not in _NOT_NAMES:
                put(m.start(), m.end(), kind or m[1], m[m.lastindex])
    if lang.members:
        bodies = [(b, e) for b, (e, kind, _) in found.items() if kind in lang.owners]
        for m in lang.members.finditer(code):
            inside = [b for b, e in bodies if b < m.start() < e]
            # directly in the body of its owner, not in a block below
            if inside and m[1] not in _NOT_NAMES and _depth(code, max(inside), m.start()) == 1:
                put(m.start(), m.end(), "method", m[1])
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect.bisect_right(lines, at)
    rows, around = text.split("\n"), []
    for begin in sorted(found):
        end, kind, title = found[begin]
        while around and around[-1][0] <= begin:
            around.pop()
        owner = next((t for _, k, t in reversed(around) if k in OWNERS), "")
        kind = "method" if kind == "function" and lang is C and owner else kind
        start, stop = line(begin), line(max(begin, end - 1))
        yield Row(kind=kind, level=begin - lines[start - 1], title=title, start=start, stop=stop, body="\n".join(rows[start - 1 : stop]), owner=owner)
        around.append((end, kind, title))


#: Kinds that own what lies in them.
OWNERS = frozenset("impl trait class interface struct enum record mod fn function method union".split())


def _depth(code: str, a: int, b: int) -> int:
    return code.count("{", a, b) - code.count("}", a, b)
