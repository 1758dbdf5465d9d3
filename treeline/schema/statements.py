"""Module text as a tree of generic statements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from treeline.errors import SchemaSyntaxError

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      |(?P<mark>[{};])
      |(?P<double>"(?:[^"\\]|\\.)*")
      |(?P<single>'[^']*')
      |(?P<plus>\+(?=\s|["']))
      |(?P<word>(?:[^\s{};"'/]|/(?![/*]))(?:[^\s{};"'/]|/(?![/*])|["'](?=[^\s{};]))*)""",
    re.X | re.S,
)

#: Keywords of the language (fixed values).
KEYWORDS = frozenset(
    """action anydata anyxml argument augment base belongs-to bit case choice config contact container
    default description deviate deviation enum error-app-tag error-message extension feature
    fraction-digits grouping identity if-feature import include input key leaf leaf-list length list
    mandatory max-elements min-elements modifier module must namespace notification ordered-by
    organization output path pattern position prefix presence range reference refine require-instance
    revision revision-date rpc status submodule type typedef unique units uses value when
    yang-version yin-element""".split()
)
ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}


@dataclass
class Statement:
    """A keyword with its argument and substatements."""

    keyword: str
    arg: str | None = None
    subs: list[Statement] = field(default_factory=list)
    line: int = 0

    def all(self, *keywords: str) -> Iterator[Statement]:
        return (s for s in self.subs if s.keyword in keywords)

    def one(self, keyword: str) -> Statement | None:
        return next(self.all(keyword), None)

    def value(self, keyword: str, default: str | None = None) -> str | None:
        found = self.one(keyword)
        return found.arg if found else default


def _double(text: str, column: int) -> str:
    """A double-quoted string: indentation up to the opening quote goes from later lines, blanks from line ends."""
    lines = text.split("\n")
    for i in range(1, len(lines)):
        shown, k = 0, 0
        while k < len(lines[i]) and shown <= column and lines[i][k] in " \t":
            shown += 8 if lines[i][k] == "\t" else 1
            k += 1
        lines[i] = lines[i][k:]
    joined = "\n".join([*(line.rstrip(" \t") for line in lines[:-1]), lines[-1]])
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), joined, flags=re.S)


def tokens(text: str, source: str | None = None) -> Iterator[tuple[str, str, int]]:
    """(kind, value, line): marks, and strings with their pieces joined."""
    at, line, joining = 0, 1, False
    held: tuple[str, str, int] | None = None
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SchemaSyntaxError(f"unexpected character {text[at]!r}", line, source)
        kind, value = m.lastgroup, m.group()
        if kind in ("double", "single"):
            column = at - (text.rfind("\n", 0, at) + 1)
            value = _double(value[1:-1], column) if kind == "double" else value[1:-1]
            kind = "string"
        if kind == "plus" and held and held[0] == "string":
            joining = True
        elif kind != "space":
            if joining:
                if kind != "string":
                    raise SchemaSyntaxError("a quoted string must follow '+'", line, source)
                held, joining = ("string", held[1] + value, held[2]), False
            else:
                if held:
                    yield held
                held = ("word" if kind == "plus" else kind, value, line)
        line += m.group().count("\n")
        at = m.end()
    if held:
        yield held


def parse(text: str, source: str | None = None) -> Statement:
    """The single top statement (module or submodule) of a text."""
    stream = tokens(text, source)
    root = Statement("", None)
    stack = [root]
    open_: Statement | None = None
    line = 1
    for kind, value, line in stream:
        if kind == "mark":
            if value == "}":
                if open_ or len(stack) == 1:
                    raise SchemaSyntaxError("unexpected '}'", line, source)
                stack.pop()
                continue
            if not open_:
                raise SchemaSyntaxError(f"unexpected {value!r}", line, source)
            stack[-1].subs.append(open_)
            if value == "{":
                stack.append(open_)
            open_ = None
        elif not open_:
            if kind == "string" or ":" not in value and value not in KEYWORDS:
                raise SchemaSyntaxError(f"unknown statement {value!r}", line, source)
            open_ = Statement(value, line=line)
        elif open_.arg is None:
            open_.arg = value
        else:
            raise SchemaSyntaxError(f"expected ';' or '{{' after {open_.keyword} {open_.arg!r}, got {value!r}", line, source)
    if open_ or len(stack) > 1:
        raise SchemaSyntaxError("unexpected end of text", line, source)
    if len(root.subs) != 1 or root.subs[0].keyword not in ("module", "submodule") or not root.subs[0].arg:
        raise SchemaSyntaxError("expected one module or submodule", 1, source)
    return root.subs[0]
