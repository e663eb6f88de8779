"""Text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple


class CypherError(ValueError):
    """The text is not a query of the subset."""


class UnsupportedCypher(CypherError):
    """openCypher that this read-only subset leaves out."""


class Token(NamedTuple):
    kind: str  # word, name (in backticks), number, string, op, end
    text: str
    at: int


_PARTS = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)"
    r"|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)"
    r"|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|`(?P<name>[^`]+)`"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<op><>|!=|<=|>=|=~|\.\.|->|<-|[-+*/%=<>()\[\]{},.:;|$])",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _PARTS.match(text, at)
        if not m:
            raise CypherError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "string":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]
