"""Tokens of the Cypher subset."""

from __future__ import annotations

import re
from dataclasses import dataclass


class CypherError(ValueError):
    """The text is no query of the supported subset."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted (back-quoted name), string, number, param, symbol, end
    text: str
    at: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
      | (?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      | (?P<quoted>`[^`]+`)
      | (?P<param>\$[A-Za-z_]\w*)
      | (?P<name>[^\W\d]\w*)
      | (?P<symbol><=|>=|<>|=~|\.\.|[-+*/%^=<>()\[\]{},.:;|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(body: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), body, flags=re.S)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind in ("string", "quoted"):
            value = _unescaped(value[1:-1]) if kind == "string" else value[1:-1]
        if kind != "skip":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]
