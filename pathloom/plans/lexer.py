"""Tokens of the statement language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pathloom.values import SemanticError


class SyntaxProblem(SemanticError):
    """Text that is no statement."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (in back-quotes), number, string, op, end
    text: str
    value: object
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_PATTERN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*|//[^\n]*|--\s[^\n]*|/\*.*?\*/)
      | (?P<number>0[xX][0-9a-fA-F]+|\d+\.(?!\.)\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
      | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
      | (?P<name>`[^`]+`)
      | (?P<word>[^\W\d]\w*)
      | (?P<op>\$\^|\$\$|\$-|\.\.|=~|==|!=|<>|<=|>=|->|<-|\+\+|\|\||[-+*/%<>=(){}\[\],;:.|@$!?^&])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def tokenize(text: str) -> list[Token]:
    """All tokens of a text, with an end token."""
    out, at = [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        value: object = s
        if kind == "number":
            value = int(s, 16) if s[:2] in ("0x", "0X") else float(s) if re.search(r"[.eE]", s) else int(s, 8) if len(s) > 1 and s[0] == "0" and s.isdigit() and not set(s) & set("89") else int(s)
        elif kind == "string":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), s[1:-1], flags=re.S)
        elif kind == "name":
            value = s[1:-1]
        if kind != "space":
            out.append(Token(kind, s, value, at))
        at = m.end()
    return [*out, Token("end", "", None, at)]
