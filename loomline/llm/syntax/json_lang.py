"""JSON (RFC 8259)."""

from __future__ import annotations

import re

from loomline.llm.syntax.core import Fault, Reader, Stop, Token

_TOKEN = re.compile(
    r'(?P<space>[ \t\r\n]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z.]))|(?P<word>true|false|null)(?![A-Za-z0-9_])|(?P<mark>[\[\]{}:,])'
)


def _tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            out.append(Token("bad", text[at], at))
            at += 1
            continue
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out


class _Json(Reader):
    def value(self) -> None:
        """Nested values are kept on a stack of their own: depth costs no recursion."""
        open_: list[str] = []
        while True:
            t = self.now
            if t.text in ("{", "[") and t.kind == "mark":
                self.at += 1
                if self.now.text == ("}" if t.text == "{" else "]") and self.now.kind == "mark":
                    self.at += 1
                else:
                    open_.append(t.text)
                    if t.text == "{":
                        self.key()
                    continue
            elif t.kind in ("string", "number", "word"):
                self.at += 1
            else:
                raise self.stop("a value")
            while open_:
                t = self.now
                if t.kind == "mark" and t.text == ",":
                    self.at += 1
                    if open_[-1] == "{":
                        self.key()
                    break
                if t.kind == "mark" and t.text == ("}" if open_[-1] == "{" else "]"):
                    self.at += 1
                    open_.pop()
                    continue
                raise self.stop(f"',' or {'}' if open_[-1] == '{' else ']'!r}")
            else:
                return

    def key(self) -> None:
        if self.now.kind != "string":
            raise self.stop("a key")
        self.at += 1
        if self.now.text != ":":
            raise self.stop("':'")
        self.at += 1


def parse_json(text: str) -> list[Fault]:
    """Recovery: after a fault, go on at the next ',' of the text as if a value began there."""
    p = _Json(text, _tokens(text))
    first = True
    while True:
        p.far = p.at
        try:
            p.value()
            if p.now.kind == "end":
                return p.faults
            if first:
                raise p.stop("the end")
        except Stop:
            p.fault(p.tokens[p.far].pos, p.far_message)
            p.at = max(p.at, p.far)
        first = False
        while p.now.kind != "end" and p.now.text != ",":
            p.at += 1
        if p.now.kind == "end":
            return p.faults
        p.at += 1
        if p.now.kind == "string" and p.peek().text == ":":
            p.at += 2
