"""What the parsers share: tokens, faults, and a reader with limited backtracking."""

from __future__ import annotations

from dataclasses import dataclass


class Token:
    __slots__ = ("kind", "pos", "text", "up")

    def __init__(self, kind: str, text: str, pos: int, up: str = ""):
        self.kind, self.text, self.pos, self.up = kind, text, pos, up


@dataclass(frozen=True)
class Fault:
    pos: int
    line: int
    message: str


class Stop(Exception):
    """The text can't go on like this; the reader knows the furthest place where that happened."""


class Reader:
    def __init__(self, source: str, tokens: list[Token]):
        self.source, self.tokens, self.at = source, tokens, 0
        self.faults: list[Fault] = []
        self.far, self.far_message = 0, ""
        self.known: dict[tuple, int] = {}

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def stop(self, wanted: str) -> Stop:
        if self.at >= self.far:
            t = self.now
            self.far, self.far_message = self.at, f"{'end of text' if t.kind == 'end' else repr(t.text[:40])} where {wanted} should stand"
        return Stop()

    def fault(self, pos: int, message: str) -> None:
        self.faults.append(Fault(pos, self.source.count("\n", 0, pos) + 1, message))

    def attempt(self, rule, *args) -> bool:
        """Try a rule; if it stops, go back."""
        start = self.at
        try:
            self.once(rule, *args)
            return True
        except Stop:
            self.at = start
            return False

    def once(self, rule, *args) -> None:
        """Apply a rule, whose outcome depends on the place alone: where it was tried before, that outcome is taken. So
        the time is linear in the text, however deep alternatives are nested."""
        key = (getattr(rule, "__func__", rule), self.at, args)
        end = self.known.get(key)
        if end is None:
            try:
                rule(*args)
            except Stop:
                self.known[key] = -1
                raise
            self.known[key] = self.at
        elif end < 0:
            raise Stop
        else:
            self.at = end
