"""Python 3."""

from __future__ import annotations

import re

from loomline.llm.syntax.core import Fault, Reader, Stop, Token

# Fixed values of the language.
_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
    r"|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[jJ])?"
)
_NAME = re.compile(r"[^\W\d]\w*")
_PREFIX = re.compile(r"(?i:(?P<p>[rbuft]|br|rb|fr|rf|tr|rt))?(?P<q>'''|\"\"\"|'|\")")
_MARK = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_BINARY = {"|": 10, "^": 20, "&": 30, "<<": 40, ">>": 40, "+": 50, "-": 50, "*": 60, "/": 60, "//": 60, "%": 60, "@": 60}
_COMPARE = frozenset("< > == >= <= !=".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Bad(Exception):
    def __init__(self, pos: int, message: str):
        self.pos, self.message = pos, message


class _Lexer:
    def __init__(self, text: str):
        self.text, self.out, self.at = text, [], 0
        self.brackets: list[tuple[str, int]] = []
        self.indents = [(0, 0)]
        self.faults: list[tuple[int, str]] = []

    def run(self) -> list[Token]:
        text, n = self.text, len(self.text)
        if text.startswith("﻿"):
            self.at = 1
        line_start = True
        while self.at < n:
            if line_start and not self.brackets:
                line_start = False
                if self.indentation():
                    line_start = True
                    continue
                if self.at >= n:
                    break
            c = text[self.at]
            if c in " \t\f":
                self.at += 1
            elif c in "\r\n":
                self.at += 2 if text.startswith("\r\n", self.at) else 1
                if not self.brackets:
                    self.add("newline", "\n")
                    line_start = True
            elif c == "#":
                while self.at < n and text[self.at] not in "\r\n":
                    self.at += 1
            elif c == "\\" and text[self.at + 1 : self.at + 2] in ("\n", "\r"):
                self.at += 3 if text.startswith("\r\n", self.at + 1) else 2
                if self.at >= n:
                    self.faults.append((n, "the text ends after a line joint"))
            else:
                try:
                    self.token()
                except _Bad as e:
                    self.faults.append((e.pos, e.message))
                    self.add("bad", c)
        if self.brackets:
            self.faults.append((self.brackets[-1][1], f"{self.brackets[-1][0]!r} is never closed"))
        if self.out and self.out[-1].kind != "newline":
            self.add("newline", "\n")
        for _ in self.indents[1:]:
            self.add("dedent", "")
        self.add("end", "")
        return self.out

    def add(self, kind: str, text: str, pos: int | None = None) -> None:
        self.out.append(Token(kind, text, min(self.at if pos is None else pos, len(self.text))))

    def indentation(self) -> bool:
        """Blanks at the start of a line; True for a line without code."""
        text, n, start = self.text, len(self.text), self.at
        col = alt = 0
        while self.at < n and text[self.at] in " \t\f":
            c = text[self.at]
            if c == " ":
                col, alt = col + 1, alt + 1
            elif c == "\t":
                col, alt = (col // 8 + 1) * 8, alt + 1
            else:
                col = alt = 0
            self.at += 1
        if self.at >= n or text[self.at] in "#\r\n":
            while self.at < n and text[self.at] not in "\r\n":
                self.at += 1
            if self.at < n:
                self.at += 2 if text.startswith("\r\n", self.at) else 1
            return True
        if text[self.at] == "\\" and text[self.at + 1 : self.at + 2] in ("\n", "\r"):
            return False
        top = self.indents[-1]
        if col == top[0]:
            if alt != top[1]:
                self.faults.append((start, "tabs and blanks are mixed"))
        elif col > top[0]:
            if alt <= top[1]:
                self.faults.append((start, "tabs and blanks are mixed"))
            self.indents.append((col, alt))
            self.add("indent", "")
        else:
            while self.indents[-1][0] > col:
                self.indents.pop()
                self.add("dedent", "")
            if self.indents[-1][0] != col:
                self.faults.append((start, "the indentation fits no outer block"))
                self.indents.append((col, alt))
            elif self.indents[-1][1] != alt:
                self.faults.append((start, "tabs and blanks are mixed"))
        return False

    def token(self) -> None:
        text, at = self.text, self.at
        m = _PREFIX.match(text, at)
        if m:
            self.string(m)
            return
        c = text[at]
        if c.isdigit() and c.isascii() or c == "." and text[at + 1 : at + 2].isdigit():
            m = _NUMBER.match(text, at)
            word = m.group()
            self.at = m.end()
            after = text[self.at : self.at + 1]
            if after == "_" or (after.isalnum() and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", text[self.at :])):
                bad = self.at
                self.at = _NAME.match(text, self.at).end() if _NAME.match(text, self.at) else self.at + 1
                raise _Bad(bad, "a number runs into a name")
            if len(word) > 1 and word[0] == "0" and re.fullmatch(r"[0-9_]+", word) and word.strip("0_"):
                raise _Bad(at, "a decimal number begins with 0")
            self.out.append(Token("number", word, at))
            return
        m = _NAME.match(text, at)
        if m and m.group().isidentifier():
            self.at = m.end()
            self.out.append(Token("key" if m.group() in _KEYWORDS else "name", m.group(), at))
            return
        m = _MARK.match(text, at)
        if not m:
            self.at += 1
            raise _Bad(at, f"the character {c!r} can't stand here")
        mark = m.group()
        self.at = m.end()
        if mark in _CLOSE:
            self.brackets.append((mark, at))
        elif mark in (")", "]", "}"):
            if not self.brackets:
                raise _Bad(at, f"{mark!r} closes nothing")
            if _CLOSE[self.brackets[-1][0]] != mark:
                was = self.brackets.pop()[0]
                raise _Bad(at, f"{mark!r} can't close {was!r}")
            self.brackets.pop()
        self.out.append(Token("mark", mark, at))

    def string(self, m: re.Match) -> None:
        text, start, q = self.text, self.at, m["q"]
        prefix = (m["p"] or "").lower()
        self.at = m.end()
        if "f" in prefix or "t" in prefix:
            self.formatted(start, q, "r" in prefix)
        else:
            while True:
                if self.at >= len(text) or len(q) == 1 and text[self.at] in "\r\n":
                    raise _Bad(start, "a string that doesn't end")
                if text[self.at] == "\\":
                    self.at += 3 if text.startswith("\\\r\n", self.at) else 2
                elif text.startswith(q, self.at):
                    self.at += len(q)
                    break
                else:
                    self.at += 1
            body = text[m.end() : self.at - len(q)]
            if "b" in prefix and not body.isascii():
                raise _Bad(start, "bytes hold only ASCII characters")
            if "r" not in prefix and "\\" in body and re.search(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})" + ("" if "b" in prefix else r"|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{[^}]+\})") + ")", body):
                raise _Bad(start, "a broken escape in a string")
        self.out.append(Token("bytes" if "b" in prefix else "string", text[start : self.at], start))

    def formatted(self, start: int, q: str, raw: bool) -> None:
        """An f-string; its fields are parsed as expressions."""
        text = self.text
        while True:
            if self.at >= len(text) or len(q) == 1 and text[self.at] in "\r\n":
                raise _Bad(start, "a string that doesn't end")
            if text.startswith(q, self.at):
                self.at += len(q)
                return
            c = text[self.at]
            if c == "\\" and not raw and text.startswith("\\N{", self.at) and "}" in text[self.at :]:
                self.at = text.index("}", self.at) + 1
            elif c == "\\":
                self.at += 1 if text[self.at + 1 : self.at + 2] in ("{", "}") else 2
            elif c in "{}" and text[self.at + 1 : self.at + 2] == c:
                self.at += 2
            elif c == "}":
                raise _Bad(self.at, "a single '}' in an f-string")
            elif c == "{":
                self.field(start, q)
            else:
                self.at += 1

    def field(self, start: int, q: str) -> None:
        text, open_ = self.text, self.at
        self.at += 1
        begin, depth = self.at, []
        while True:
            if self.at >= len(text):
                raise _Bad(open_, "a field of an f-string that doesn't end")
            c = text[self.at]
            m = _PREFIX.match(text, self.at)
            if m:
                inner = _Lexer(text)
                inner.at = self.at
                inner.string(m)
                self.at = inner.at
            elif c in "([{":
                depth.append(c)
                self.at += 1
            elif depth and c in ")]}":
                if _CLOSE[depth.pop()] != c:
                    raise _Bad(self.at, "brackets don't match in an f-string")
                self.at += 1
            elif not depth and (c in "}:" or c == "!" and text[self.at + 1 : self.at + 2] != "=" or c == "=" and re.match(r"=\s*[}:!]", text[self.at :]) and text[self.at - 1] not in "=!<>"):
                break
            else:
                self.at += 1
        expression = text[begin : self.at]
        if not expression.strip():
            raise _Bad(begin, "an empty field in an f-string")
        faults = _expression_faults(expression)
        if faults:
            raise _Bad(begin + faults[0].pos, faults[0].message)
        if text[self.at] == "=":
            self.at += 1
            while text[self.at : self.at + 1].isspace():
                self.at += 1
        if text[self.at : self.at + 1] == "!":
            if not re.match(r"![rsa]\s*[:}]", text[self.at :]):
                raise _Bad(self.at, "a wrong conversion in an f-string")
            self.at += 2
            while text[self.at : self.at + 1].isspace():
                self.at += 1
        if text[self.at : self.at + 1] == ":":
            self.at += 1
            while True:
                c = text[self.at : self.at + 1]
                if not c or c in "\r\n" and len(q) == 1 or text.startswith(q, self.at):
                    raise _Bad(open_, "a field of an f-string that doesn't end")
                if c == "{":
                    self.field(start, q)
                elif c == "}":
                    break
                else:
                    self.at += 1
        if text[self.at : self.at + 1] != "}":
            raise _Bad(self.at, "'}' is missing in an f-string")
        self.at += 1


# What an expression is, as far as it matters to where it may stand.
NAME, ATTR, ITEM, STAR, TUPLE, LIST, CONST, OTHER, WALRUS, YIELD, GEN = range(11)
Shape = tuple  # (kind, children, in brackets)
_OTHER: Shape = (OTHER, (), False)


class _Python(Reader):
    def is_(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in ("mark", "key")

    def word(self, text: str) -> bool:
        return self.now.kind == "name" and self.now.text == text

    def take(self, text: str) -> bool:
        if self.is_(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.is_(text):
            raise self.stop(repr(text))
        self.at += 1

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.stop("a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    # statements

    def file(self) -> None:
        while self.now.kind != "end":
            self.guarded()

    def guarded(self) -> None:
        """A statement; after a fault, on to the next line of the same or an outer block."""
        start, self.far, self.far_message = self.at, self.at, ""
        try:
            self.statement()
            return
        except Stop:
            self.fault(self.tokens[self.far].pos, self.far_message)
            self.at = max(start, self.far)
        except RecursionError:
            self.fault(self.now.pos, "nested too deeply")
        depth = 0
        while self.now.kind != "end":
            t = self.now
            if t.kind == "indent":
                depth += 1
            elif t.kind == "dedent":
                if depth == 0:
                    self.at += self.at == start
                    return
                depth -= 1
            self.at += 1
            if t.kind == "newline" and depth == 0 and self.now.kind != "indent":
                return

    def statement(self) -> None:
        t = self.now
        if t.kind in ("indent", "dedent"):
            raise self.stop("a statement" if t.kind == "dedent" else "no deeper indentation")
        if t.kind == "newline":
            self.at += 1
            return
        if t.kind == "mark" and t.text == "@":
            while self.take("@"):
                self.named_expression()
                self.line_end()
            self.take("async")
            if not self.is_("def", "class"):
                raise self.stop("def or class")
            (self.def_ if self.is_("def") else self.class_)()
            return
        if t.kind == "key":
            if t.text == "async":
                self.at += 1
                if not self.is_("def", "for", "with"):
                    raise self.stop("def, for or with")
                t = self.now
            rule = {"if": self.if_, "while": self.while_, "for": self.for_, "try": self.try_, "with": self.with_, "def": self.def_, "class": self.class_}.get(t.text)
            if rule:
                rule()
                return
        if self.word("match") and self.attempt(self.match_):
            return
        self.simple_line()

    def line_end(self) -> None:
        if self.now.kind != "newline":
            raise self.stop("the end of the line")
        self.at += 1

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.now.kind == "newline":
                break
        self.line_end()

    def block(self) -> None:
        self.need(":")
        if self.now.kind != "newline":
            self.simple_line()
            return
        self.at += 1
        if self.now.kind != "indent":
            raise self.stop("an indented block")
        self.at += 1
        while self.now.kind not in ("dedent", "end"):
            self.statement()
        if self.now.kind == "dedent":
            self.at += 1

    def simple(self) -> None:
        t = self.now
        rule = None
        if t.kind == "key":
            rule = {
                "pass": self.bare, "break": self.bare, "continue": self.bare, "return": self.return_, "raise": self.raise_, "del": self.del_, "assert": self.assert_, "import": self.import_,
                "from": self.from_, "global": self.names_, "nonlocal": self.names_,
            }.get(t.text)
        if rule:
            rule()
        elif self.word("type") and self.peek().kind == "name" and self.attempt(self.type_):
            pass
        else:
            self.expression_statement()

    def bare(self) -> None:
        self.at += 1

    def ended(self) -> bool:
        return self.now.kind in ("newline", "end") or self.is_(";")

    def return_(self) -> None:
        self.at += 1
        if not self.ended():
            self.star_expressions()

    def raise_(self) -> None:
        self.at += 1
        if not self.ended():
            self.expression()
            if self.take("from"):
                self.expression()

    def assert_(self) -> None:
        self.at += 1
        self.expression()
        if self.take(","):
            self.expression()

    def names_(self) -> None:
        self.at += 1
        self.name()
        while self.take(","):
            self.name()

    def type_(self) -> None:
        self.at += 1
        self.name()
        self.type_parameters()
        self.need("=")
        self.expression()

    def del_(self) -> None:
        self.at += 1
        s = self.star_expressions()
        if not self.ended():
            raise self.stop("the end of the line")
        self.target(s, delete=True)

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def import_(self) -> None:
        self.at += 1
        while True:
            self.dotted()
            if self.take("as"):
                self.name()
            if not self.take(","):
                return

    def from_(self) -> None:
        self.at += 1
        dots = 0
        while self.is_(".", "..."):
            self.at += 1
            dots += 1
        if not dots or not self.is_("import"):
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        bracket = self.take("(")
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(",") or bracket and self.is_(")"):
                break
        if bracket:
            self.need(")")
        elif self.tokens[self.at - 1].text == ",":
            raise self.stop("a name")

    def expression_statement(self) -> None:
        first = self.yield_() if self.is_("yield") else self.star_expressions()
        if self.is_(":"):
            if first[0] not in (NAME, ATTR, ITEM):
                raise self.stop("no annotation")
            self.at += 1
            self.expression()
            if self.take("="):
                self.yield_() if self.is_("yield") else self.star_expressions()
            return
        if self.now.kind == "mark" and self.now.text in _AUGMENTED:
            if first[0] not in (NAME, ATTR, ITEM):
                raise self.stop("no assignment")
            self.at += 1
            self.yield_() if self.is_("yield") else self.star_expressions()
            return
        while self.is_("="):
            self.target(first)
            self.at += 1
            first = self.yield_() if self.is_("yield") else self.star_expressions()

    def target(self, s: Shape, delete: bool = False, inner: bool = False) -> None:
        kind, children, _ = s
        if kind in (NAME, ATTR, ITEM):
            return
        if kind in (TUPLE, LIST):
            for c in children:
                self.target(c, delete, True)
            return
        if kind == STAR and not delete:
            self.target(children[0], delete, True)
            return
        raise self.stop("something that can be assigned to")

    # compound statements

    def if_(self) -> None:
        self.at += 1
        self.named_expression()
        self.block()
        if self.is_("elif"):
            self.if_()
        elif self.take("else"):
            self.block()

    def while_(self) -> None:
        self.at += 1
        self.named_expression()
        self.block()
        if self.take("else"):
            self.block()

    def targets(self) -> None:
        """Targets of for, up to `in`."""
        items, comma = [self.star_target()], False
        while self.take(","):
            comma = True
            if self.is_("in"):
                break
            items.append(self.star_target())
        for s in items:
            if s[0] == STAR and not comma:
                raise self.stop("a target")
            self.target(s)

    def star_target(self) -> Shape:
        if self.take("*"):
            return (STAR, (self.binary(0),), False)
        return self.binary(0)

    def for_(self) -> None:
        self.at += 1
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        if self.take("else"):
            self.block()

    def try_(self) -> None:
        self.at += 1
        self.block()
        handlers, star = 0, None
        while self.is_("except"):
            self.at += 1
            is_star = self.take("*")
            if star is not None and star != is_star:
                raise self.stop("the same kind of except")
            star = is_star
            if self.is_(":"):
                if is_star:
                    raise self.stop("an exception")
                self.block()
                handlers += 1
                if self.is_("except"):
                    raise self.stop("nothing after a bare except")
                break
            self.expression()
            if self.take("as"):
                self.name()
            self.block()
            handlers += 1
        if handlers and self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()
        elif not handlers:
            raise self.stop("except or finally")

    def with_(self) -> None:
        self.at += 1
        if self.is_("(") and self.attempt(self.with_bracket):
            return
        self.with_item()
        while self.take(","):
            self.with_item()
        self.block()

    def with_bracket(self) -> None:
        self.need("(")
        while True:
            self.with_item()
            if not self.take(",") or self.is_(")"):
                break
        self.need(")")
        if not self.is_(":"):
            raise Stop
        self.block()

    def with_item(self) -> None:
        self.expression()
        if self.take("as"):
            s = self.star_target()
            if s[0] == STAR:
                raise self.stop("a target")
            self.target(s)

    def type_parameters(self) -> None:
        if not self.take("["):
            return
        default = False
        while True:
            star = self.take("*") or self.take("**")
            self.name()
            if not star and self.take(":"):
                self.expression()
            if self.take("="):
                default = True
                if self.take("*"):
                    pass
                self.expression()
            elif default:
                raise self.stop("a default")
            if not self.take(",") or self.is_("]"):
                break
        self.need("]")

    def def_(self) -> None:
        self.at += 1
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expression()
        self.block()

    def parameters(self, end: str, typed: bool) -> None:
        default = star = slash = False
        bare_star = False
        count = 0
        while not self.is_(end):
            if bare_star and not (self.now.kind == "name"):
                raise self.stop("a parameter")
            if self.take("**"):
                self.name()
                if typed and self.take(":"):
                    self.expression()
                self.take(",")
                if not self.is_(end):
                    raise self.stop(repr(end))
                return
            if self.take("*"):
                if star:
                    raise self.stop("one '*' alone")
                star = True
                if self.is_(","):
                    bare_star = True
                else:
                    self.name()
                    if typed and self.take(":"):
                        self.star_expression()
                default = False
            elif self.take("/"):
                if slash or star or not count:
                    raise self.stop("a parameter")
                slash = True
            else:
                self.name()
                bare_star = False
                count += 1
                if typed and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise self.stop("a default")
            if not self.take(","):
                break
        if bare_star:
            raise self.stop("a parameter after '*'")

    def class_(self) -> None:
        self.at += 1
        self.name()
        self.type_parameters()
        if self.take("("):
            self.arguments()
        self.block()

    def match_(self) -> None:
        self.at += 1
        s = self.star_expressions_named()
        del s
        self.need(":")
        self.line_end()
        if self.now.kind != "indent":
            raise self.stop("an indented block")
        self.at += 1
        if not self.word("case"):
            raise self.stop("case")
        while self.word("case"):
            self.at += 1
            self.patterns()
            if self.take("if"):
                self.named_expression()
            self.block()
        if self.now.kind == "dedent":
            self.at += 1
        elif self.now.kind != "end":
            raise self.stop("case")

    def star_expressions_named(self) -> Shape:
        s = self.star_expression(named=True)
        if self.is_(","):
            while self.take(","):
                if self.is_(":"):
                    break
                self.star_expression(named=True)
        return s

    def patterns(self) -> None:
        self.star_pattern()
        while self.take(","):
            if self.is_(":", "if"):
                break
            self.star_pattern()

    def star_pattern(self) -> None:
        if self.take("*"):
            self.name()
        else:
            self.as_pattern()

    def as_pattern(self) -> None:
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take("as"):
            self.name()

    def closed_pattern(self) -> None:
        t = self.now
        if t.kind in ("string", "bytes"):
            while self.now.kind in ("string", "bytes"):
                self.at += 1
        elif t.kind == "number" or self.is_("-"):
            self.take("-")
            if self.now.kind != "number":
                raise self.stop("a number")
            self.at += 1
            if self.is_("+", "-"):
                self.at += 1
                if self.now.kind != "number":
                    raise self.stop("a number")
                self.at += 1
        elif self.is_("None", "True", "False"):
            self.at += 1
        elif t.kind == "name":
            self.dotted()
            if self.take("("):
                while not self.is_(")"):
                    if self.now.kind == "name" and self.peek().text == "=":
                        self.at += 2
                    self.as_pattern()
                    if not self.take(","):
                        break
                self.need(")")
        elif self.is_("(", "["):
            close = _CLOSE[t.text]
            self.at += 1
            while not self.is_(close):
                self.star_pattern()
                if not self.take(","):
                    break
            self.need(close)
        elif self.take("{"):
            while not self.is_("}"):
                if self.take("**"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.as_pattern()
                if not self.take(","):
                    break
            self.need("}")
        else:
            raise self.stop("a pattern")

    # expressions

    def star_expressions(self) -> Shape:
        """expression {, expression}; a tuple if there is a comma."""
        first = self.star_expression()
        if not self.is_(","):
            return first
        items = [first]
        while self.take(","):
            if not self.starts():
                break
            items.append(self.star_expression())
        return (TUPLE, tuple(items), False)

    def starts(self) -> bool:
        t = self.now
        return t.kind in ("name", "number", "string", "bytes") or self.is_("(", "[", "{", "-", "+", "~", "*", "not", "lambda", "await", "None", "True", "False", "...", "yield")

    def star_expression(self, named: bool = False) -> Shape:
        if self.take("*"):
            return (STAR, (self.binary(0),), False)
        return self.named_expression() if named else self.expression()

    def named_expression(self) -> Shape:
        if self.now.kind == "name" and self.peek().text == ":=":
            self.at += 2
            self.expression()
            return (WALRUS, (), False)
        return self.expression()

    def yield_(self) -> Shape:
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif not self.ended() and not self.is_(")", "]", "}", "="):
            self.star_expressions()
        return (YIELD, (), False)

    def expression(self) -> Shape:
        if self.is_("lambda"):
            self.at += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return _OTHER
        s = self.disjunction()
        if self.is_("if"):
            self.at += 1
            self.disjunction()
            self.need("else")
            self.expression()
            return _OTHER
        return s

    def disjunction(self) -> Shape:
        s = self.conjunction()
        while self.take("or"):
            self.conjunction()
            s = _OTHER
        return s

    def conjunction(self) -> Shape:
        s = self.inversion()
        while self.take("and"):
            self.inversion()
            s = _OTHER
        return s

    def inversion(self) -> Shape:
        if self.take("not"):
            self.inversion()
            return _OTHER
        s = self.binary(0)
        while True:
            if self.now.kind == "mark" and self.now.text in _COMPARE or self.is_("in"):
                self.at += 1
            elif self.is_("not") and self.peek().text == "in":
                self.at += 2
            elif self.take("is"):
                self.take("not")
            else:
                return s
            self.binary(0)
            s = _OTHER

    def binary(self, least: int) -> Shape:
        """Precedence climbing over the arithmetic operators."""
        if self.is_("+", "-", "~"):
            self.at += 1
            self.binary(70)
            s = _OTHER
        else:
            s = self.power()
        while self.now.kind == "mark":
            power = _BINARY.get(self.now.text)
            if power is None or power < least:
                break
            self.at += 1
            self.binary(power + 1)
            s = _OTHER
        return s

    def power(self) -> Shape:
        awaited = self.take("await")
        s = self.primary()
        if self.take("**"):
            self.binary(70)
            return _OTHER
        return _OTHER if awaited else s

    def primary(self) -> Shape:
        s = self.atom()
        while True:
            if self.take("."):
                self.name()
                s = (ATTR, (), False)
            elif self.take("("):
                self.arguments()
                s = _OTHER
            elif self.take("["):
                self.slices()
                self.need("]")
                s = (ITEM, (), False)
            else:
                return s

    def slices(self) -> None:
        self.slice_()
        while self.take(","):
            if self.is_("]"):
                return
            self.slice_()

    def slice_(self) -> None:
        if self.take("*"):
            self.binary(0)
            return
        if not self.is_(":"):
            self.named_expression()
        if self.take(":"):
            if not self.is_(":", "]", ","):
                self.expression()
            if self.take(":") and not self.is_("]", ","):
                self.expression()

    def arguments(self) -> None:
        """Up to and with the closing bracket."""
        keyword = double = False
        count = 0
        while not self.is_(")"):
            if self.take("**"):
                self.expression()
                double = True
            elif self.take("*"):
                if double:
                    raise self.stop("no '*' after '**'")
                self.expression()
            elif self.now.kind == "name" and self.peek().text == "=" and self.peek().kind == "mark":
                self.at += 2
                self.expression()
                keyword = True
            else:
                s = self.named_expression()
                if self.is_("for", "async"):
                    self.comprehension()
                    if count or not self.is_(")"):
                        raise self.stop("brackets around the generator")
                elif self.is_("="):
                    raise self.stop("the name of a parameter")
                elif keyword or double:
                    raise self.stop("no positional argument here")
                del s
            count += 1
            if not self.take(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while True:
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.disjunction()
            while self.take("if"):
                self.disjunction_or_lambda()
            if not self.is_("for", "async"):
                return

    def disjunction_or_lambda(self) -> None:
        if self.now.kind == "name" and self.peek().text == ":=":
            raise self.stop("brackets around ':='")
        self.disjunction()

    def atom(self) -> Shape:
        t = self.now
        if t.kind == "name":
            self.at += 1
            return (NAME, (), False)
        if t.kind == "number":
            self.at += 1
            return (CONST, (), False)
        if t.kind in ("string", "bytes"):
            while self.now.kind in ("string", "bytes"):
                if self.now.kind != t.kind:
                    raise self.stop("the same kind of string")
                self.at += 1
            return (CONST, (), False)
        if self.is_("None", "True", "False", "..."):
            self.at += 1
            return (CONST, (), False)
        if self.take("("):
            return self.group()
        if self.take("["):
            return self.display("]")
        if self.take("{"):
            return self.braces()
        raise self.stop("an expression")

    def group(self) -> Shape:
        if self.take(")"):
            return (TUPLE, (), True)
        if self.is_("yield"):
            self.yield_()
            self.need(")")
            return _OTHER
        first = self.star_expression(named=True)
        if self.is_("for", "async"):
            if first[0] == STAR:
                raise self.stop("no '*' in a generator")
            self.comprehension()
            self.need(")")
            return _OTHER
        if self.is_(","):
            items = [first]
            while self.take(","):
                if self.is_(")"):
                    break
                items.append(self.star_expression(named=True))
            self.need(")")
            return (TUPLE, tuple(items), True)
        self.need(")")
        if first[0] == STAR:
            raise self.stop("no single '*' in brackets")
        return (first[0], first[1], True)

    def display(self, close: str) -> Shape:
        items = []
        while not self.is_(close):
            items.append(self.star_expression(named=True))
            if len(items) == 1 and self.is_("for", "async"):
                if items[0][0] == STAR:
                    raise self.stop("no '*' in a comprehension")
                self.comprehension()
                self.need(close)
                return _OTHER
            if not self.take(","):
                break
        self.need(close)
        return (LIST, tuple(items), True)

    def braces(self) -> Shape:
        if self.take("}"):
            return _OTHER
        first, is_map = True, None
        while not self.is_("}"):
            if self.take("**"):
                if is_map is False:
                    raise self.stop("an element")
                is_map = True
                self.binary(0)
                if self.is_("for", "async"):
                    raise self.stop("no '**' in a comprehension")
            else:
                s = self.star_expression(named=True)
                if self.is_(":") and s[0] not in (STAR, WALRUS) and is_map is not False:
                    self.at += 1
                    self.expression()
                    is_map = True
                elif is_map:
                    raise self.stop("':'")
                else:
                    is_map = False
                if first and self.is_("for", "async"):
                    if s[0] == STAR:
                        raise self.stop("no '*' in a comprehension")
                    self.comprehension()
                    self.need("}")
                    return _OTHER
            first = False
            if not self.take(","):
                break
        self.need("}")
        return _OTHER


def _expression_faults(text: str) -> list[Fault]:
    """Faults of the expression in a field of an f-string."""
    lexer = _Lexer(f"({text}\n)")
    tokens = lexer.run()
    if lexer.faults:
        return [Fault(p - 1, 0, m) for p, m in lexer.faults]
    p = _Python(text, tokens)
    try:
        p.need("(")
        if p.is_("yield"):
            p.yield_()
        else:
            s = p.star_expression(named=True)
            while p.take(","):
                if p.is_(")"):
                    break
                p.star_expression(named=True)
            del s
        p.need(")")
        if p.now.kind != "newline":
            raise p.stop("the end of the field")
    except Stop:
        return [Fault(max(0, p.tokens[p.far].pos - 1), 0, p.far_message)]
    return []


def parse_python(text: str) -> list[Fault]:
    """Faults of a module, in order of place; those of the lexer and of the parser together."""
    if "\0" in text:
        return [Fault(text.index("\0"), text.count("\n", 0, text.index("\0")) + 1, "a null character")]
    lexer = _Lexer(text)
    tokens = lexer.run()
    p = _Python(text, tokens)
    p.file()
    for pos, message in lexer.faults:
        p.fault(pos, message)
    return sorted(set(p.faults), key=lambda f: (f.pos, f.message))
