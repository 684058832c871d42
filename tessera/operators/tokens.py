"""Tokens of brace languages, texts without their comments and strings, and patterns over tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

STRINGS = {
    "go": r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.)+\'',
    "ts": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`',
    "py": r'[rbfuRBFU]{0,2}(?:""".*?"""|\'\'\'.*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')',
    "rs": r'b?r(?P<hash>#*)".*?"(?P=hash)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n]{1,10}?)\'',
}
COMMENTS = {"py": r"\#[^\n]*"}
SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
NAME = r"[^\W\d]\w*"
OPERATORS = r"<<=|>>=|&\^=|\.\.\.|===|!==|\*\*=|=>|->|::|<-|\+\+|--|&&|\|\||[-+*/%&|^<>=!:]=|<<|>>|&\^|[^\s\w]"


class Token(NamedTuple):
    kind: str  # name, number, string, comment, op
    text: str
    start: int
    end: int
    line: int


def lexer(language: str) -> re.Pattern:
    life = r"|(?P<life>'[A-Za-z_]\w*)" if language == "rs" else ""
    return re.compile(rf"(?s)(?P<comment>{COMMENTS.get(language, SLASHES)})|(?P<string>{STRINGS[language]}){life}|(?P<name>[$@]?{NAME})|(?P<number>\d[\w.]*)|(?P<op>{OPERATORS})|\n")


LEXERS = {k: lexer(k) for k in STRINGS}
GROUPS = {"life": "name", "hash": "string"}
SPANNING = {"comment", "string", "hash"}
WHOLE = {"name", "number", "op"}  # on one line, and called what they are


def tokens(text: str, language: str, comments: bool = False) -> list[Token]:
    """Tokens in order; offsets are code points."""
    out, line = [], 1
    new, add = tuple.__new__, out.append  # a call of Token takes twice as long
    for m in LEXERS[language].finditer(text):
        kind = m.lastgroup
        if kind is None:  # the end of a line; others are inside strings and comments only
            line += 1
        elif kind in WHOLE:
            add(new(Token, (kind, m[0], m.start(), m.end(), line)))
        else:
            word = m[0]
            if comments or kind != "comment":
                add(new(Token, (GROUPS.get(kind, kind), word, m.start(), m.end(), line)))
            if kind in SPANNING:
                line += word.count("\n")
    return out


def masked(text: str, language: str) -> str:
    """``text`` with the inside of strings and whole comments blank, line for line and place for place."""
    out, at = [], 0
    for m in LEXERS[language].finditer(text):
        if m.lastgroup in ("comment", "string", "hash"):
            inner = re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0])
            if m.lastgroup != "comment":
                inner = '"' + inner[1:-1] + '"'
            out += [text[at : m.start()], inner]
            at = m.end()
    return "".join(out) + text[at:]


CLOSES = {"(": ")", "[": "]", "{": "}"}


def partners(found: list[Token]) -> dict[int, int]:
    """Index of the closing token of each opening one."""
    out, open_ = {}, []
    for i, t in enumerate(found):
        if t.text in CLOSES and t.kind == "op":
            open_.append(i)
        elif t.kind == "op" and t.text in ")]}" and open_:
            out[open_.pop()] = i
    return out


@dataclass(frozen=True)
class Match:
    first: int
    end: int
    captures: dict[str, str]


class Pattern:
    """A pattern of tokens: ``$X`` is one expression and captures it, ``$$$`` any number of tokens; both are balanced."""

    def __init__(self, pattern: str, language: str):
        self.language = language
        parts = re.split(r"(\$\$\$|\$[A-Z_]\w*)", pattern)
        self.items: list[tuple[str, str]] = []
        for i, p in enumerate(parts):
            if i % 2:
                self.items.append(("rest", "") if p == "$$$" else ("meta", p[1:]))
            else:
                self.items += [("token", t.text) for t in tokens(p, language)]

    def may_be_in(self, text: str) -> bool:
        """Whether all its words are in a text, as they are where it matches."""
        return all(value in text for kind, value in self.items if kind == "token")

    def matches(self, text: str, found: list[Token] | None = None, closes: dict[int, int] | None = None) -> Iterator[Match]:
        """Leftmost matches from every token, in order."""
        found = tokens(text, self.language) if found is None else found
        first = next((value for kind, value in self.items[:1] if kind == "token"), None)
        starts = range(len(found)) if first is None else [i for i, t in enumerate(found) if t.text == first]
        closes = closes if closes is not None else partners(found) if starts else {}
        for i in starts:
            captures: dict[str, str] = {}
            end = self.match(text, found, closes, i, 0, captures)
            if end is not None and end > i:
                yield Match(i, end, captures)

    def match(self, text: str, found: list[Token], closes: dict[int, int], at: int, item: int, captures: dict[str, str]) -> int | None:
        while item < len(self.items):
            kind, value = self.items[item]
            if kind == "token":
                if at >= len(found) or found[at].text != value:
                    return None
                at, item = at + 1, item + 1
                continue
            if kind == "meta" and item == 0 and at and found[at - 1].text in JOINS:
                return None  # inside an expression
            end = at if kind == "rest" else self.operand(found, closes, at, at, item)
            while end is not None:
                now = dict(captures)
                same = kind == "rest" or now.setdefault(value, text[found[at].start : found[end - 1].end]) == text[found[at].start : found[end - 1].end]
                if same and (done := self.match(text, found, closes, end, item + 1, now)) is not None:
                    captures.update(now)
                    return done
                end = self.step(found, closes, end) if kind == "rest" else self.operand(found, closes, end, at, item)
            return None
        return at

    @staticmethod
    def step(found: list[Token], closes: dict[int, int], at: int) -> int | None:
        """Past the next token, or the bracket that it opens; None before a closing one and at the end."""
        if at >= len(found) or found[at].kind == "op" and found[at].text in ")]}":
            return None
        return closes[at] + 1 if at in closes else at + 1

    def operand(self, found: list[Token], closes: dict[int, int], at: int, first: int, item: int) -> int | None:
        """The same within one expression: no statement ends, no keyword and, at the head of a pattern, no block in it."""
        if at < len(found):
            t = found[at]
            if t.kind == "op" and t.text in NOT_IN_EXPRESSIONS or t.kind == "name" and t.text in WORDS or t.text == "{" and item == 0 or at > first and item == 0 and t.line != found[at - 1].line and t.text != ".":
                return None
        return self.step(found, closes, at)


#: A token after which an expression goes on.
JOINS = {".", "::", "->", "?.", "*", "&"}
NOT_IN_EXPRESSIONS = {";", ",", "=", ":=", "+=", "-="}
WORDS = {"go", "defer", "return", "await", "if", "for", "else", "case", "switch", "var", "let", "const", "range", "while", "match", "throw", "type", "import"}


def rewritten(text: str, language: str, pattern: str, rewrite: str) -> tuple[str, list[tuple[int, str, str]]]:
    """``text`` with the leftmost matches that do not overlap replaced, and (line, before, after) of each; ``$X`` in ``rewrite`` is what it captured."""
    found = tokens(text, language)
    out, done, at = [], [], 0
    for m in Pattern(pattern, language).matches(text, found):
        start, end = found[m.first].start, found[m.end - 1].end
        if start < at:
            continue
        new = re.sub(r"\$([A-Z_]\w*)", lambda x: m.captures.get(x[1], x[0]), rewrite)  # noqa: B023
        out += [text[at:start], new]
        done.append((found[m.first].line, text[start:end], new))
        at = end
    return "".join(out) + text[at:], done
