"""Go source to declarations, calls and data flows: a recursive-descent reader of one file.

Types of names are known from receivers, parameters, results of functions of the file,
literals and conversions; there is no type checker, so a call through anything else
keeps its written name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.operators.tokens import Token, tokens

ENDERS = {")", "]", "}", "++", "--"}
KEYWORDS = {"break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"}
STOPS = {"break", "continue", "fallthrough", "return"}
TYPES = {"*", "...", "(", "[", "map", "<-", "chan", "func", "struct", "interface", "~"}
COMPOUND = {"[", "map", "chan", "struct", "interface"}
STATEMENTS = {"{", "if", "for", "switch", "select", "return", "go", "defer", "var", "const", "type", "break", "continue", "goto", "fallthrough"}
UNARY = {"-", "+", "!", "^", "&", "<-"}
BINARY = {"||", "&&", "==", "!=", "<", "<=", ">", ">=", "+", "-", "|", "^", "*", "/", "%", "<<", ">>", "&", "&^"}
ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}


@dataclass(slots=True)
class Node:
    kind: str
    start: Token
    end: Token | None = None
    text: str = ""
    kids: list[Node] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def walk(self, into_functions: bool = True) -> Iterator[Node]:
        """This node and all below, in order; without those inside function literals if asked."""
        ahead = [self]
        while ahead:
            n = ahead.pop()
            yield n
            if n.kids:
                ahead += n.kids[::-1] if into_functions else [k for k in n.kids[::-1] if k.kind != "funclit"]


class Broken(Exception):
    pass


def with_semicolons(text: str) -> list[Token]:
    """Tokens with a ``;`` where a line ends after an operand, as the language has it."""
    out: list[Token] = []
    last = None
    for t in tokens(text, "go"):
        if last is not None and t.line > last.line and t.line > last.line + last.text.count("\n") and ends(last):
            out.append(Token("op", ";", last.end, last.end, last.line))
        out.append(t)
        last = t
    line = out[-1].line if out else 1
    at = out[-1].end if out else 0
    return [*out, Token("op", ";", at, at, line), Token("end", "", at, at, line)]


def ends(t: Token) -> bool:
    return t.kind in ("number", "string") or t.kind == "name" and (t.text not in KEYWORDS or t.text in STOPS) or t.text in ENDERS


class Reader:
    def __init__(self, text: str):
        self.text, self.found = text, with_semicolons(text)
        self.signs = [None if t.kind == "string" else t.text for t in self.found]  # strings are no signs of the language
        self.i = 0
        self.header = False  # inside the head of if, for or switch: { opens a block

    @property
    def now(self) -> Token:
        return self.found[self.i]

    def at(self, *texts: str) -> bool:
        return self.signs[self.i] in texts

    def next(self) -> Token:
        t = self.found[self.i]
        if t.kind == "end":
            raise Broken
        self.i += 1
        return t

    def take(self, text: str) -> Token:
        if self.signs[self.i] != text:
            raise Broken(f"line {self.now.line}: {self.now.text!r} where {text!r} should be")
        return self.next()

    def skip(self, text: str) -> bool:
        if self.signs[self.i] != text:
            return False
        self.i += 1
        return True

    def node(self, kind: str, start: Token, kids: list[Node] | None = None, text: str = "", **extra) -> Node:
        return Node(kind, start, self.found[max(0, self.i - 1)], text, kids or [], extra)

    def name(self) -> Token:
        t = self.found[self.i]
        if t.kind != "name" or t.text in KEYWORDS:
            raise Broken
        self.i += 1
        return t

    def balanced(self) -> None:
        """Past the bracket that opens here."""
        depth = 0
        while True:
            t = self.next()
            depth += (t.text in "([{" and t.kind == "op") - (t.text in ")]}" and t.kind == "op")
            if depth == 0:
                return

    # ---- file

    def file(self) -> tuple[str, list[tuple[str, str]], list[Node]]:
        """Package, imports (name, path) and top declarations; one that cannot be read is passed over."""
        package, imports, out = "", [], []
        while self.now.kind != "end":
            first = self.i
            try:
                if self.skip("package"):
                    package = self.name().text
                elif self.skip("import"):
                    for alias, path in self.group(self.imported):
                        imports.append((alias, path))
                elif self.at("func"):
                    out.append(self.function())
                elif self.at("type"):
                    self.next()
                    out += self.group(self.typed)
                elif self.at("var", "const"):
                    self.next()
                    out += self.group(self.values)
                self.take(";")
            except Broken:
                self.i, self.header = max(self.i, first + 1), False
                while self.now.kind != "end" and not (self.at("func", "type", "var", "const") and self.text[self.now.start - 1] == "\n"):
                    self.i += 1
        return package, imports, out

    def group(self, one) -> list:
        if not self.skip("("):
            return [one()]
        out = []
        while not self.at(")"):
            out.append(one())
            if not self.at(")"):
                self.take(";")
        self.take(")")
        return out

    def imported(self) -> tuple[str, str]:
        alias = "" if self.now.kind == "string" else self.next().text
        return alias, self.next().text.strip('"`')

    def function(self) -> Node:
        start = self.take("func")
        receiver = self.parameters() if self.at("(") else None
        name = self.name()
        if self.at("["):
            self.balanced()
        kind = self.signature(start)
        body = self.block() if self.at("{") else None
        return self.node("func", start, [kind] if body is None else [kind, body], name.text, name=name, receiver=receiver, type=kind)

    def typed(self) -> Node:
        name = self.name()
        if self.at("[") and self.found[self.i + 1].kind == "name" and self.found[self.i + 2].text != "]":
            self.balanced()
        self.skip("=")
        return self.node("type", name, [self.type()], name.text, name=name)

    def values(self) -> Node:
        start, names = self.now, [self.name().text]
        while self.skip(","):
            names.append(self.name().text)
        kind = None if self.at("=", ";", ")") else self.type()
        values = self.expressions() if self.skip("=") else []
        return self.node("values", start, values, names=names, type=kind)

    # ---- types

    def parameters(self) -> list[tuple[str, Node]]:
        """(name or "", type) of a list in brackets."""
        self.take("(")
        items: list[tuple[Node, Node | None]] = []
        while not self.at(")"):
            first = self.type()
            items.append((first, None if self.at(",", ")", ";") else self.type()))
            self.skip(";")
            if not self.skip(","):
                break
        self.skip(";")
        self.take(")")
        if not any(t for _, t in items):
            return [("", t) for t, _ in items]
        out: list[tuple[str, Node]] = []
        kind: Node | None = None
        for first, t in reversed(items):
            kind = t or kind
            out.append((first.text, kind or first))
        return out[::-1]

    def signature(self, start: Token) -> Node:
        params = self.parameters()
        results: list[tuple[str, Node]] | None = None
        if self.at("("):
            results = self.parameters()
        elif not self.at("{", ";", ")", ",", "]", "}", "=", ":=", ":", "") and self.now.kind != "string":
            results = [("", self.type())]
        return self.node("functype", start, [t for _, t in params + (results or [])], params=params, results=results)

    def type(self) -> Node:
        t = self.now
        if self.signs[self.i] not in TYPES:
            return self.named(t)
        if self.skip("*"):
            return self.node("star", t, [self.type()])
        if self.skip("..."):
            return self.node("ellipsis", t, [self.type()])
        if self.skip("("):
            inner = self.type()
            self.take(")")
            return inner
        if self.skip("["):
            if not self.at("]"):
                self.expression()
            self.take("]")
            return self.node("array", t, [self.type()])
        if self.skip("map"):
            self.take("[")
            key = self.type()
            self.take("]")
            return self.node("map", t, [key, self.type()])
        if self.skip("<-"):
            self.take("chan")
            return self.node("chan", t, [self.type()], "<-chan ")
        if self.skip("chan"):
            way = "chan<- " if self.skip("<-") else "chan "
            return self.node("chan", t, [self.type()], way)
        if self.skip("func"):
            return self.signature(t)
        if self.skip("struct"):
            return self.struct(t)
        if self.skip("interface"):
            return self.interface(t)
        self.take("~")
        return self.type()

    def named(self, t: Token) -> Node:
        out = self.node("ident", t, text=self.name().text)
        while self.skip("."):
            out = self.node("selector", t, [out], self.name().text)
        if self.at("[") and self.found[self.i - 1].end == self.now.start:
            self.balanced()
        return out

    def struct(self, start: Token) -> Node:
        self.take("{")
        fields: list[tuple[str, Node]] = []
        while not self.at("}"):
            if self.at("*") or self.found[self.i + 1].text in (";", ".", "}") or self.found[self.i + 1].kind == "string":
                fields.append(("", self.type()))  # embedded
            else:
                names = [self.name().text]
                while self.skip(","):
                    names.append(self.name().text)
                kind = self.type()
                fields += [(n, kind) for n in names]
            if self.now.kind == "string":
                self.next()
            if not self.at("}"):
                self.take(";")
        self.take("}")
        return self.node("struct", start, fields=fields)

    def interface(self, start: Token) -> Node:
        self.take("{")
        methods, embeds = [], []
        while not self.at("}"):
            if self.now.kind == "name" and self.found[self.i + 1].text == "(":
                name = self.name()
                kind = self.signature(name)
                methods.append(self.node("method", name, [kind], name.text, type=kind))
            else:
                embeds.append(self.type())
                while self.skip("|"):
                    self.type()
            if not self.at("}"):
                self.take(";")
        self.take("}")
        return self.node("interface", start, methods=methods, embeds=embeds)

    # ---- expressions

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.skip(","):
            out.append(self.expression())
        return out

    def expression(self) -> Node:
        start, left = self.now, self.unary()
        while self.signs[self.i] in BINARY:
            op = self.next().text
            left = self.node("binary", start, [left, self.unary()], op)
        return left

    def unary(self) -> Node:
        t = self.found[self.i]
        if t.kind != "op":
            return self.primary()
        if t.text in UNARY:
            self.next()
            return self.node("unary", t, [self.unary()], t.text)
        if self.skip("*"):
            return self.node("star", t, [self.unary()])
        return self.primary()

    def primary(self) -> Node:
        t = self.found[self.i]
        if t.kind == "name" and t.text not in KEYWORDS:
            self.i += 1
            out = Node("ident", t, t, t.text)
        elif t.kind in ("number", "string"):
            self.i += 1
            out = Node("literal", t, t, t.text)
        elif self.at("func"):
            self.next()
            kind = self.signature(t)
            if not self.at("{"):
                out = kind
            else:
                held, self.header = self.header, False
                body = self.block()
                self.header = held
                out = self.node("funclit", t, [kind, body], type=kind)
        elif self.at("("):
            self.next()
            held, self.header = self.header, False
            inner = self.expression_or_type()
            self.header = held
            self.take(")")
            out = self.node("paren", t, [inner])
        elif self.signs[self.i] in COMPOUND:
            out = self.type()
        else:
            out = self.node("ident", t, text=self.name().text)
        while True:
            sign = self.signs[self.i]
            if sign == ".":
                self.next()
                if self.skip("("):
                    inner = None if self.skip("type") else self.type()
                    self.take(")")
                    out = self.node("assert", t, [out], type=inner)
                else:
                    out = self.node("selector", t, [out], self.name().text)
            elif sign == "(":
                paren = self.now
                out = self.node("call", t, [out, *self.arguments()], paren=paren)
            elif sign == "[":
                self.next()
                held, self.header = self.header, False
                inside = []
                while not self.at("]"):
                    if not self.skip(":") and not self.skip(","):
                        inside.append(self.expression_or_type())
                self.header = held
                self.take("]")
                out = self.node("index", t, [out, *inside])
            elif sign == "{" and (out.kind in ("array", "map", "struct") or not self.header and out.kind in ("ident", "selector", "index")):
                out = self.node("composite", t, [out, *self.elements()], type=out)
            else:
                return out

    def expression_or_type(self) -> Node:
        return self.type() if self.signs[self.i] in COMPOUND and self.found[self.i + 1].text != "(" and not self.literal_ahead() else self.expression()

    def literal_ahead(self) -> bool:
        return any(t.text in ("{", "(") for t in self.found[self.i : self.i + 8])

    def arguments(self) -> list[Node]:
        self.take("(")
        held, self.header = self.header, False
        out = []
        while not self.at(")"):
            out.append(self.expression_or_type())
            self.skip("...")
            self.skip(";")
            if not self.skip(","):
                break
        self.skip(";")
        self.header = held
        self.take(")")
        return out

    def elements(self) -> list[Node]:
        self.take("{")
        held, self.header = self.header, False
        out = []
        while not self.at("}"):
            out += self.elements() if self.at("{") else [self.expression()]
            if self.skip(":"):
                out += self.elements() if self.at("{") else [self.expression()]
            self.skip(";")
            if not self.skip(","):
                break
        self.skip(";")
        self.header = held
        self.take("}")
        return out

    # ---- statements

    def block(self) -> Node:
        start = self.take("{")
        held, self.header = self.header, False
        out = self.statements("}")
        self.header = held
        self.take("}")
        return self.node("block", start, out)

    def statements(self, *stops: str) -> list[Node]:
        out = []
        while not self.at(*stops):
            if self.skip(";"):
                continue
            out.append(self.statement())
            if not self.at(*stops):
                self.take(";")
        return out

    def statement(self) -> Node:
        t = self.now
        if self.signs[self.i] not in STATEMENTS:
            if t.kind == "name" and self.found[self.i + 1].text == ":" and t.text not in KEYWORDS:
                self.i += 2
                return self.node("label", t, [] if self.at("}", ";") else [self.statement()])
            return self.simple()
        if self.at("{"):
            return self.block()
        if self.at("if"):
            return self.branch()
        if self.at("for"):
            self.next()
            return self.node("range" if self.head() else "for", t, [*self.held, self.block()])
        if self.at("switch", "select"):
            kind = self.next().text
            self.head()
            kids = self.held
            self.take("{")
            while not self.at("}"):
                c, kids_of = self.now, []
                is_default = self.at("default")
                self.next()
                if not self.at(":"):
                    kids_of.append(self.simple(types=True))
                self.take(":")
                kids_of += self.statements("case", "default", "}")
                kids.append(self.node("case", c, kids_of, "default" if is_default else ""))
            self.take("}")
            return self.node(kind, t, kids)
        if self.at("return"):
            self.next()
            return self.node("return", t, [] if self.at(";", "}") else self.expressions())
        if self.at("go", "defer"):
            kind = self.next().text
            return self.node(kind, t, [self.expression()])
        if self.at("var", "const"):
            self.next()
            return self.node("declare", t, self.group(self.values))
        if self.at("type"):
            self.next()
            return self.node("declare", t, self.group(self.typed))
        self.next()  # break, continue, goto, fallthrough
        if self.now.kind == "name":
            self.next()
        return self.node("jump", t)

    def branch(self) -> Node:
        t = self.take("if")
        self.head()
        kids = [*self.held, self.block()]
        if self.skip("else"):
            kids.append(self.branch() if self.at("if") else self.block())
        return self.node("if", t, kids)

    def head(self) -> bool:
        """Read up to the block of if, for, switch or select into ``held``; whether it is a range."""
        before, self.header = self.header, True
        kids, ranged = [], False
        while not self.at("{"):
            if self.skip(";"):
                continue
            if self.skip("range"):
                ranged = True
                kids.append(self.expression())
                continue
            kids.append(self.simple())
            ranged = ranged or kids[-1].extra.get("range", False)
        self.header, self.held = before, kids
        return ranged

    def simple(self, types: bool = False) -> Node:
        t = self.now
        one = self.expression_or_type if types else self.expression
        left = [one()]
        while self.skip(","):
            left.append(one())
        if self.signs[self.i] in ASSIGN:
            op = self.next().text
            ranged = self.skip("range")
            right = self.expressions()
            return self.node("assign", t, [*left, *right], op, left=left, right=right, range=ranged)
        if self.at("++", "--"):
            self.next()
        elif self.skip("<-"):
            left.append(self.expression())
        return self.node("simple", t, left)


# ---- what is asked of the tree


def shown(n: Node) -> str:
    """An expression or type as text; what has no short form is ``unknown``."""
    if n.kind in ("ident", "literal"):
        return n.text
    if n.kind == "selector":
        return f"{shown(n.kids[0])}.{n.text}"
    if n.kind == "call":
        return f"{shown(n.kids[0])}()"
    if n.kind == "paren":
        return f"({shown(n.kids[0])})"
    if n.kind == "binary":
        return f"{shown(n.kids[0])} {n.text} {shown(n.kids[1])}"
    if n.kind in ("unary", "chan"):
        return n.text + shown(n.kids[0])
    if n.kind in ("star", "array", "ellipsis"):
        return {"star": "*", "array": "[]", "ellipsis": "..."}[n.kind] + shown(n.kids[0])
    if n.kind == "map":
        return f"map[{shown(n.kids[0])}]{shown(n.kids[1])}"
    if n.kind == "functype":
        return "func" + signature(n)
    if n.kind == "interface":
        return f"interface{{{len(n.extra['methods'])} methods}}" if n.extra["methods"] or n.extra["embeds"] else "interface{}"
    if n.kind == "struct":
        return f"struct{{{len(n.extra['fields'])} fields}}" if n.extra["fields"] else "struct{}"
    return "unknown"


def signature(n: Node) -> str:
    """Types of the parameters and, behind an arrow, of the results."""
    params = "(" + ", ".join(shown(t) for _, t in n.extra["params"]) + ")"
    results = n.extra["results"]
    return params if results is None else f"{params} -> (" + ", ".join(shown(t) for _, t in results) + ")"


def bare(n: Node | None) -> str:
    """Name of a type without pointer and package; empty if it has none."""
    while n is not None and n.kind in ("star", "paren", "index"):
        n = n.kids[0]
    return n.text if n is not None and n.kind in ("ident", "selector") else ""


BRANCH = {"if", "for", "range", "select", "case"}
NESTS = {"if", "for", "range", "select", "switch", "funclit"}


def metrics(n: Node) -> dict:
    """Cyclomatic: one more for each branch, case and boolean operator. Cognitive: each branch 1 + its depth squared."""
    out = {"cyclomatic": 1, "cognitive": 0, "has_loop": False, "has_error": False, "is_async": False}

    def walk(x: Node, depth: int) -> None:
        if x.kind in BRANCH:
            out["cyclomatic"] += 1
            out["cognitive"] += 1 + depth * depth
        if x.kind == "binary":
            out["cyclomatic"] += x.text in ("&&", "||")
            out["has_error"] |= x.text == "!=" and any(k.kind == "ident" and k.text == "err" for k in x.kids)
        out["has_loop"] |= x.kind in ("for", "range")
        out["is_async"] |= x.kind == "go"
        for k in x.kids:
            walk(k, depth + (x.kind in NESTS))

    for k in n.kids:
        walk(k, 0)
    return out


def skeleton(n: Node, bodies: bool) -> str:
    """S-expression of a tree with names and literals masked, with or without function bodies."""
    if n.kind == "ident":
        return "[IDENT]"
    if n.kind == "literal":
        return "[LIT]"
    kids = [skeleton(k, bodies) for k in n.kids if bodies or not (k.kind == "block" and n.kind in ("func", "funclit"))]
    op = n.text if n.kind in ("binary", "unary", "assign") else ""
    return f"({n.kind}{op} {' '.join(kids)})" if kids else f"({n.kind}{op})"


def calls_of(n: Node) -> Iterator[Node]:
    return (x for x in n.walk(False) if x.kind == "call")


class Scope:
    """Types of the names of a function, and results of the functions of a file."""

    def __init__(self, results: dict[str, str], types: dict[str, str]):
        self.results, self.types = results, types

    def learn(self, nodes: list[Node]) -> None:
        for x in nodes:
            if x.kind == "assign" and x.text == ":=" and len(x.extra["left"]) >= 1 and x.extra["right"]:
                for i, left in enumerate(x.extra["left"]):
                    right = x.extra["right"][i] if i < len(x.extra["right"]) else None
                    if left.kind == "ident" and right is not None and (t := self.type_of(right)):
                        self.types[left.text] = t
            elif x.kind == "values":
                t = bare(x.extra["type"])
                for i, name in enumerate(x.extra["names"]):
                    value = x.kids[i] if i < len(x.kids) else None
                    if t or value is not None and (t := self.type_of(value)):
                        self.types[name] = t

    def type_of(self, n: Node) -> str:
        if n.kind in ("unary", "paren") and n.text in ("&", ""):
            return self.type_of(n.kids[0])
        if n.kind == "composite":
            return bare(n.extra["type"])
        if n.kind == "assert" and n.extra["type"] is not None:
            return bare(n.extra["type"])
        if n.kind == "call" and n.kids[0].kind == "ident":
            if n.kids[0].text == "new" and len(n.kids) > 1:
                return bare(n.kids[1])
            return self.results.get(n.kids[0].text, "")
        return self.types.get(n.text, "") if n.kind == "ident" else ""


def doc_before(text: str, at: int) -> str:
    """Comment lines right above a declaration, without their marks."""
    above = text[: text.rfind("\n", 0, at) + 1]
    m = re.search(r"(?:^[ \t]*//[^\n]*\n)+\Z|^[ \t]*/\*(?:(?!\*/).)*\*/[ \t]*\n\Z", above, re.MULTILINE | re.DOTALL)
    if not m:
        return ""
    lines = [re.sub(r"^\s*(?://|/\*+|\*(?!/))\s?|\s*\*/\s*$", "", x).strip() for x in m[0].split("\n")]
    return "\n".join(x for x in lines if x)
