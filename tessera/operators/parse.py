"""Source text to symbols, calls, data flows, imports, metrics and hashes.

Python files are parsed with the standard ``ast``, Go files by a reader of their own
(``golang``) that knows the types of names declared in a file; TypeScript, JavaScript
and Rust files by declarations and blocks on the text without comments and strings,
which finds declarations, calls by name, flows, imports and metrics but resolves no
types. One file gives many rows of each kind: ``parse`` tags them and ``rows_of`` takes
one kind.

A file that cannot be parsed gives no rows.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import golang
from tessera.operators.tokens import Pattern, Token, masked, partners, rewritten, tokens

OUT = "kind string, path string, payload string"
KINDS = {
    "symbol": "path string, name string, type string, package_path string, receiver_type string, signature string, doc string, start_byte long, end_byte long, start_line int, start_col int, end_line int, structural_hash string, logic_hash string, metrics_json string",
    "call": "path string, caller string, callee string, line int, callee_path string, link_type string",
    "flow": "path string, source string, sink string, type string, line int",
    "import": "path string, import string",
    "match": "path string, line int, text string, captures map<string,string>",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
TASKS_PER_CORE = 4
FILES_AT_ONCE = 1000
REFERENCE_CALLS = {"map", "filter", "functools.partial", "partial"}


@dataclass
class Rows:
    path: str
    out: list[tuple[str, dict]] = field(default_factory=list)
    only: str | None = None  # the one kind that is asked for
    columns: frozenset[str] | None = None  # and those of its columns that are; hashes, metrics, docs and bytes of others stay empty

    def wants(self, kind: str) -> bool:
        return self.only is None or self.only == kind

    def needs(self, column: str) -> bool:
        return self.columns is None or column in self.columns

    def add(self, kind: str, **values) -> None:
        if self.only is None or self.only == kind:
            self.out.append((kind, values))


def package_of(path: str) -> str:
    return re.sub(r"(/__init__)?\.py$", "", path).strip("/").replace("/", ".")


def cut_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shape(node: ast.AST, bodies: bool) -> str:
    """S-expression of a tree with names and literals masked, with or without function bodies."""
    if isinstance(node, ast.Name | ast.arg):
        return "[IDENT]"
    if isinstance(node, ast.Constant):
        return "[LIT]"
    kind = type(node).__name__
    head = not bodies and isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef)
    children = [shape(x, bodies) for x in below(node, "body" if head else "")]
    return f"({kind} {' '.join(children)})" if children else kind


def below(node: ast.AST, without: str = "") -> list[ast.AST]:
    """Nodes right under one in their order, without those of the field ``without`` and the contexts of names."""
    out = []
    for name in node._fields:
        value = getattr(node, name, None)
        if name == without:
            continue
        if isinstance(value, list):
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST) and name != "ctx":
            out.append(value)
    return out


BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def metrics(node: ast.AST) -> dict:
    """Cyclomatic: one more for each branch or boolean operator. Cognitive: each branch 1 + its depth squared."""
    cyclomatic, cognitive, loop, error = 1, 0, False, False

    def walk(n: ast.AST, depth: int) -> None:
        nonlocal cyclomatic, cognitive, loop, error
        for child in below(n):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(child, BRANCHES):
                cyclomatic += 1
                cognitive += 1 + depth * depth
            if isinstance(child, ast.BoolOp):
                cyclomatic += len(child.values) - 1
            loop |= isinstance(child, ast.For | ast.While | ast.AsyncFor)
            error |= isinstance(child, ast.Try | ast.Raise)
            walk(child, depth + isinstance(child, NESTING))

    walk(node, 0)
    return {"cyclomatic": cyclomatic, "cognitive": cognitive, "has_loop": loop, "has_error": error, "is_async": isinstance(node, ast.AsyncFunctionDef)}


def parse_python(path: str, text: str, only: str | None = None, columns: frozenset[str] | None = None) -> Rows:
    rows = Rows(path, only=only, columns=columns)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return rows
    package = package_of(path)
    starts = [0]
    for line in text.split("\n") if rows.wants("symbol") and (rows.needs("start_byte") or rows.needs("end_byte")) else []:
        starts.append(starts[-1] + len(line.encode()) + 1)
    byte = lambda line, at: starts[line - 1] + at if len(starts) > 1 else 0
    hashed = lambda n, column, bodies: cut_hash(shape(n, bodies)) if rows.needs(column) else ""
    measured = lambda n: json.dumps(metrics(n)) if rows.needs("metrics_json") else ""
    alias: dict[str, set[str]] = {}
    seen: set[str] = set()
    for n in statements(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                alias.setdefault(a.asname or a.name.split(".")[0], set()).add(a.name if a.asname else a.name.split(".")[0])
                names = [a.name]
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            for a in n.names:
                alias.setdefault(a.asname or a.name, set()).add(f"{n.module or ''}.{a.name}".strip("."))
            names = [base]
        else:
            continue
        for x in names if isinstance(n, ast.ImportFrom) else [a.name for a in n.names]:
            if x not in seen:
                seen.add(x)
                rows.add("import", **{"path": path, "import": x})
    if only == "import":
        return rows
    local = {n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}

    def callee(n: ast.expr) -> str:
        """Dotted name with import names put in full; a name imported as two things stays as it is."""
        names, head = [], n
        while isinstance(head, ast.Attribute):
            names.append(head.attr)
            head = head.value
        if isinstance(head, ast.Name):
            dotted = ".".join([head.id, *names[::-1]])
        else:
            try:
                dotted = ast.unparse(n)
            except ValueError:
                return ""
        if not re.fullmatch(r"[\w.]+", dotted):
            return dotted.split("(")[0] if re.match(r"[\w.]+\(", dotted) else ""
        head, _, rest = dotted.partition(".")
        if len(alias.get(head, ())) == 1:
            head = next(iter(alias[head]))
        elif head in local and not rest:
            head = f"{package}.{head}"
        return f"{head}.{rest}" if rest else head

    def visit(body: list[ast.stmt], owner: str, klass: str) -> None:
        counter = 0
        for n in body:
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(n, ast.ClassDef)
                name = f"{owner}.{n.name}" if owner else n.name
                if rows.wants("symbol"):
                    declared(n, name, klass)
                if is_class:
                    for b in n.bases if rows.wants("call") else []:
                        rows.add("call", path=path, caller=f"{package}.{name}", callee=callee(b), line=n.lineno, callee_path="", link_type="embeds")
                    visit(n.body, name, n.name)
                else:
                    if only != "symbol":
                        edges(n, f"{package}.{name}")
                    visit(n.body, name, "")
            elif rows.wants("symbol"):
                for lam in (x for x in all_below(n) if isinstance(x, ast.Lambda)):
                    counter += 1
                    name = f"{owner}.func{counter}" if owner else f"func{counter}"
                    rows.add("symbol", path=path, name=name, type="function", package_path=package, receiver_type="", signature=f"lambda {ast.unparse(lam.args)}" if rows.needs("signature") else "", doc="", start_byte=byte(lam.lineno, lam.col_offset), end_byte=byte(lam.end_lineno, lam.end_col_offset), start_line=lam.lineno, start_col=lam.col_offset, end_line=lam.end_lineno, structural_hash=hashed(lam, "structural_hash", False), logic_hash=hashed(lam, "logic_hash", True), metrics_json=measured(lam))

    def declared(n: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, name: str, klass: str) -> None:
        is_class = isinstance(n, ast.ClassDef)
        first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
        signature = "" if not rows.needs("signature") else f"class {n.name}({', '.join(map(ast.unparse, n.bases))})" if is_class else f"def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
        rows.add(
            "symbol", path=path, name=name, type="class" if is_class else "method" if klass else "function", package_path=package, receiver_type=klass, signature=signature, doc=rows.needs("doc") and ast.get_docstring(n) or "",
            start_byte=byte(n.lineno, n.col_offset), end_byte=byte(n.end_lineno, n.end_col_offset), start_line=first, start_col=n.col_offset, end_line=n.end_lineno,
            structural_hash=hashed(n, "structural_hash", False), logic_hash=hashed(n, "logic_hash", True), metrics_json=measured(n),
        )

    def edges(f: ast.AST, caller: str) -> None:
        for n in own_nodes(f):
            if isinstance(n, ast.Call):
                target = callee(n.func)
                if target:
                    rows.add("call", path=path, caller=caller, callee=target, line=n.lineno, callee_path="", link_type="call")
                    if target in REFERENCE_CALLS and n.args and (arg := callee(n.args[0])):
                        rows.add("call", path=path, caller=caller, callee=arg, line=n.lineno, callee_path="", link_type="reference")
                    for i, a in enumerate(n.args if rows.wants("flow") else []):
                        if isinstance(a, ast.Name):
                            rows.add("flow", path=path, source=a.id, sink=f"{target}:arg{i}", type="argument", line=n.lineno)
            elif not rows.wants("flow"):
                continue
            elif isinstance(n, ast.Assign | ast.AnnAssign) and n.value is not None:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for s in (x for x in ast.walk(n.value) if isinstance(x, ast.Name)):
                        if isinstance(t, ast.Name):
                            rows.add("flow", path=path, source=s.id, sink=t.id, type="assignment", line=n.lineno)
            elif isinstance(n, ast.Return) and n.value is not None:
                values = n.value.elts if isinstance(n.value, ast.Tuple) else [n.value]
                for i, v in enumerate(values):
                    if isinstance(v, ast.Name):
                        rows.add("flow", path=path, source=v.id, sink=f"{caller}:return{i}", type="return", line=n.lineno)

    visit(tree.body, "", "")
    return rows


def statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Statements of a file, those inside others too, without a look into expressions."""
    ahead: list[ast.AST] = [tree]
    for n in ahead:
        for part in ("body", "orelse", "finalbody", "handlers", "cases"):
            below = getattr(n, part, None)
            if isinstance(below, list):
                ahead += below
        yield n


def own_nodes(f: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function without those of functions inside it."""
    inside = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    ahead = [c for c in below(f) if not isinstance(c, inside)][::-1]
    while ahead:
        n = ahead.pop()
        yield n
        if n._fields and not isinstance(n, ast.Name | ast.Constant):
            ahead += [c for c in below(n) if not isinstance(c, inside)][::-1]


def all_below(node: ast.AST) -> Iterator[ast.AST]:
    """A node and all under it, level by level."""
    ahead = [node]
    for n in ahead:
        ahead += below(n)
        yield n


def parse_go(path: str, text: str, only: str | None = None, columns: frozenset[str] | None = None) -> Rows:
    """Go files by their syntax tree; see ``golang`` for what is known of types."""
    rows = Rows(path, only=only, columns=columns)
    package, imports, top = golang.Reader(text).file()
    for x in dict.fromkeys(p for _, p in imports):
        rows.add("import", **{"path": path, "import": x})
    if only == "import":
        return rows
    alias = {a or p.rsplit("/", 1)[-1]: p for a, p in imports if a not in ("_", ".")}
    results = {n.text: golang.bare(n.extra["type"].extra["results"][0][1]) for n in top if n.kind == "func" and n.extra["receiver"] is None and n.extra["type"].extra["results"]}
    place = Places(text)
    doc_at = lambda at: golang.doc_before(text, at) if rows.wants("symbol") and rows.needs("doc") else ""
    hashed = lambda n, column, bodies: cut_hash(golang.skeleton(n, bodies)) if rows.needs(column) else ""

    def symbol(n: golang.Node, name: str, kind: str, signature: str, receiver: str = "", doc: str = "", at=None) -> None:
        if not rows.wants("symbol"):
            return
        at = at or n.start
        rows.add(
            "symbol", path=path, name=name, type=kind, package_path=package, receiver_type=receiver, signature=signature, doc=doc, start_byte=place.byte(n.start.start), end_byte=place.byte(n.end.end),
            start_line=at.line, start_col=place.column(at.start), end_line=n.end.line + n.end.text.count("\n"), structural_hash=hashed(n, "structural_hash", False), logic_hash=hashed(n, "logic_hash", True) if kind != "method_spec" else "", metrics_json=json.dumps(golang.metrics(n)) if rows.needs("metrics_json") else "",
        )

    def in_full(written: str, scope: golang.Scope, fun: golang.Node) -> str:
        """A callee with its package: a method by the type of what it is called on, a function of another package by its path."""
        if not written or "unknown" in written:
            return ""
        if fun.kind == "selector" and fun.kids[0].kind == "ident":
            owner = fun.kids[0].text
            if t := scope.types.get(owner):
                return f"{package}.{t}.{fun.text}"
            if owner in alias:
                return f"{alias[owner]}.{fun.text}"
        return f"{package}.{written}"

    counters: dict[str, int] = {}

    def body(n: golang.Node, owner: str, scope: golang.Scope) -> None:
        """Calls and flows of a function, then its function literals as functions of their own."""
        nodes = list(n.walk(False))
        if only != "symbol":
            scope.learn(nodes)
        caller = f"{package}.{owner}"
        for x in nodes if only != "symbol" else []:
            line = x.start.line
            if x.kind == "call":
                callee = rows.wants("call") and in_full(golang.shown(x.kids[0]), scope, x.kids[0])
                if callee:
                    rows.add("call", path=path, caller=caller, callee=callee, line=x.extra["paren"].line, callee_path="", link_type="call")
                for i, arg in enumerate(x.kids[1:] if rows.wants("flow") else []):
                    rows.add("flow", path=path, source=golang.shown(arg), sink=f"{golang.shown(x.kids[0])}:arg{i}", type="argument", line=arg.start.line)
            elif not rows.wants("flow"):
                continue
            elif x.kind == "return":
                for i, value in enumerate(x.kids):
                    rows.add("flow", path=path, source=golang.shown(value), sink=f"{owner}:return{i}", type="return", line=value.start.line)
            elif x.kind == "assign" and not x.extra["range"]:
                assigned(x.extra["left"], x.extra["right"], line)
            elif x.kind == "values":
                assigned([golang.Node("ident", x.start, text=name) for name in x.extra["names"]], x.kids, line)
        for x in nodes:
            for lit in x.kids:
                if lit.kind != "funclit":
                    continue
                counters[owner] = counters.get(owner, 0) + 1
                name = f"{owner}.func{counters[owner]}"
                symbol(lit, name, "function", golang.signature(lit.extra["type"]))
                inner = golang.Scope(results, dict(scope.types) | {p: golang.bare(t) for p, t in lit.extra["type"].extra["params"] if p and golang.bare(t)})
                body(golang.Node("body", lit.start, lit.end, kids=lit.kids), name, inner)

    def assigned(left: list[golang.Node], right: list[golang.Node], line: int) -> None:
        only = golang.shown(right[0].kids[0]) if len(right) == 1 and right[0].kind == "call" else None
        for i, target in enumerate(left):
            source = f"{only}:return{i}" if only is not None else golang.shown(right[min(i, len(right) - 1)]) if right and (i < len(right) or len(right) == 1) else ""
            sink = golang.shown(target)
            if source and sink and sink != "_":
                rows.add("flow", path=path, source=source, sink=sink, type="assignment", line=line)

    for n in top:
        if n.kind == "func":
            kind, receiver, types = "function", "", {}
            name = n.text
            if n.extra["receiver"]:
                held, t = n.extra["receiver"][0]
                kind, receiver = "method", "pointer" if t.kind == "star" else "value"
                name = f"{golang.bare(t)}.{n.text}"
                types[held] = golang.bare(t)
            types |= {p: golang.bare(t) for p, t in n.extra["type"].extra["params"] if p and golang.bare(t)}
            symbol(n, name, kind, golang.signature(n.extra["type"]), receiver, doc_at(n.start.start), n.extra["name"])
            body(golang.Node("body", n.start, n.end, kids=n.kids), name, golang.Scope(results, types))
        elif n.kind == "type" and n.kids[0].kind in ("struct", "interface"):
            inside = n.kids[0]
            doc = doc_at(text.rfind("type", 0, n.start.start))
            symbol(n, n.text, "class" if inside.kind == "struct" else "interface", inside.kind, "", doc, n.extra["name"])
            for m in inside.extra.get("methods", []):
                symbol(m, f"{n.text}.{m.text}", "method_spec", golang.signature(m.extra["type"]))
            for e in inside.extra.get("embeds", []) + [t for name, t in inside.extra.get("fields", []) if not name]:
                if embedded := golang.bare(e):
                    rows.add("call", path=path, caller=f"{package}.{n.text}", callee=f"{package}.{embedded}", line=e.start.line, callee_path="", link_type="embeds")
        else:
            body(golang.Node("body", n.start, n.end, kids=[n]), "global", golang.Scope(results, {}))
    return rows


class Places:
    """Bytes and columns of code points of a text."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode())

    def column(self, at: int) -> int:
        return at - (self.text.rfind("\n", 0, at) + 1)


DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "ts": [("interface", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s+)?function\b")],
    "rs": [("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(?P<name>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)")],
}
IMPORTS = {"ts": r"(?m)^\s*(?:import|export)\s[^'\"\n;]*['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]", "rs": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)"}
METHODS = {"ts": r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|override\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<name>#?\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;]+)?\{"}
DECLARED = {k: [(kind, re.compile(p)) for kind, p in found] for k, found in DECLARATIONS.items()}
NOT_CALLS = {"if", "for", "while", "switch", "return", "function", "catch", "match", "fn", "new", "typeof", "super", "await", "async", "in", "of", "loop", "impl", "where", "as", "else", "unsafe"}
LANGUAGES = {".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".rs": "rs"}


BRACES = re.compile(r"[{};]")


def braces_end(lines: list[str], first: int) -> int:
    """Line on which the block that opens at or after ``first`` closes; ``first`` itself for a declaration without one."""
    depth, opened = 0, False
    for i in range(first, len(lines)):
        for c in BRACES.findall(lines[i]):
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened:
                return i
            if opened and depth <= 0:
                return i
    return len(lines) - 1 if opened else first


BRANCHING = {"ts": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.:?])", "rs": r"\b(?:if|for|while|loop)\b|=>|&&|\|\|"}
OPENING = r"\b(?:if|for|while|loop|switch|match|try|catch|else)\b[^{}]*$"


def brace_metrics(body: str, language: str, head: str) -> dict:
    """Cyclomatic: one more for each branch or boolean operator. Cognitive: each branch 1 + the squared depth of blocks around it."""
    out = {"cyclomatic": 1, "cognitive": 0}
    nests: list[bool] = []
    before = 0
    for m in re.finditer(rf"[{{}}]|{BRANCHING[language]}", body):
        if m[0] == "{":
            nests.append(bool(re.search(OPENING, body[before : m.start()])))
            before = m.end()
        elif m[0] == "}":
            before = m.end()
            if nests:
                nests.pop()
        else:
            out["cyclomatic"] += 1
            if m[0] not in ("&&", "||", "??"):
                out["cognitive"] += 1 + sum(nests) ** 2
    loop = re.search(r"\b(?:for|while|loop)\b|\.(?:forEach|map|for_each)\s*\(", body)
    error = re.search(r"\b(?:try|catch|throw)\b|\.catch\s*\(", body) if language == "ts" else re.search(r"\b(?:Err|panic!|unwrap|expect)\b|\?\s*[;)]", body)
    return out | {"has_loop": bool(loop), "has_error": bool(error), "is_async": bool(re.search(r"\basync\b", head) or re.search(r"\bawait\b", body))}


def split_arguments(code: str, at: int) -> list[str]:
    """Arguments of the call whose bracket opens at ``at``, as written."""
    depth, first, out = 0, at + 1, []
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                out.append(code[first:i].strip())
                return [x for x in out if x] if len(out) == 1 else out
        elif c == "," and depth == 1:
            out.append(code[first:i].strip())
            first = i + 1
    return []


def parse_braces(path: str, text: str, language: str, only: str | None = None, columns: frozenset[str] | None = None) -> Rows:
    """TypeScript, JavaScript and Rust by declarations and blocks, on the text without its comments and strings."""
    rows = Rows(path, only=only, columns=columns)
    clear = masked(text, language)
    lines, source = clear.split("\n"), text.split("\n")
    place = Places(text)
    offset = [0]
    for line in source:
        offset.append(offset[-1] + len(line) + 1)
    package = re.sub(r"\.\w+$", "", path).replace("/", ".")
    code_only = "\n".join(s if c.strip() else "" for s, c in zip(source, lines, strict=True)) if rows.wants("import") else ""
    for x in dict.fromkeys(a or b for a, b in ((m[1], m[2] if m.re.groups > 1 else None) for m in re.finditer(IMPORTS[language], code_only))):
        rows.add("import", **{"path": path, "import": x})
    if only == "import":
        return rows
    inside: list[tuple[str, int, str]] = []  # (name, last line, kind) of classes and functions around
    for i, line in enumerate(lines):
        if not line or line.isspace():
            continue
        while inside and i > inside[-1][1]:
            inside.pop()
        owner = next((n for n, _, k in reversed(inside) if k == "class"), "")
        found = next(((kind, m) for kind, p in DECLARED[language] if (m := p.match(line))), None)
        direct = bool(inside) and inside[-1][2] == "class"
        if found is None and direct and language in METHODS and (m := re.match(METHODS[language], line)) and m["name"] not in NOT_CALLS:
            found = ("method", m)
        if language == "rs" and (m := re.match(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)", line)):
            inside.append((m["name"], braces_end(lines, i), "class"))
            if m["trait"]:
                rows.add("call", path=path, caller=f"{package}.{m['name']}", callee=m["trait"].split("::")[-1], line=i + 1, callee_path="", link_type="implements")
            continue
        if found is None:
            continue
        kind, m = found
        end = braces_end(lines, i)
        if owner and direct and kind == "function":
            kind = "method"
        body = "\n".join(lines[i : end + 1])
        doc: list[str] = []
        for j in range(i - 1, -1, -1) if rows.wants("symbol") and rows.needs("doc") else []:
            if not re.match(r"\s*(//|\*|/\*|#\[|@\w)", source[j]):
                break
            if not re.match(r"\s*(#\[|@\w)", source[j]):
                doc.insert(0, re.sub(r"^\s*(?:///?!?|/\*\*?|\*/?)\s?", "", source[j]).rstrip("*/ "))
        name = f"{owner}.{m['name']}" if owner and direct else f"{inside[-1][0]}.{m['name']}" if inside and inside[-1][2] == "function" else m["name"]
        if rows.wants("symbol"):
            masks = re.sub(r'"\s*"|\b\d[\w.]*', "[LIT]", body) if rows.needs("structural_hash") or rows.needs("logic_hash") else ""
            rows.add(
                "symbol", path=path, name=name, type=kind, package_path=package, receiver_type=owner if direct else "", signature=source[i].strip().rstrip("{").strip(), doc="\n".join(doc).strip(),
                start_byte=place.byte(offset[i]), end_byte=place.byte(offset[end + 1] - 1), start_line=i + 1, start_col=len(line) - len(line.lstrip()), end_line=end + 1,
                structural_hash=cut_hash(re.sub(r"\b[A-Za-z_]\w*\b", "[IDENT]", masks.split("{")[0])) if masks else "", logic_hash=cut_hash(re.sub(r"\b[A-Za-z_]\w*\b", "[IDENT]", re.sub(r"\s+", " ", masks))) if masks else "",
                metrics_json=json.dumps(brace_metrics(body[m.end() :], language, line)) if rows.needs("metrics_json") else "",
            )
        inside.append((name if kind in ("function", "method") else m["name"], end, "class" if kind in ("class", "interface") else "function"))
        if kind in ("class", "interface"):
            for word, names in re.findall(r"\b(extends|implements)\s+([\w.,\s]+?)(?=\bimplements\b|\bextends\b|\{|<|$)", line):
                for base in filter(None, map(str.strip, names.split(","))):
                    rows.add("call", path=path, caller=f"{package}.{m['name']}", callee=base, line=i + 1, callee_path="", link_type="embeds" if word == "extends" else "implements")
            continue
        if only == "symbol":
            continue
        own = " " * m.end() + body[m.end() :]
        for c in re.finditer(r"([A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*)(!?)\s*(?:::)?(?:<[\w\s,]*>)?\(", own):
            target = c[1].replace("?.", ".")
            if target in NOT_CALLS or re.search(r"\b(?:function|fn)\Z", own[: c.start()].rstrip()[-9:]):
                continue
            if owner and re.match(r"(?:this|self|Self)(?:\.|::)\w+$", target):
                target = f"{package}.{owner}.{re.split(r'[.:]+', target)[1]}"
            at = i + 1 + own.count("\n", 0, c.start())
            rows.add("call", path=path, caller=f"{package}.{name}", callee=target, line=at, callee_path="", link_type="call")
            for k, arg in enumerate(split_arguments(own, c.end() - 1) if rows.wants("flow") else []):
                if re.fullmatch(r"&?(?:mut\s+)?[A-Za-z_$][\w$.]*", arg):
                    rows.add("flow", path=path, source=re.sub(r"^&?(?:mut\s+)?", "", arg), sink=f"{target}:arg{k}", type="argument", line=at)
        for part in re.finditer(r"[^;\n{}]+", own) if rows.wants("flow") else []:
            code, at = part[0], i + 1 + own.count("\n", 0, part.start())
            if a := re.match(r"^\s*(?:(?:let|const|var)\s+(?:mut\s+)?)?([A-Za-z_$][\w$.]*)(?:\s*:\s*[^=]+)?\s*=(?![=>])\s*(.+?)\s*$", code):
                value = a[2]
                if re.fullmatch(r"[A-Za-z_$][\w$.]*", value):
                    rows.add("flow", path=path, source=value, sink=a[1], type="assignment", line=at)
                elif called := re.match(r"(?:await\s+|new\s+)?([A-Za-z_$][\w$.:]*)!?\(", value):
                    rows.add("flow", path=path, source=f"{called[1]}:return0", sink=a[1], type="assignment", line=at)
            if r := re.match(r"^\s*return\s+([A-Za-z_$][\w$.]*)\s*$", code):
                rows.add("flow", path=path, source=r[1], sink=f"{package}.{name}:return0", type="return", line=at)
    return rows


def parse_text(path: str, text: str, only: str | None = None, columns: frozenset[str] | None = None) -> Rows:
    if path.endswith(".py"):
        return parse_python(path, text, only, columns)
    if path.endswith(".go"):
        return parse_go(path, text, only, columns)
    language = LANGUAGES.get(path[path.rfind(".") :])
    return parse_braces(path, text, language, only, columns) if language else Rows(path)


def dealt(files: DataFrame) -> DataFrame:
    """(path, content) over all cores: many small files can stand in one part of a table, and a parser's time is that of its longest task."""
    tasks = TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", F.col("content").cast("string").alias("content")).repartition(tasks, "path")


def parse(files: DataFrame) -> DataFrame:
    """(kind, path, payload) of files (path, content: string); payload is JSON."""

    def run(batches):
        for pdf in batches:
            out = [(kind, p, json.dumps(v)) for p, t in zip(pdf["path"], pdf["content"], strict=True) for kind, v in parse_text(p, t or "").out]
            yield pd.DataFrame(out, columns=["kind", "path", "payload"])

    return dealt(files).mapInPandas(run, OUT)


def parse_only(files: DataFrame, kind: str, *names: str) -> DataFrame:
    """What ``rows_of(parse(files), kind)`` gives, or those of its columns that are named, with the work for them alone and no JSON on the way."""
    known = dict(c.split(" ") for c in KINDS[kind].split(", "))
    columns = [(c, known[c]) for c in names or known]
    asked = frozenset(names) or None
    schema = pa.schema([(c, ARROW[t]) for c, t in columns])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(at, FILES_AT_ONCE)
                found = [v for p, t in zip(part["path"].to_pylist(), part["content"].to_pylist(), strict=True) for _, v in parse_text(p, t or "", kind, asked).out]
                yield pa.RecordBatch.from_pydict({c: [v[c] for v in found] for c, _ in columns}, schema)

    return dealt(files).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in columns))


def rows_of(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col("kind") == kind).select(F.from_json("payload", KINDS[kind]).alias("v")).select("v.*")


def structural_search(files: DataFrame, pattern: str, inside: str = "", has: str = "") -> DataFrame:
    """(path, line, text, captures) of code like ``pattern``, in files of every language that it can be read in.

    ``$X`` stands for one expression and captures it, ``$$$`` for any number of
    arguments or statements. ``inside``: part of the kind of a construct around;
    ``has``: a pattern that something inside matches. Python is matched by syntax
    trees, the other languages by tokens with balanced brackets.
    """

    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("captures", pa.map_(pa.string(), pa.string()))])

    def of_file(path: str, text: str) -> list[tuple]:
        return [(path, line, found, list(captures.items())) for _, line, found, captures in matches(path, text, [(pattern, inside, has)])]

    return dealt(files).mapInArrow(of_files(of_file, schema), KINDS["match"])


def of_files(of_file: Callable[[str, str], list[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What gives the rows of ``of_file`` for each (path, content) of batches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(at, FILES_AT_ONCE)
                rows = [r for p, t in zip(part["path"].to_pylist(), part["content"].to_pylist(), strict=True) for r in of_file(p, t or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


REWRITE = "path string, content string, line int, before string, after string"


def structural_rewrite(files: DataFrame, pattern: str, rewrite: str) -> DataFrame:
    """(path, content, line, before, after): each place like ``pattern`` with what it becomes, and the file's new text.

    Patterns are matched by tokens in every language; files without a match give no row.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"], strict=True):
                language = language_of(path)
                if language and text:
                    new, places = rewritten(text, language, pattern, rewrite)
                    out += [(path, new, *p) for p in places]
            yield pd.DataFrame(out, columns=["path", "content", "line", "before", "after"])

    return dealt(files).mapInPandas(run, REWRITE)


def language_of(path: str) -> str | None:
    return {".go": "go", ".py": "py"}.get(path[path.rfind(".") :]) or LANGUAGES.get(path[path.rfind(".") :])


#: (pattern, inside, has) of a search.
Wanted = tuple[str, str, str]


def matches(path: str, text: str, wanted: list[Wanted]) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(place in ``wanted``, line, text, captures) of all that is searched for; a file is read once for all of it, or not at all if a word of each is missing."""
    return python_matches(text, wanted) if path.endswith(".py") else brace_matches(path, text, wanted)


def python_matches(text: str, wanted: list[Wanted]) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    searches = []
    for i, (pattern, inside, has) in enumerate(wanted):
        try:
            want, words = compile_pattern(pattern)
            need, more = compile_pattern(has) if has else (None, frozenset())
        except (SyntaxError, ValueError):
            continue
        if not text.isascii() or all(w in text for w in words | more):  # other texts can write a name in several ways
            searches.append((i, want, inside.lower(), need))
    if not searches:
        return
    try:
        nodes = [(n, around) for n, around in with_parents(ast.parse(text)) if not isinstance(n, ast.Expr)]  # its expression follows
    except (SyntaxError, ValueError):
        return
    for i, want, inside, need in searches:
        kind = None if is_meta(want) else type(want)
        for node, around in nodes:
            if kind is not None and type(node) is not kind:
                continue
            captures: dict[str, str] = {}
            if not same(want, node, captures) or inside and not any(inside in type(p).__name__.lower() for p in parents(around)):
                continue
            if need is not None and not any(same(need, n, {}) for n in ast.walk(node) if n is not node):
                continue
            yield i, node.lineno, ast.unparse(node), captures


AROUND = {"func": "function_declaration", "fn": "function_item", "function": "function_declaration", "class": "class_declaration", "struct": "struct_type", "interface": "interface_type", "trait": "trait_item", "impl": "impl_item", "for": "for_statement", "while": "while_statement", "loop": "loop_expression", "if": "if_statement", "else": "if_statement", "switch": "switch_statement", "select": "select_statement", "match": "match_expression", "try": "try_statement", "catch": "catch_clause", "go": "go_statement", "defer": "defer_statement", "=>": "arrow_function"}


def brace_matches(path: str, text: str, wanted: list[Wanted]) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    language = "go" if path.endswith(".go") else LANGUAGES.get(path[path.rfind(".") :])
    if language is None:
        return
    searches = []
    for i, (pattern, inside, has) in enumerate(wanted):
        want, need = compiled(pattern, language), compiled(has, language) if has else None
        if want.may_be_in(text) and (need is None or need.may_be_in(text)):
            searches.append((i, want, inside.lower(), need))
    if not searches:
        return
    found = tokens(text, language)
    closes = partners(found)
    opened = blocks(found) if any(inside for _, _, inside, _ in searches) else {}
    for i, want, inside, need in searches:
        needed = [m.first for m in need.matches(text, found, closes)] if need is not None else []
        for m in want.matches(text, found, closes):
            if inside and not any(inside in kind for o, kind in opened.items() if o < m.first and closes.get(o, len(found)) >= m.end):
                continue
            if need is not None and not any(m.first < n < m.end for n in needed):
                continue
            yield i, found[m.first].line, text[found[m.first].start : found[m.end - 1].end], m.captures


def blocks(found: list[Token]) -> dict[int, str]:
    """Blocks by the index of their opening token, each with the word that opens it."""
    out = {}
    word = ""
    for i, t in enumerate(found):
        if t.kind in ("name", "op") and t.text in AROUND:
            word = t.text
        elif t.text == "{" and t.kind == "op":
            out[i], word = AROUND.get(word, "block"), ""
        elif t.text in (";", "}") and t.kind == "op":
            word = ""
    return out


@lru_cache(1000)
def compiled(pattern: str, language: str) -> Pattern:
    return Pattern(pattern, language)


@lru_cache(1000)
def compile_pattern(pattern: str) -> tuple[ast.AST, frozenset[str]]:
    """A pattern's tree, and names that a text which it matches has in it."""
    text = re.sub(r"\$\$\$", "META_REST", re.sub(r"\$([A-Z_]\w*)", r"META_\1", pattern))
    body = ast.parse(text).body[0]
    tree = body.value if isinstance(body, ast.Expr) else body
    names = [n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(tree) if isinstance(n, ast.Name | ast.Attribute)]
    return tree, frozenset(n for n in names if not n.startswith("META_") and n.isascii())


def is_meta(p) -> bool:
    return isinstance(p, ast.Name) and p.id.startswith("META_")


def with_parents(tree: ast.AST) -> Iterator[tuple[ast.AST, tuple | None]]:
    """Nodes that have a place in the text, in its order, each with its ``parents``."""
    ahead: list[tuple[ast.AST, tuple | None]] = [(tree, None)]
    while ahead:
        here = ahead.pop()
        if hasattr(here[0], "lineno"):
            yield here
        ahead += [(c, here) for c in below(here[0])[::-1]]


def parents(around: tuple | None) -> Iterator[ast.AST]:
    while around is not None:
        yield around[0]
        around = around[1]


def same(p, n, captures: dict[str, str]) -> bool:
    if isinstance(p, ast.Expr):
        p = p.value
    if isinstance(n, ast.Expr):
        n = n.value
    if is_meta(p):
        if not isinstance(n, ast.AST):
            return False
        text = ast.unparse(n)
        return captures.setdefault(p.id.removeprefix("META_"), text) == text
    if isinstance(p, list):
        return isinstance(n, list) and same_list(p, n, captures)
    if isinstance(p, ast.AST):
        return type(p) is type(n) and all(same(v, getattr(n, k, None), captures) for k, v in ast.iter_fields(p) if k not in ("ctx", "type_comment", "kind"))
    return p == n


def same_list(p: list, n: list, captures: dict[str, str]) -> bool:
    if not p:
        return not n
    head = p[0].value if isinstance(p[0], ast.Expr) else p[0]
    if isinstance(head, ast.Name) and head.id == "META_REST":
        return any(same_list(p[1:], n[i:], captures) for i in range(len(n) + 1))
    return bool(n) and same(p[0], n[0], captures) and same_list(p[1:], n[1:], captures)


@dataclass(frozen=True)
class ArchRule:
    """A pattern that files under ``path`` should not contain."""

    id: str
    pattern: str
    message: str
    severity: str = "warning"
    path: str = ""
    inside: str = ""


VIOLATION = "rule_id string, severity string, message string, file_path string, line int, snippet string"


def audit(files: DataFrame, rules: list[ArchRule]) -> DataFrame:
    """Violations (rule_id, severity, message, file_path, line, snippet) of all rules; a file is dealt out and read once."""
    if not rules:
        raise ValueError("no rules")
    schema = pa.schema([(c, ARROW[t]) for c, t in (x.split(" ") for x in VIOLATION.split(", "))])

    def of_file(path: str, text: str) -> list[tuple]:
        mine = [r for r in rules if r.path in path]
        found = matches(path, text, [(r.pattern, r.inside, "") for r in mine])
        return [(mine[i].id, mine[i].severity, mine[i].message, path, line, snippet) for i, line, snippet, _ in found]

    ruled = reduce(Column.__or__, [F.col("path").contains(r.path) for r in rules])
    return dealt(files.where(ruled)).mapInArrow(of_files(of_file, schema), VIOLATION)


def normalize_callees(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Callees whose first part is an alias (path, alias, target) put in full; an alias of two targets is left."""
    clear = aliases.groupBy("path", "alias").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n")).where("n = 1").select("path", F.col("alias").alias("_head"), "target")
    head = F.substring_index("callee", ".", 1)
    rest = F.expr("substring(callee, length(_head) + 1)")
    return calls.withColumn("_head", head).join(clear, ["path", "_head"], "left").withColumn("callee", F.when(F.col("target").isNotNull(), F.concat("target", rest)).otherwise(F.col("callee"))).drop("_head", "target")


