"""A subset of brace templates, as used by line pipelines.

Supported: ``{{.a.b}}``, ``{{if X}}..{{else}}..{{end}}``, ``{{with .a}}..{{else}}..
{{end}}``, ``{{range .a}}..{{end}}`` and the calls eq, ne, lt, gt, and, or, not, len.
"""

from __future__ import annotations

import re
from typing import Any

TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.DOTALL)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\(|\)|[^\s()]+')


def go_text(v: Any) -> str:
    """A value as %v prints it: whole floats without a point, large ones with an exponent."""
    if v is None:
        return "<no value>"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if v == int(v) and abs(v) < 1e21:
            return str(int(v)) if abs(v) < 1e6 or v != v else _exponent(v)
        return _exponent(v) if abs(v) >= 1e21 or 0 < abs(v) < 1e-4 else repr(v)
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{go_text(x)}" for k, x in sorted(v.items())) + "]"
    if isinstance(v, list | tuple):
        return "[" + " ".join(map(go_text, v)) + "]"
    return str(v)


def _exponent(v: float) -> str:
    base, _, power = f"{v:e}".partition("e")
    digits = repr(v / 10 ** int(power)) if abs(int(power)) < 300 else base
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    return f"{digits}e{'-' if int(power) < 0 else '+'}{abs(int(power)):02d}"


def render(template: str, data: Any) -> str:
    parts, at = [], 0
    for m in TAG.finditer(template):
        parts += [("text", template[at : m.start()]), ("tag", m[1])]
        at = m.end()
    parts.append(("text", template[at:]))
    out, rest = _block(parts, 0, data, True)
    if rest != len(parts):
        raise ValueError("template: unexpected end")
    return out


def _block(parts: list, at: int, dot: Any, live: bool) -> tuple[str, int]:
    out = []
    while at < len(parts):
        kind, s = parts[at]
        if kind == "text":
            out.append(s)
            at += 1
            continue
        word = s.split(None, 1)[0] if s else ""
        if word in ("end", "else"):
            return "".join(out), at
        if word in ("if", "with", "range"):
            value = _value(TOKEN.findall(s)[1:], dot) if live else None
            yes = live and truth(value)
            if word == "range":
                body = [_block(parts, at + 1, x, True)[0] for x in value] if yes else []
                _, end = _block(parts, at + 1, dot, False)
                text = "".join(body)
            else:
                text, end = _block(parts, at + 1, value if word == "with" else dot, yes)
            other = ""
            if parts[end][1].split(None, 1)[0] == "else":
                other, end = _block(parts, end + 1, dot, live and not yes)
            out.append(text if yes else other)
            at = end + 1
            continue
        if live:
            out.append(go_text(_value(TOKEN.findall(s), dot)))
        at += 1
    return "".join(out) if live else "", at


def mentions(template: str, name: str) -> bool:
    """Whether a template can show ``name`` of its data: some tag has its name, or takes the data whole."""
    return any(re.search(rf"\.{re.escape(name)}\b", tag) or "." in TOKEN.findall(tag) for tag in TAG.findall(template))


def truth(v: Any) -> bool:
    return v is not None and v != 0 and v != "" and v is not False and v != [] and v != {}


def _value(tokens: list[str], dot: Any) -> Any:
    value, rest = _expression(tokens, dot)
    if rest:
        raise ValueError(f"template: unexpected {rest[0]!r}")
    return value


CALLS = {
    "eq": lambda a, *b: any(a == x for x in b), "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b,
    "and": lambda *a: next((x for x in a if not truth(x)), a[-1]), "or": lambda *a: next((x for x in a if truth(x)), a[-1]), "not": lambda a: not truth(a), "len": len,
}


def _expression(tokens: list[str], dot: Any) -> tuple[Any, list[str]]:
    if tokens and tokens[0] in CALLS:
        call, rest, args = CALLS[tokens[0]], tokens[1:], []
        while rest and rest[0] != ")":
            v, rest = _term(rest, dot)
            args.append(v)
        return call(*args), rest
    return _term(tokens, dot)


def _term(tokens: list[str], dot: Any) -> tuple[Any, list[str]]:
    t, rest = tokens[0], tokens[1:]
    if t == "(":
        v, rest = _expression(rest, dot)
        return v, rest[1:]
    if t.startswith('"'):
        return t[1:-1].replace('\\"', '"').replace("\\n", "\n"), rest
    if t == ".":
        return dot, rest
    if t.startswith("."):
        v = dot
        for name in t[1:].split("."):
            v = v.get(name) if isinstance(v, dict) else None
        return v, rest
    return (float(t) if "." in t else int(t)), rest
