"""JSON with comments and trailing commas, and deep merges of objects."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An overlay's object with this key alone stands for its value, which is not merged.
REPLACE = "__replace__"
PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.DOTALL)


def strip(text: str) -> str:
    """Plain JSON: comments and trailing commas gone, strings as they are."""
    bare = PIECES.sub(lambda m: m[0] if m[0][0] == '"' else " ", text.removeprefix("﻿"))
    return TRAILING.sub(lambda m: m[1] or "", bare)


def parse(text: str) -> Any:
    return json.loads(strip(text))


def unwrapped(v: Any) -> Any:
    """A value without marks to replace."""
    if not isinstance(v, dict):
        return v
    return v[REPLACE] if [*v] == [REPLACE] else {k: unwrapped(x) for k, x in v.items()}


def merge(base: dict, overlay: dict) -> dict:
    """Objects key by key, deep where both sides have objects; else the overlay's value."""
    out = dict(base)
    for k, v in overlay.items():
        deep = isinstance(v, dict) and [*v] != [REPLACE] and isinstance(out.get(k), dict)
        out[k] = merge(out[k], v) if deep else unwrapped(v)
    return out


def merge_texts(base: str, overlay: str) -> str:
    """Two texts merged; a base that is no object counts as an empty one, such an overlay is an error."""
    try:
        first = parse(base)
    except ValueError:
        first = {}
    second = parse(overlay)
    if not isinstance(second, dict):
        raise ValueError("the overlay is not an object")
    return json.dumps(merge(first if isinstance(first, dict) else {}, second), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def merged(base: Column, overlay: Column) -> Column:
    """``merge_texts`` of two columns, in batches."""
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([merge_texts(x or "", y or "{}") for x, y in zip(a, b, strict=True)])

    return run(base, overlay)
