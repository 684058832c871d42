"""Vector functions and embedders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]


def l2_distance(v: Column, query: list[float]) -> Column:
    """Euclidean distance to a fixed vector, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value evaluated once for a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def to_bytes(v: Column) -> Column:
    """A vector as little-endian 32-bit floats, in batches."""
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else np.asarray(r, "<f4").tobytes())

    return run(v)


def from_bytes(b: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else np.frombuffer(r, "<f4").tolist())

    return run(b)


def word_slot(word: Column, dimension: int) -> Column:
    """Slot of a word: the first 32 bits of its MD5, modulo the dimension."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimension)).cast("int")


def hash_embedder(dimension: int = 64) -> Embedder:
    """Deterministic bag-of-words vectors of unit length; a stand-in for a learned model.

    Slots are sorted once; the places where their value changes give the counts, so the
    work is that of the words and not of words times dimension.
    """

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
        slots = F.array_sort(F.transform(words, lambda w: word_slot(w, dimension)))
        # the last place of each slot in order, as (slot, place)
        ends = lambda s: F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i + 1), F.lit(-1)) != x, F.struct(x.alias("slot"), (i + 1).alias("place")))), lambda p: p.isNotNull())
        sizes = lambda e: F.map_from_arrays(F.transform(e, lambda p: p["slot"]), F.transform(e, lambda p, i: (p["place"] - F.coalesce(F.get(e, i - 1)["place"], F.lit(0))).cast("double")))
        of = F.sequence(F.lit(0), F.lit(dimension - 1))
        counts = once(once(slots, ends), lambda e: once(sizes(e), lambda m: F.transform(of, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))))
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return once(counts, lambda c: once(norm(c), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float"))))

    return embed
