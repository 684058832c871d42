"""Fill-in-the-middle arrangements of whole texts, with DataFrame functions only.

A text is an array of units, runs of ASCII letters and single other characters. A
SHA-256 of the document's number gives two cuts between units, whether the text is
changed at all, and which of two arrangements it gets: prefix, suffix, middle (psm) or
suffix, prefix, middle (spm), each part behind its mark. A mark holds one ``<``, at its
start, and a text with any mark in it is left plain, so the first mark found after
another is that which was put there, and parsing the marks gives the text back.

Nothing is shuffled: a row's result follows from the row. A text's units are held as
one array while its row is worked on, about forty bytes for each.

Defined cases: a null text counts as an empty one, which is plain; a null ``doc_id``
counts as the empty string where the hash is taken; repeated rows each get a row; an
empty table gives an empty result. Columns other than the two read pass through
``arranged`` whatever their names, and are ignored by ``digests``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Rates:
    """Of a hundred texts so many are left plain, and of a hundred others so many are spm; ``salt`` chooses which."""

    plain: int = 10
    spm: int = 20
    salt: str = "1"


def draw(key: Column, i: int) -> Column:
    """The i-th group of eight hex digits of a hash as an unsigned number, from 0."""
    return F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long")


def joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start.cast("int"), length.cast("int")), "")


def arranged(docs: DataFrame, rates: Rates = Rates(), out: str = "fim") -> DataFrame:
    """``docs`` with a column ``out``: struct<n, form, prefix, suffix, middle, output>; the parts are null for plain texts."""
    free = "_" * (1 + max(map(len, docs.columns)))  # a prefix that no column has
    text, units, n, key, low, high, form = (f"{free}{x}" for x in ("text", "units", "n", "key", "low", "high", "form"))
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = docs.withColumns({text: whole, units: F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)), key: F.sha2(F.concat(F.lit(f"{rates.salt}:"), number).cast("binary"), 256)})
    rows = rows.withColumns({n: F.size(units).cast("long")})
    first, second = (draw(F.col(key), i) % (F.col(n) + 1) for i in (0, 1))
    marked = F.contains(F.col(text), F.lit(PREFIX)) | F.contains(F.col(text), F.lit(SUFFIX)) | F.contains(F.col(text), F.lit(MIDDLE))
    plain = (F.col(text) == "") | marked | (draw(F.col(key), 2) % 100 >= 100 - rates.plain)
    rows = rows.withColumns({low: F.least(first, second), high: F.greatest(first, second), form: F.when(plain, "plain").when(draw(F.col(key), 3) % 100 < rates.spm, "spm").otherwise("psm")})
    part = lambda start, length: F.when(F.col(form) != "plain", joined(F.col(units), start, length))
    parts = {
        "prefix": part(F.lit(1), F.col(low)),
        "middle": part(F.col(low) + 1, F.col(high) - F.col(low)),
        "suffix": part(F.col(high) + 1, F.col(n) - F.col(high)),
    }
    rows = rows.withColumns({f"{free}{k}": v for k, v in parts.items()})
    prefix, suffix, middle = (F.col(f"{free}{k}") for k in ("prefix", "suffix", "middle"))
    output = (
        F.when(F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col(text))
    )
    fields = [F.col(n).alias("n"), F.col(form).alias("form"), prefix.alias("prefix"), suffix.alias("suffix"), middle.alias("middle"), output.alias("output")]
    return rows.select(*docs.columns, F.struct(*fields).alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text of an arrangement, from its marks."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        head = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(head) + len(second) + 1)
        middle = F.substring_index(rest, MIDDLE, 1)
        return head, middle, F.substr(rest, F.char_length(middle) + len(MIDDLE) + 1)

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digests(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for every row of ``docs``."""
    rows = arranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rates)
    size = lambda c: F.char_length(c).cast("long")
    named = rows.select("doc_id", "fim.n", "fim.form", size("fim.prefix").alias("prefix_chars"), size("fim.middle").alias("middle_chars"), F.col("fim.output").alias("output"))
    return named.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
