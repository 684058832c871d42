"""String, path, hash and date column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns that results depend on
ANSI = "\\x1b\\[[0-9;]*[a-zA-Z]"
SOURCE_PREFIX = "^(src|lib|internal|pkg|vendor)/"
SECRET_FLAG = "(?i)(--?(?:token|pass(?:word)?|p|api-?key|secret|auth|key|credential|u)[= ])(\\S+)"
SECRET_ENV = "(?i)\\b([a-z0-9_]*(?:token|api_?key|secret|pass(?:word)?|credential|auth)[a-z0-9_]*=)([^\\s]+)"
SECRET_URI = "([a-zA-Z]+://[^:\\s]+:)([^@\\s]+)(@[^\\s]+)"
ERAS = [("Fix", "(?i)fix|bug|patch"), ("Refactor", "(?i)refactor|perf|clean|optimize"), ("Feature", "(?i)feat|add|new|implement")]
GO_FAILURE = "^\\s+([^:\\n]+?\\.go):(\\d+):"


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def truncate_line(c: Column, most: int = 80, ellipsis: str = "...") -> Column:
    """At most ``most`` code points, the ellipsis included."""
    most = max(most, len(ellipsis) + 1)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(ellipsis)), F.lit(ellipsis))).otherwise(c)


def truncate(c: Column, most: int) -> Column:
    """As truncate_line with dots, but up to three code points have none."""
    if most <= 3:
        return F.substring(c, 1, max(0, most))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def compact_path(c: Column) -> Column:
    return F.regexp_replace(c, SOURCE_PREFIX, "")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4).cast("long")


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def count_lines(c: Column) -> Column:
    breaks = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(F.length(c) == 0, 0).otherwise(breaks + F.when(c.endswith("\n"), 0).otherwise(1)).cast("long")


def clean_comment(c: Column) -> Column:
    """Comment marks gone from each line, blank lines dropped."""
    ends = lambda x: F.regexp_replace(F.regexp_replace(trim(x), "^(/\\*\\*?|\"\"\"|''')", ""), "(\\*/|\"\"\"|''')$", "")
    bare = F.transform(F.split(c, "\n"), lambda x: trim(F.regexp_replace(ends(x), "^(//|#|\\*)", "")))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def redact_secrets(c: Column) -> Column:
    """Values of secret-like flags, assignments and URI logins replaced."""
    out = F.regexp_replace(c, SECRET_FLAG, "$1[REDACTED]")
    out = F.regexp_replace(out, SECRET_ENV, "$1[REDACTED]")
    return F.regexp_replace(out, SECRET_URI, "$1[REDACTED]$3")


def extract_json(c: Column) -> Column:
    """From the first opening bracket to the last closing one; the text itself if there is none."""
    found = F.regexp_extract(c, "(?s)([\\[\\{].*[\\]\\}])", 1)
    return F.when(found == "", c).otherwise(found)


def extract_code_block(c: Column) -> Column:
    """Inside of the first fenced block; the text itself if there is none."""
    fenced = "(?s)```(?:[a-zA-Z0-9]+)?\\n?(.*?)\\n?```"
    return trim(F.when(c.rlike(fenced), F.regexp_extract(c, fenced, 1)).otherwise(c))


def parse_rating(c: Column) -> Column:
    """The number before ``/ 10``; null if there is none."""
    return F.nullif(F.regexp_extract(c, "(\\d+(?:\\.\\d+)?)\\s*/\\s*10", 1), F.lit("")).try_cast("double")


def extract_list(c: Column, header: str) -> Column:
    """Bullets after a line with ``header``, up to the first other line after one."""
    lines = F.transform(F.split(c, "\n"), lambda x: trim(x))
    start = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(header.lower()))), F.lit(True))
    rest = F.filter(F.slice(lines, F.greatest(start, F.lit(1)).cast("int") + 1, F.size(lines)), lambda x: (x != "") & ~F.contains(F.lower(x), F.lit(header.lower())))
    other = F.array_position(F.transform(rest, lambda x, i: (i > 0) & ~x.rlike("^[-*]") & F.exists(F.slice(rest, F.lit(1), F.greatest(i, F.lit(0))), lambda y: y.rlike("^[-*]"))), F.lit(True))
    kept = F.when(other > 0, F.slice(rest, F.lit(1), other.cast("int") - 1)).otherwise(rest)
    items = F.transform(F.filter(kept, lambda x: x.rlike("^[-*]")), lambda x: trim(F.substring(x, 2, 2147483647)))
    return F.when(start > 0, F.filter(items, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def era(subject: Column) -> Column:
    """Kind of change that a commit subject tells."""
    out = F.when(subject.rlike(ERAS[0][1]), ERAS[0][0])
    for name, pattern in ERAS[1:]:
        out = out.when(subject.rlike(pattern), name)
    return out.otherwise("Chore")


def go_failure(c: Column) -> Column:
    """(file, line) that a failure line of a Go test names; null if none."""
    file, line = F.regexp_extract(c, GO_FAILURE, 1), F.regexp_extract(c, GO_FAILURE, 2)
    return F.when(file != "", F.struct(file.alias("file"), line.try_cast("int").alias("line")))


def map_test_to_symbol(test: Column) -> Column:
    """Name of the symbol that a test's name points at."""
    bare = F.regexp_replace(test, "^Test", "")
    parts = F.split(bare, "_")
    return F.when((F.size(parts) > 1) & (parts[0] == "Store"), F.concat(F.lit("Store."), F.get(parts, F.lit(1)))).otherwise(parts[0])


def prune_history(c: Column) -> Column:
    """Texts over 500 characters keep their first and last hundred."""
    return F.when(F.octet_length(c) > 500, F.concat(F.substring(c, 1, 100), F.lit("\n... [pruned] ...\n"), F.substring(c, -100, 100))).otherwise(c)


def fqn(package: Column, name: Column) -> Column:
    return F.when(F.coalesce(package, F.lit("")) == "", name).otherwise(F.concat_ws(".", package, name))


def local_name(full: Column) -> Column:
    return F.substring_index(full, ".", -1)


def qualify(owner: Column, name: Column) -> Column:
    """Name with what it belongs to before it; alone if that is empty."""
    return fqn(owner, name)


def module_path(path: Column) -> Column:
    """Dotted module of a Python path."""
    return F.regexp_replace(F.regexp_replace(path, "(/__init__)?\\.py$", ""), "/", ".")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def shard_route(path: Column) -> Column:
    """Shard name: four hex digits of the parent folder's hash."""
    return F.substring(F.sha2(dirname(path), 256), 1, 4)


def signature_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def week_of_year(ts: Column) -> Column:
    """Year and Monday-first week number 00 to 53."""
    number = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.format_string("%04d-W%02d", F.year(ts), number)


def savings_pct(saved: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(saved * F.lit(100.0), total), F.lit(0.0))


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns], F.lit(False))


def path_starts(c: Column, prefix: str) -> Column:
    """ASCII case-insensitive prefix; a relative prefix is an error and none matches all."""
    if not prefix:
        return F.lit(True)
    if not prefix.startswith("/"):
        raise ValueError("a path prefix must be absolute")
    return F.startswith(F.lower(c), F.lower(F.lit(prefix)))
