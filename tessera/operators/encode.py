"""Text encodings of results."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT, WARM, COLD = "HOT", "WARM", "COLD"
WARM_AFTER, COLD_AFTER = 500, 2000


def zon_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of every row: its values with bars between."""
    return df.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def zon(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(pos, line): a header with the number of rows, then the rows; a bounded result is meant."""
    n = df.agg(F.count("*").alias("n"))
    head = n.select(F.lit(0).cast("long").alias("pos"), F.when(F.col("n") == 0, "@(0)[]").otherwise(F.concat(F.lit("@("), F.col("n").cast("string"), F.lit(f")[{' | '.join(columns)}]"))).alias("line"))
    body = df.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    return head.unionByName(body)


def path_ids(rows: DataFrame, order: str, path: str = "path") -> DataFrame:
    """(path, path_id): numbers from 1 in order of first sight."""
    first = rows.groupBy(path).agg(F.min(order).alias("first"))
    return first.select(path, F.row_number().over(Window.orderBy("first", path)).alias("path_id"))


def hakai_symbols(symbols: DataFrame, ids: DataFrame, hot: bool = True) -> DataFrame:
    """(path_id, line) of symbol rows: S, path number, name, type, line, column, and the rest while hot."""
    parts = [F.lit("S"), F.col("path_id").cast("string"), F.col("name").cast("string"), F.col("type"), F.col("start_line").cast("string"), F.col("start_col").cast("string")]
    if hot:
        parts += [F.coalesce("signature", F.lit("")), F.coalesce("doc", F.lit(""))]
    return symbols.join(ids, "path").select("path_id", F.concat_ws("|", *parts).alias("line"))


def hakai_calls(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids, "path").select("path_id", F.concat_ws("|", F.lit("C"), F.col("path_id").cast("string"), F.col("caller").cast("string")).alias("line"))


def hakai_scores(rows: DataFrame, ids: DataFrame, mark: str, value: str) -> DataFrame:
    """R rows of ranks or K rows of churn."""
    return rows.join(ids, "path").select("path_id", F.concat_ws("|", F.lit(mark), F.col("path_id").cast("string"), F.format_string("%.4f", F.col(value))).alias("line"))


def hakai_critical(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "path").select("path_id", F.concat_ws("|", F.lit("X"), *[F.col(c).cast("string") for c in ("path_id", "name", "centrality", "fragility")]).alias("line"))


def context_state(rows: DataFrame, group: str, order: str, tokens: Column) -> DataFrame:
    """``rows`` with tokens so far in their stream and the state those lead to."""
    so_far = F.sum(tokens).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("tokens_so_far") > COLD_AFTER, COLD).when(F.col("tokens_so_far") > WARM_AFTER, WARM).otherwise(HOT)
    return rows.withColumn("tokens_so_far", so_far).withColumn("state", state)


def symbol_digest(symbols: DataFrame, key: str) -> DataFrame:
    """(key, digest): hash of a group's sorted symbols, each part with its length before it."""
    part = lambda c: F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    one = F.concat(part("path"), part("name"), part("type"), part("start_line"))
    return symbols.select(key, one.alias("one")).groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("one")), ""), 256).alias("digest"))


def cold_lines(symbols: DataFrame, key: str) -> DataFrame:
    """One line with the digest in place of a cold group's symbols."""
    return symbol_digest(symbols, key).select(F.concat(F.lit("@COLD|"), F.col(key).cast("string"), F.lit("|"), "digest").alias("line"))


def mermaid_edges(edges: DataFrame) -> DataFrame:
    """(line) of each distinct caller and callee."""
    return edges.select(F.format_string('  "%s" --> "%s"', F.col("caller").cast("string"), F.col("callee").cast("string")).alias("line")).distinct()


def mermaid(edges: DataFrame, title: str = "", limit: int = 500) -> str:
    """A graph of at most ``limit`` edges, for display."""
    lines = [r.line for r in mermaid_edges(edges).orderBy("line").limit(limit).collect()]
    return "\n".join(["graph TD", *([f'  subgraph "{title}"'] if title else []), *lines, *(["  end"] if title else [])]) + "\n"


def note(symbol: str, risk: dict, callers: list[str], graph: str) -> str:
    """A Markdown note with front matter, the graph and the callers."""
    head = "\n".join(["---", f"symbol: {symbol}", *[f"{k}: {v}" for k, v in sorted(risk.items())], "---"])
    listed = "\n".join(f"- [[{c}]]" for c in callers) or "- none"
    return f"{head}\n\n# {symbol}\n\n```mermaid\n{graph.rstrip()}\n```\n\n## Callers\n\n{listed}\n"


def bar(value: int, most: int, width: int) -> str:
    filled = 0 if most <= 0 else min(max(value * width // most, 0), width)
    return "█" * filled + "░" * (width - filled)


def separator(width: int = 60) -> str:
    return "─" * width


def text_table(rows: list[dict], columns: list[str]) -> str:
    """Columns padded to their widest value, a rule under the header."""
    cells = [[str(r.get(c, "")) for c in columns] for r in rows]
    widths = [max(map(len, [c, *[row[i] for row in cells]])) for i, c in enumerate(columns)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, widths, strict=True)).rstrip()
    return "\n".join([line(columns), "  ".join("─" * w for w in widths), *map(line, cells)])


def staged_diff(path: str, before: str, after: str, context: int = 3) -> str:
    """Unified diff of a staged edit; a last line without a break is marked."""
    whole = lambda x: x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n"
    return "".join(map(whole, difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}", n=context)))
