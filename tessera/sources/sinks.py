"""Writers of results."""

from __future__ import annotations

import hashlib
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_delta(symbols: DataFrame, edges: DataFrame, path: str) -> None:
    """A JSON document for each file, in a folder of its own: its path, symbols and calls."""
    delta(symbols, edges).withColumn("file", F.regexp_replace("path", "/", "_")).write.mode("overwrite").partitionBy("file").json(path)


def delta(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    s = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "type", "start_line", "end_line"))).alias("symbols"))
    c = edges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("caller", "callee", "line", "link_type"))).alias("calls"))
    return s.join(c, "path", "full_outer")


def gain_csv(days: DataFrame) -> DataFrame:
    """Daily rows as exported to CSV: savings with one digit."""
    return days.select("day", "commands", "input_tokens", "output_tokens", "saved_tokens", F.format_string("%.1f", "avg_savings").alias("savings_pct"))


def export_csv(days: DataFrame, path: str) -> None:
    gain_csv(days).write.mode("overwrite").option("header", True).csv(path)


def gain_json(summary: DataFrame, days: DataFrame, commands: DataFrame) -> DataFrame:
    """(json): summary, daily and by-command rows in one object; all three are small."""
    listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows"))
    s = summary.select(F.struct(*summary.columns).alias("summary"))
    both = s.crossJoin(listed(days).withColumnRenamed("rows", "daily")).crossJoin(listed(commands).withColumnRenamed("rows", "by_command"))  # one row each
    return both.select(F.to_json(F.struct("summary", "daily", "by_command")).alias("json"))


def tee(text: str, folder: str, failed: bool, mode: str = "failures", least: int = 200, most: int = 1 << 20, keep: int = 20) -> Path | None:
    """Raw output kept under its hash; the newest ``keep`` files stay."""
    data = text.encode()
    if mode == "never" or mode == "failures" and not failed or len(data) < least:
        return None
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    out = where / f"{int(time.time() * 1e6)}-{hashlib.sha256(data).hexdigest()[:12]}.log"
    out.write_bytes(data[:most])
    for old in sorted(where.glob("*.log"))[:-keep]:
        old.unlink()
    return out


def insert(existing: DataFrame, commands: DataFrame) -> DataFrame:
    """Telemetry with new commands, redacted and with their savings, appended."""
    from tessera.operators.telemetry import prepare

    return existing.unionByName(prepare(commands).select(*existing.columns))
