"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = "^\\+\\+\\+ b/(.+)$"
HUNK = "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@"


def changed_ranges(diff: DataFrame) -> DataFrame:
    """(path, start, end) of the hunks of diffs (doc_id, line_no, line)."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.nullif(F.regexp_extract("line", FILE, 1), F.lit("")), ignorenulls=True).over(so_far)
    rows = diff.where(F.col("line").rlike(FILE) | F.col("line").rlike(HUNK)).withColumn("path", path).where(F.col("line").rlike(HUNK) & F.col("path").isNotNull())
    start = F.regexp_extract("line", HUNK, 1).try_cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("line", HUNK, 2), F.lit("")).try_cast("int"), F.lit(1))
    return rows.select("path", start.alias("start"), (start + count - 1).alias("end"))
