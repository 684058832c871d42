"""Output of a version control program as rows: commits with their files, and the origin of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.strings import era

# fixed values: the formats that are read
LOG_FORMAT = "commit %H %ct %s"  # with --name-only
COMMIT = "^commit (\\S+) (\\d+) ?(.*)$"
BLAME = "^([0-9a-f]{7,64}) \\d+ (\\d+)( \\d+)?$"  # of --line-porcelain


def so_far(value: Column) -> Column:
    """The last value that is not null up to this line of a document."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def part(pattern: str, group: int) -> Column:
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, group))


def git_log(lines: DataFrame) -> DataFrame:
    """(commit, ts, subject, path) of log lines (doc_id, line_no, line) in LOG_FORMAT; ts in seconds."""
    named = lines.withColumn("commit", so_far(part(COMMIT, 1))).withColumn("ts", so_far(part(COMMIT, 2)).cast("long")).withColumn("subject", so_far(part(COMMIT, 3)))
    return named.where(~F.col("line").rlike(COMMIT) & (F.trim("line") != "") & F.col("commit").isNotNull()).select("commit", "ts", "subject", F.trim("line").alias("path"))


def git_blame(lines: DataFrame) -> DataFrame:
    """(path, line, commit, author, subject, era) of each line of source in porcelain blame lines (doc_id, line_no, line)."""
    named = lines.withColumn("commit", so_far(part(BLAME, 1))).withColumn("at", so_far(part(BLAME, 2)).cast("int"))
    for name, mark in (("author", "author "), ("subject", "summary "), ("path", "filename ")):
        named = named.withColumn(name, so_far(F.when(F.col("line").startswith(mark), F.substring("line", len(mark) + 1, 1 << 30))))
    return named.where(F.col("line").startswith("\t")).select("path", F.col("at").alias("line"), "commit", "author", "subject", era(F.col("subject")).alias("era"))
