"""Staged edits as a table: put in, looked at, applied where the file is as it was, and taken back.

Files are (path, content); staged edits (path, before_hash, content, staged_at). A
journal of applied edits (path, before, after_hash) leads back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.operators.encode import staged_diff

STAGED = "path string, before_hash string, content string, staged_at long"


def digest(column: str = "content"):
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def stage(staged: DataFrame, files: DataFrame, edits: DataFrame) -> DataFrame:
    """``staged`` with edits (path, content, staged_at) in place of earlier ones of their paths; new files have an empty hash."""
    known = files.select("path", digest().alias("before_hash"))
    new = edits.join(known, "path", "left").select("path", F.coalesce("before_hash", F.lit("")).alias("before_hash"), "content", "staged_at")
    return store.upsert(staged, new, ["path"])


def unstage(staged: DataFrame, paths: DataFrame) -> DataFrame:
    return staged.join(paths.select("path"), "path", "left_anti")


def conflicts(staged: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of staged edits whose file has changed, come or gone since they were staged."""
    now = files.select("path", digest().alias("hash"))
    return staged.join(now, "path", "left").where(F.coalesce("hash", F.lit("")) != F.col("before_hash")).select("path")


def diffs(staged: DataFrame, files: DataFrame) -> DataFrame:
    """(path, diff) of every staged edit against its file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "diff": [staged_diff(p, x or "", y or "") for p, x, y in zip(b["path"], b["before"], b["content"], strict=True)]})

    return staged.join(files.select("path", F.col("content").alias("before")), "path", "left").select("path", "before", "content").mapInPandas(run, "path string, diff string")


def apply(staged: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with all staged edits, and the journal; no edit is applied while one of them is in conflict."""
    if not conflicts(staged, files).isEmpty():
        raise ValueError("files have changed since their edits were staged")
    journal = staged.join(files.select("path", F.col("content").alias("before")), "path", "left").select("path", "before", digest().alias("after_hash"))
    return store.upsert(files.select("path", "content"), staged.select("path", "content"), ["path"]), journal


def roll_back(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Files as they were before a journal's edits; those that were changed again since are left alone."""
    mine = journal.withColumnRenamed("after_hash", "_hash").withColumn("_applied", F.lit(True))
    joined = files.select("path", "content").join(mine, "path", "left").withColumn("_applied", F.coalesce(F.col("_applied") & (digest() == F.col("_hash")), F.lit(False)))
    return joined.where(~F.col("_applied") | F.col("before").isNotNull()).select("path", F.when(F.col("_applied"), F.col("before")).otherwise(F.col("content")).alias("content"))
