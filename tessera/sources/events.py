"""JSON-lines sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "symbol_name string, symbol_path string, hit_count long, last_used long"
TEST_EVENT = "Time string, Action string, Package string, Test string, Output string, Elapsed double"


def usage_of(rows: DataFrame) -> DataFrame:
    """Usage records of text lines (value): malformed lines and lines without a name go, missing counts are one."""
    j = F.from_json("value", USAGE)
    out = rows.select(j.alias("j")).select("j.*").where("coalesce(symbol_name, '') <> ''")
    hits = F.when(F.coalesce("hit_count", F.lit(0)) <= 0, F.lit(1)).otherwise(F.col("hit_count")).cast("long")
    return out.withColumn("symbol_path", F.coalesce("symbol_path", F.lit(""))).withColumn("hit_count", hits)


def usage(spark: SparkSession, path: str) -> DataFrame:
    return usage_of(spark.read.text(path))


def test_events_of(rows: DataFrame) -> DataFrame:
    """Ordered test events of text lines (value, and seq if there is one)."""
    seq = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
    return rows.select(seq.alias("seq"), F.from_json("value", TEST_EVENT).alias("j")).where("j.Action is not null").select("seq", F.col("j.Package").alias("package"), F.col("j.Test").alias("test"), F.col("j.Action").alias("action"), F.coalesce("j.Output", F.lit("")).alias("output"), F.col("j.Elapsed").alias("elapsed"))


def test_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of one test are in one file, which is read in its order."""
    return test_events_of(spark.read.text(path))


def deltas(spark: SparkSession, path: str) -> DataFrame:
    """Per-file JSON documents (path, symbols, calls) as written by ``sinks.export_delta``."""
    return spark.read.option("recursiveFileLookup", True).json(path)
