"""Streams over file sources.

Every query takes the checkpoint folder as a parameter; on a cluster it is a shared one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import telemetry
from tessera.operators.lines import ACTIONS, Stream
from tessera.sources import events

def windowed_usage(rows: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums; rows later than ``late`` behind the newest are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def usage_counts(spark: SparkSession, folder: str, environment: str = "") -> DataFrame:
    """Running usage of symbols over a folder of JSON-lines files, for update or complete mode."""
    rows = events.usage_of(spark.readStream.text(folder))
    return rows.groupBy("symbol_name", "symbol_path", F.lit(environment).alias("environment")).agg(F.sum("hit_count").alias("hit_count"), F.max("last_used").alias("last_used"))


USAGE_TABLE = "symbol_id long, environment string, hit_count long, last_used long"
#: Batches after which the changes are merged into the base of a usage table.
MERGE_EVERY = 16


def ingest_usage(spark: SparkSession, folder: str, table: str, checkpoint: str, resolve: Callable[[DataFrame], DataFrame], files: int = 1000) -> StreamingQuery:
    """Add every micro-batch of usage lines, of ``files`` files at most, to a table as a part of its own; parts are merged now and then.

    ``resolve`` gives (symbol_id, environment, hit_count, last_used). A batch that is run
    again writes its own part again, and a merge that is run again reads the same parts.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        new = telemetry.usage_rollup(resolve(events.usage_of(batch))).select("symbol_id", "environment", "hit_count", "last_used")
        new.write.mode("overwrite").parquet(f"{table}/part={batch_id}")
        if batch_id and batch_id % MERGE_EVERY == 0:
            usage_table(spark, table, batch_id).write.mode("overwrite").parquet(f"{table}/base={batch_id}")

    return spark.readStream.option("maxFilesPerTrigger", files).text(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_table(spark: SparkSession, table: str, last: int | None = None) -> DataFrame:
    """Usage up to batch ``last``: the newest base before it and the parts after that base."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName().partition("=") for f in system.listStatus(root)] if system.exists(root) else []
    complete = lambda kind, n: system.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"{kind}={n}/_SUCCESS"))
    found = sorted((kind, int(n)) for kind, _, n in names if kind in ("base", "part") and complete(kind, n))
    base = max((n for kind, n in found if kind == "base" and (last is None or n < last)), default=-1)
    paths = [f"{table}/base={base}"] if base >= 0 else []
    paths += [f"{table}/part={n}" for kind, n in found if kind == "part" and n > base and (last is None or n <= last)]
    if not paths:
        return spark.createDataFrame([], USAGE_TABLE)
    rows = spark.read.schema(USAGE_TABLE).parquet(*paths)
    return rows.groupBy("symbol_id", "environment").agg(F.sum("hit_count").alias("hit_count"), F.max("last_used").alias("last_used"))


def incremental(known: DataFrame, present: DataFrame) -> DataFrame:
    """Files to parse again and files whose time alone is new: (path, hash, mtime, action)."""
    k = known.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m"))
    action = F.when(F.col("_h").isNull() | (F.col("_h") != F.col("hash")), "parse").when(F.col("_m") != F.col("mtime"), "touch").otherwise("skip")
    return present.join(k, "path", "left").select("path", "hash", "mtime", action.alias("action"))


def index_changes(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Give every micro-batch of new file rows to ``apply``, all that there is now and then end."""
    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def line_filter(lines: DataFrame, level: str = "moderate") -> DataFrame:
    """The noise filter on a stream of (line)."""
    return line_pipeline(lines, [{"action": "strip_ansi"}, {"action": "noise_filter", "level": level}])


def in_batches(rows: DataFrame, size: int = 500) -> DataFrame:
    """``rows`` with a ``batch`` of ``size`` rows at most, each of one partition, for writers that take so many at a time."""
    at = F.monotonically_increasing_id()
    batch = F.struct(F.shiftright(at, 33).cast("int").alias("part"), F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / size).cast("long").alias("number"))
    return rows.withColumn("batch", batch)


#: Actions that look at one line at a time, and so run on streams.
STATELESS = {"keep_lines", "remove_lines", "truncate_lines", "strip_ansi", "compact_path", "noise_filter", "regex_extract"}


def line_pipeline(lines: DataFrame, pipeline: list[dict]) -> DataFrame:
    """A pipeline of actions that need no neighbour lines, on a stream of (line); another action is an error."""
    s = Stream(lines)
    for step in pipeline:
        if step["action"] not in STATELESS:
            raise ValueError(f"{step['action']!r} needs whole documents")
        s = ACTIONS[step["action"]](s, **{k: v for k, v in step.items() if k != "action"})
    return s.lines


def run_in_batches(rows: DataFrame, by: str, batches: int, root: str, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``apply`` gives in append mode for a stream of ``rows``, which come in as many batches, in order of ``by``.

    The stream ends after each batch and is started again from its checkpoint for the next.
    """
    spark, ddl = rows.sparkSession, rows.schema
    dealt = rows.repartitionByRange(batches, by).withColumn("_batch", F.spark_partition_id())
    dealt.write.partitionBy("_batch").parquet(f"{root}/all")
    for i in range(batches):
        spark.read.schema(dealt.schema).parquet(f"{root}/all").where(F.col("_batch") == i).drop("_batch").write.mode("append").parquet(f"{root}/in")
        out = apply(spark.readStream.schema(ddl).parquet(f"{root}/in"))
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def fresh_notes(rows: DataFrame, time: str = "created_at", within: str = "24 hours") -> DataFrame:
    """Notes whose text did not come in the time before."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(["content"])
