"""Changes of files as a feed, and tables that follow it.

A feed's rows say what became of a path: (path, op, old_path, before, after), where before
and after are hashes. A rename is a path that is gone and one that is new with the same
content; of several with one content those are paired that come at the same place in order of path.
Tables follow a feed batch by batch. The number of the last batch is committed with its
rows, in one manifest, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.tables import Change, Tables

FEED = "path string, op string, old_path string, before string, after string"


def changes(known: DataFrame, present: DataFrame) -> DataFrame:
    """The feed that leads from ``known`` (path, hash) to ``present``: add, change, delete and rename rows."""
    both = known.select("path", F.col("hash").alias("before")).join(present.select("path", F.col("hash").alias("after")), "path", "full_outer")
    moved = both.where(~F.col("before").eqNullSafe(F.col("after")))
    place = lambda by: F.row_number().over(Window.partitionBy("hash").orderBy(by))
    gone = moved.where("after is null").select(F.col("path").alias("old_path"), F.col("before").alias("hash")).withColumn("n", place("old_path"))
    new = moved.where("before is null").select("path", F.col("after").alias("hash")).withColumn("n", place("path"))
    pairs = new.join(gone, ["hash", "n"], "full_outer")
    op = F.when(F.col("path").isNull(), "delete").when(F.col("old_path").isNull(), "add").otherwise("rename")
    rows = pairs.select(F.coalesce("path", "old_path").alias("path"), op.alias("op"), F.when(op == "rename", F.col("old_path")).alias("old_path"), F.when(op != "add", F.col("hash")).alias("before"), F.when(op != "delete", F.col("hash")).alias("after"))
    return rows.unionByName(moved.where("before is not null and after is not null").select("path", F.lit("change").alias("op"), F.lit(None).cast("string").alias("old_path"), "before", "after"))


def once(c: Change, feed: str, batch_id: int) -> bool:
    """Whether this batch of a feed is new to the tables; it is theirs when the change is committed."""
    last = c.before.get("_feeds", {}).get(feed, ["-1"])[0]
    if int(last) >= batch_id:
        return False
    c.touched["_feeds", feed] = [str(batch_id)]
    return True


def follow(c: Change, name: str, rows: DataFrame, fresh: Callable[[DataFrame], DataFrame]) -> None:
    """Table ``name`` without the paths that went or changed, and with ``fresh`` of those that are there now."""
    stale = rows.select("path").union(rows.where("old_path is not null").select("old_path")).distinct()
    c.replace_paths(name, fresh(rows.where("op <> 'delete'")), stale)


def shadow(spark: SparkSession, folder: str, tables: Tables, name: str, fresh: Callable[[DataFrame], DataFrame], checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Let a table follow the feed rows that are in JSON files of ``folder``, ``files`` at a time, all that there are and then end."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        tables.update(lambda c: follow(c, name, batch, fresh) if once(c, folder, batch_id) else None)

    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files).json(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
