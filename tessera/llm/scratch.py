"""Shared working storage and distributed running sums.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor and the driver can reach, so a lost executor costs a re-read and
not a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, True)
        path = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Rows and bytes of an Arrow batch of texts at most, unless the session states its own number of rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded for texts; Spark's default would hold 10,000 rows at once."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Remove the files of working tables that nothing will read again."""
    for t in tables:
        _made.remove(t.working_path)
        remove(t.sparkSession, t.working_path)


@contextmanager
def working(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Working tables made inside are removed at the end, but for those given to the function that this yields."""
    first, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.working_path)
        return df

    yield keep
    for path in [p for p in _made[first:] if p not in kept]:
        _made.remove(path)
        remove(spark, path)


def discard(spark: SparkSession) -> None:
    """Remove all working tables of this process; results that read them must have been written before."""
    while _made:
        remove(spark, _made.pop())


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.working_path = path
    return out


def running_sum(df: DataFrame, groups: list[str], order: list[str], weight: Column, out: str) -> DataFrame:
    """Sum of ``weight`` over the rows before each row, within its group.

    Ordered by ``order``, which must be unique for a fully determined result.
    Rows are dealt by range over (groups, order), so a group of any size is
    spread over tasks: each task sums its own stretch and adds the totals of the
    earlier stretches. The totals are one row for each task and group.
    """
    tagged = df.withColumn("_w", weight.cast("long"))
    tagged = tagged.repartitionByRange(*groups, *order).withColumn("_p", F.spark_partition_id())
    tagged = materialize(tagged, "ranges")
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*groups, "_p").agg(F.sum("_w").alias("_t"))
    # one row for each task, and one more for each further group in it
    base = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    here = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        here = here & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = tagged.join(F.broadcast(base), here)
    inside = Window.partitionBy("_p", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).drop("_w", "_p", "_q", "_base", *[f"_g{i}" for i in range(len(groups))])


def streamed_sums(df: DataFrame, key: str, order: list[Column], weights: dict[str, Column]) -> DataFrame:
    """``df`` with sums of ``weights`` (name: value, long) over each row and those before it, among rows of its ``key``.

    ``key`` is a long and never null; rows equal in ``order`` are interchangeable. Rows are
    dealt by range over (key, order) and added up in the same task in which they arrive,
    with one running total held, so a key of any size is spread over tasks. Only the first
    key of a task can have begun in an earlier one: what it brings along is a row for each
    task at most, and is broadcast.
    """
    dealt = df.withColumns({f"_{k}": w.cast("long") for k, w in weights.items()})
    dealt = dealt.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_p", F.spark_partition_id())
    names, sums_of = dealt.columns, list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals = None, dict.fromkeys(sums_of, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(names.index(key)).to_numpy()
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(starts, len(k)))
            columns = []
            for name in sums_of:
                sums = np.cumsum(batch.column(names.index(f"_{name}")).to_numpy())
                before = np.where(starts > 0, sums[starts - 1], 0)
                if last == k[0]:
                    before[0] = -totals[name]
                sums = sums - np.repeat(before, size)
                totals[name] = int(sums[-1])
                columns.append(pa.array(sums, pa.int64()))
            last = k[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *sums_of])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema], *[f"`{k}` long" for k in weights]])
    rows = materialize(dealt.mapInArrow(run, ddl), "ranges")
    whole = rows.groupBy(key, "_p").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in weights])
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    brought = whole.select(F.col(key).alias("_key"), F.col("_p").alias("_q"), *[F.sum(f"_{k}").over(before).alias(f"+{k}") for k in weights]).where(F.col(f"+{next(iter(weights))}").isNotNull())
    joined = rows.drop(*[f"_{k}" for k in weights]).join(F.broadcast(brought), (F.col(key) == F.col("_key")) & (F.col("_p") == F.col("_q")), "left")
    return joined.select(*df.columns, *[(F.col(k) + F.coalesce(F.col(f"`+{k}`"), F.lit(0))).alias(k) for k in weights])
