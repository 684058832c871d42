"""Finite machines over ordered lines, by composing the maps that lines are.

A line maps every state to the next one. Lines are dealt by range over (doc_id, line_no),
so one log of any size lies in many tasks. Each task passes over its lines once, for all
start states together, and holds one map; the maps of whole stretches are composed for
the documents that lie in several tasks, a map for each task, which gives every stretch
its start state. What state a line is met in follows from its map and that state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States are bytes of a map.
MOST_STATES = 250


def after(state: Column, passed: Column) -> Column:
    """The state that a map of bytes gives for a state."""
    return F.conv(F.hex(F.substring(passed, state + 1, 1)), 16, 10).cast("int")


def mapped(lines: DataFrame, moves: list[tuple[Column, int]]) -> DataFrame:
    """``lines`` dealt by range with ``task``, and maps ``before`` and ``passed`` of the task's lines of the document before each line and with it.

    ``moves``: of each state by number, the condition to leave it and the state that follows.
    """
    leaves = F.concat(*[F.when(F.coalesce(hit, F.lit(False)), "1").otherwise("0") for hit, _ in moves])
    rows = lines.withColumn("code", leaves).repartitionByRange("doc_id", "line_no").sortWithinPartitions("doc_id", "line_no").withColumn("task", F.spark_partition_id())
    names, targets = rows.columns, np.array([t for _, t in moves], np.uint8)
    key, code = names.index("doc_id"), names.index("code")
    still = np.arange(len(moves), dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, now, known = None, still, {}
        for batch in batches:
            docs, codes = (batch.column(i).dictionary_encode() for i in (key, code))
            here, met = (x.indices.to_numpy(zero_copy_only=False) for x in (docs, codes))
            names_of, code_of = docs.dictionary.to_pylist(), codes.dictionary.to_pylist()
            for c in code_of:
                if c not in known:
                    known[c] = np.where(np.frombuffer(c.encode(), np.uint8) == ord("1"), targets, still)
            moving = np.array(["1" in c for c in code_of], bool)[met]
            begins = np.append(True, here[1:] != here[:-1])[: len(here)]
            before, passed = [], []
            at, same = 0, now.tobytes()  # lines between those that move or begin share their maps
            for i, begin, d, c in zip(*[x[moving | begins].tolist() for x in (np.arange(len(here)), begins, here, met)], strict=True):
                before += [same] * (i - at)
                passed += [same] * (i - at)
                if begin and names_of[d] != doc:
                    doc, now = names_of[d], still
                before.append(now.tobytes())
                now = known[code_of[c]][now]
                same = now.tobytes()
                passed.append(same)
                at = i + 1
            before += [same] * (len(here) - at)
            passed += [same] * (len(here) - at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.binary()), pa.array(passed, pa.binary())], [*names, "before", "passed"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "before binary", "passed binary"])
    return rows.mapInArrow(run, ddl)


def started(rows: DataFrame, first: int) -> DataFrame:
    """(doc_id, task, start) of the stretches whose document began in an earlier task: a row for each task at most."""
    stretches = rows.groupBy("doc_id", "task").agg(F.max_by("passed", "line_no").alias("passed"))
    # documents in several tasks; each of their stretches is one entry
    spread = stretches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("task", "passed"))).alias("by")).where(F.size("by") > 1)
    step = lambda acc, x: F.struct(after(acc["state"], x["passed"]).alias("state"), F.concat(acc["starts"], F.array(F.struct(x["task"].alias("task"), acc["state"].alias("start")))).alias("starts"))
    none = F.array().cast("array<struct<task:int,start:int>>")
    starts = F.aggregate("by", F.struct(F.lit(first).alias("state"), none.alias("starts")), step, lambda acc: acc["starts"])
    return spread.select("doc_id", F.explode(starts).alias("s")).select("doc_id", "s.task", "s.start")


def states(lines: DataFrame, moves: list[tuple[Column, int]], first: int, cut) -> DataFrame:
    """``lines`` with ``state``, the number of the state in which each line is met; ``cut`` writes a table out."""
    if len(moves) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    rows = cut(mapped(lines, moves))
    brought = started(rows, first).toDF("_doc", "_task", "_start")
    joined = rows.join(F.broadcast(brought), (F.col("doc_id") == F.col("_doc")) & (F.col("task") == F.col("_task")), "left")
    return joined.withColumn("state", after(F.coalesce("_start", F.lit(first)), F.col("before"))).select(*lines.columns, "state")
