"""Sharding by a k-d tree over metadata, with DataFrame operations only.

A point is a distinct text with the bytes of all its copies as weight; its
coordinates are the least values of its copies. Each level splits every node at
the weighted median of the dimension that is widest there, relative to its width
over all points, until the leaves reach the target bytes. Medians are exact: they
come from range-dealt running sums, so no task holds a node. Copies stay together
unless their group is heavy in its node; then the group itself is cut at the
median, by doc_id.

Source and language count by the place of their value among all values, whole.

Defined cases: a null text has size 1 and CRC 0, as an empty one; null metadata
counts as empty and sorts first; equal coordinates are ordered by the text's digest;
rows alike in doc_id and text are interchangeable; a long text is one point; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, release, running_sum

DIMENSIONS = ["d_size", "d_source", "d_lang", "d_id"]
#: A group of equal texts is cut at the median if it has more than this part of its node's bytes.
HEAVY = 0.005


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by the place of its value among all its values, from 0, in byte order."""
    values = materialize(rows.select(column).distinct(), "values")
    ranks = materialize(running_sum(values, [], [column], F.lit(1), "rank").select(F.col(column).alias("value"), "rank"), "ranks")
    return rows.join(ranks, F.col(column) == F.col("value")).withColumn(column, F.col("rank").cast("double")).drop("value", "rank")


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, g, d_source, d_lang); g names the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    label = lambda c: F.coalesce((F.col(c) if c in docs.columns else F.lit(None)).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("g"),
        label("source").alias("d_source"),
        label("lang").alias("d_lang"),
    )
    return ranked(ranked(materialize(rows, "rows"), "d_source"), "d_lang")


def leaves(rows: DataFrame, target_bytes: int, levels: int | None = None) -> DataFrame:
    """Parts (g, low, high, path) of the groups of equal texts after all splits.

    Bytes low .. high of a group, its copies in order of doc_id, belong to leaf
    ``path``. Every node heavier than ``target_bytes`` that has more than one row is
    split, ``levels`` times at most if stated. Facts of nodes are a table that is joined.
    """
    parts = rows.groupBy("g").agg(
        F.sum("size").alias("high"),
        F.max("size").cast("double").alias("d_size"),
        F.min("d_source").alias("d_source"),
        F.min("d_lang").alias("d_lang"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d_id"),
        F.max("size").alias("unit"),
    )
    parts = materialize(parts.withColumn("low", F.lit(0).cast("long")).withColumn("path", F.lit(1).cast("long")), "parts")
    # one row: the widths over all points
    widths = parts.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    root = {d: widths[d] or 1.0 for d in DIMENSIONS}
    kept = ["g", "unit", *DIMENSIONS]
    depth = 0
    while levels is None or depth < levels:
        weight = F.col("high") - F.col("low")
        wide = F.array(*[F.struct(((F.max(d) - F.min(d)) / root[d]).alias("width"), F.lit(-i).alias("order")) for i, d in enumerate(DIMENSIONS)])
        stats = parts.groupBy("path").agg(F.sum(weight).alias("whole"), F.max(weight - F.col("unit")).alias("spare"), F.count("*").alias("n"), (-F.array_max(wide)["order"]).alias("dimension"))
        nodes = materialize(stats.where((F.col("whole") > target_bytes) & ((F.col("n") > 1) | (F.col("spare") > 0))).select("path", "whole", "dimension"), "nodes")
        if nodes.isEmpty():
            break
        live = parts.join(nodes, "path").withColumn("key", F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1))
        summed = running_sum(live, ["path"], ["key", "g", "low"], weight, "before")
        over = F.floor(F.col("whole") / 2) - F.col("before")  # bytes of this part that lie before the median
        cut = (over > 0) & (over < weight) & (weight > HEAVY * F.col("whole"))
        left = F.col("path") * 2
        sides = F.when(
            cut,
            F.array(F.struct(F.col("low").alias("low"), (F.col("low") + over).alias("high"), left.alias("path")), F.struct((F.col("low") + over).alias("low"), F.col("high").alias("high"), (left + 1).alias("path"))),
        ).otherwise(F.array(F.struct(F.col("low").alias("low"), F.col("high").alias("high"), F.when(2 * over >= weight, left).otherwise(left + 1).alias("path"))))
        split = summed.select(*kept, F.explode(sides).alias("s")).select(*kept, "s.low", "s.high", "s.path")
        rest = parts.join(nodes, "path", "left_anti")
        before, parts = parts, materialize(split.unionByName(rest.select(*kept, "low", "high", "path")), "parts")
        release(before)
        depth += 1
    return parts.select("g", "low", "high", "path")


def assign(docs: DataFrame, target_bytes: int | None = None, count: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, path) for every row of ``docs``.

    The leaves have ``target_bytes`` at most, but for single rows; or, with ``count``, a
    power of two, they are so many at most and the target is their even share.
    """
    rows = materialize(points(docs), "points")
    levels = None
    if count is not None:
        levels = int(math.log2(count))
        target_bytes = -(-(rows.agg(F.sum("size")).first()[0] or 0) // count)  # one number
    parts = leaves(rows, target_bytes, levels)
    # written out, so that the join reads two exchanges and a hot text can be split
    pieces = materialize(parts.groupBy("g").agg(F.count("*").alias("n"), F.min("path").alias("path")), "pieces")
    whole = rows.join(pieces.where("n = 1").select("g", "path"), "g").select("doc_id", "size", "text_crc32", "path")
    # groups that a median has cut: one for each inner node at most
    cut = pieces.where("n > 1").select("g")
    inside = running_sum(rows.join(cut, "g", "left_semi").select("g", "doc_id", "size", "text_crc32"), ["g"], ["doc_id", "size", "text_crc32"], F.col("size"), "at")
    middle = F.col("at") + F.floor(F.col("size") / 2)
    found = inside.join(parts.join(cut, "g", "left_semi").select(F.col("g").alias("h"), "low", "high", "path"), (F.col("g") == F.col("h")) & (middle >= F.col("low")) & (middle < F.col("high")))
    return whole.unionByName(found.select("doc_id", "size", "text_crc32", "path"))


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): ``count`` shards, a power of two, of near-equal bytes."""
    if 2 ** int(math.log2(count)) != count:
        raise ValueError("the number of shards must be a power of two")
    placed = assign(docs, count=count)
    # a leaf above the last level is the first of the shards that lie below it
    deep = placed.withColumn("path", F.col("path") * F.pow(F.lit(2), math.log2(count) - F.floor(F.log2("path"))).cast("long"))
    shard = deep.select("doc_id", "size", "text_crc32", (F.col("path") - count).cast("int").alias("shard"))
    slots = running_sum(shard, ["shard"], ["doc_id", "text_crc32", "size"], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
