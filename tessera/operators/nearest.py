"""Exact nearest neighbours from a table of pivots.

Each vector is stored under its nearest pivot, in order of its distance to it, and cut into
rings of like distance. For a question at distance q of a pivot, no vector of a ring from
``low`` to ``high`` is nearer than q - high or low - q; and a vector whose nearest pivot
is p is no nearer than half of what p is further away than the question's own nearest
pivot. Rings are read in order of that bound until no other can hold one of the k nearest,
so the answer is that of a full scan. Pivots are a stated number of vectors; the rings'
bounds are RINGS rows for each pivot at most and are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_distance

PIVOTS, RINGS = 64, 32


@dataclass(frozen=True)
class Report:
    """Rings and vectors that a question has read, and all of them."""

    rings: int
    of_rings: int
    rows: int
    of_rows: int


def assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` (id, embedding) with ``pivot`` and ``away``, its distance; vectors of another size have pivot -1."""
    names = [*vectors.columns, "pivot", "away"]
    at, size = vectors.columns.index("embedding"), pivots.shape[1]
    squares = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            fit = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == size)
            pivot, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            if len(fit):
                nearest = (squares - 2 * x @ pivots.T).argmin(axis=1)
                pivot[fit], away[fit] = nearest, np.sqrt(((x - pivots[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], names)

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema], "pivot int", "away double"])
    return vectors.mapInArrow(run, ddl)


def build(vectors: DataFrame, folder: str, pivots: int = PIVOTS) -> Pivots:
    """Store ``vectors`` (id, embedding) in ``folder``; vectors of the commonest size are ordered, others are read each time."""
    spark = vectors.sparkSession
    some = vectors.where("embedding is not null").select("id", "embedding")
    # one row; then so many vectors as there are pivots
    common = some.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return Pivots(spark, folder, np.zeros((0, 0)), [])
    chosen = some.where(F.size("embedding") == common.n).orderBy(F.xxhash64("embedding"), "id").limit(pivots).collect()
    points = np.unique(np.array([r.embedding for r in chosen], np.float64), axis=0)
    dealt = assigned(some, points).repartitionByRange("pivot", "away").sortWithinPartitions("pivot", "away")
    dealt.write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/vectors")
    stored = spark.read.parquet(f"{folder}/vectors")
    widest = stored.groupBy("pivot").agg(F.max("away").alias("widest"))
    ring = F.coalesce(F.least(F.floor(F.col("away") / F.nullif("widest", F.lit(0.0)) * RINGS), F.lit(RINGS - 1)), F.lit(0))
    rings = stored.join(F.broadcast(widest), "pivot").groupBy("pivot", ring.alias("ring")).agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"))
    return Pivots(spark, folder, points, [(r.pivot, r.low, r.high, r.n) for r in rings.collect()])


class Pivots:
    """A stored table and the bounds of its rings."""

    def __init__(self, spark: SparkSession, folder: str, points: np.ndarray, rings: list[tuple[int, float, float, int]]):
        self.spark, self.folder, self.points, self.rings = spark, folder, points, rings

    def bounds(self, query: list[float]) -> list[tuple[float, int, float, float, int]]:
        """(bound, pivot, low, high, n) of every ring, nearest first."""
        q = np.asarray(query, np.float64)
        if self.points.shape[1] != len(q):
            return [(0.0, *r) for r in self.rings if r[0] < 0]
        to = np.sqrt(((self.points - q) ** 2).sum(axis=1))
        nearest = to.min()
        bound = lambda p, low, high: float(max(to[p] - high, low - to[p], (to[p] - nearest) / 2, 0.0))
        return sorted((bound(p, low, high), p, low, high, n) for p, low, high, n in self.rings if p >= 0)

    def knn(self, query: list[float], k: int) -> tuple[DataFrame, Report]:
        """(id, distance) of the nearest ``k``, ties by id, and what was read for them."""
        rings = self.bounds(query)
        if not rings:
            return self.spark.createDataFrame([], "id long, distance double"), Report(0, len(self.rings), 0, sum(r[3] for r in self.rings))
        stored = self.spark.read.parquet(f"{self.folder}/vectors")

        def scanned(some: list) -> DataFrame:
            wanted = F.lit(False)
            for p in {r[1] for r in some}:
                lows, highs = [r[2] for r in some if r[1] == p], [r[3] for r in some if r[1] == p]
                inside = F.lit(False)
                for a, b in zip(lows, highs, strict=True):
                    inside = inside | F.col("away").between(a, b)
                # the widest span is what row groups are passed over by
                wanted = wanted | ((F.col("pivot") == p) & F.col("away").between(min(lows), max(highs)) & inside)
            rows = stored.where(wanted).where(F.size("embedding") == len(query))
            return rows.select("id", l2_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", "id").limit(k)

        taken, wanted = 0, k
        while True:
            while taken < len(rings) and sum(r[4] for r in rings[:taken]) < wanted:
                taken += 1
            # two numbers: of k rows at most
            n, last = scanned(rings[:taken]).agg(F.count("*"), F.max("distance")).first()
            if n >= k or taken == len(rings):
                break
            wanted *= 4
        # bounds and distances are rounded apart
        slack = 1e-6 * (1.0 + (last or 0.0))
        while taken < len(rings) and rings[taken][0] <= last + slack:
            taken += 1
        report = Report(taken, len(self.rings), sum(r[4] for r in rings[:taken]), sum(r[3] for r in self.rings))
        return scanned(rings[:taken]), report
