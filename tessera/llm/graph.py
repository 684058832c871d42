"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, release


#: Edges up to which a round is one job: all of them, even of one node, are a small task then.
MOST_INLINE = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour and
    then its smaller ones, until no edge changes; the number of rounds grows with the
    logarithm of the nodes. Groups are only aggregated with
    min(), so a node with very many edges is pre-aggregated before the shuffle.
    Self loops and repeated edges are allowed; no edge gives no row.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, many = None, now.count()
    while True:
        made: list[DataFrame] = []

        def written(df: DataFrame, name: str) -> DataFrame:
            # so that each join reads two exchanges, and a node with very many edges can be split
            if many <= MOST_INLINE:  # noqa: B023
                return df
            made.append(materialize(df, name))  # noqa: B023
            return made[-1]  # noqa: B023

        both = now.union(now.select(F.col("b"), F.col("a")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, now = now, materialize(small, "edges")
        release(before, *made)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, many = tuple(state), state[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
