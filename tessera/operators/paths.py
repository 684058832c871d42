"""Which nodes simple paths of each length reach, without listing the paths.

A path of d nodes matters only by the nodes that its continuation must avoid, and that
is ``left`` nodes at most. Of all paths to a node so many are kept that, whichever ``left``
nodes a continuation has, one of them avoids it if any path did: a representative family.
A path is added to the family of its node if some choice of ``left`` nodes meets all paths of the family
and not it. A sequence of such sets has at most C(d - 1 + left, left) members, so this
is the state of a node: 2 paths at the second of three steps, 126 at most for ten. Families of
parts of a node's paths have the same property together, so a node with very many callers is
reduced in SALTS parts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def met(family: list[frozenset], left: int, new: frozenset) -> bool:
    """Whether ``left`` nodes outside ``new`` can meet every set of ``family``."""
    if not family:
        return True
    if not left:
        return False
    first = min(family, key=lambda s: len(s - new))
    return any(met([s for s in family if x not in s], left - 1, new) for x in first - new)


def extended(family: list[frozenset], left: int, new: frozenset) -> None:
    """Add ``new`` to ``family`` unless the family does what it does."""
    if met(family, left, new):
        family.append(new)


def reduced(rows: DataFrame, key: list[str], left: int) -> DataFrame:
    """(key, before) of rows with ``before``, the earlier nodes of a path: a representative family of each key."""
    names = [*key, "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, family, done = None, [], []

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in done], t) for i, t in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        types = None
        for batch in batches:
            types = [batch.column(i).type for i in range(len(names))]
            for *node, before in zip(*[c.to_pylist() for c in batch.columns[: len(names)]], strict=True):
                if node != last:
                    done += [(*last, sorted(s)) for s in family] if last is not None else []
                    last, family = node, []
                extended(family, left, frozenset(before))
            yield out()
        if last is not None:
            done += [(*last, sorted(s)) for s in family]
            yield out()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema)
    salt = F.pmod(F.xxhash64("before"), F.lit(SALTS)).alias("salt")
    parts = rows.select(*names, salt).repartition(*key, "salt").sortWithinPartitions(*key, "salt").mapInArrow(run, ddl)
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ddl)


def family(rows: DataFrame, key: list[str], length: int, left: int) -> DataFrame:
    """The same for paths of ``length`` nodes, the key's own last and not in ``before``."""
    if length == 1:
        return rows.select(*key, "before").distinct()
    if (length, left) == (2, 1):
        # any two different callers avoid every one node
        ends = rows.groupBy(*key).agg(F.min("before").alias("a"), F.max("before").alias("b"))
        return ends.select(*key, F.explode(F.array_distinct(F.array("a", "b"))).alias("before"))
    return reduced(rows, key, left)
