"""Streams with state of their own for each key, kept in the state store and bounded.

Both processors hold what they know in the store, not in a worker: a key's state is read, changed and
written in each batch that has rows of it, and a stream that starts again goes on from its
checkpoint. They need the RocksDB state store (``stored_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import telemetry

FINISHED = ("pass", "fail", "skip")
EVENT = "package string, test string, seq long, status string, elapsed double, output string"


def stored_state(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, on which these processors rest."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """Output of a test from its run to its end; what has not ended when the watermark is ``forget_ms`` past its last event is forgotten.

    A key's output and the time of its timer are one value: each request to the store is a
    round trip, so a batch reads a key once and writes what has changed.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "outputs array<string>, forgotten long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.held.get()
        held, done = list(known[0]) if known else [], []
        # a batch's rows of one key
        here = pd.concat(list(rows))
        order = here["seq"].to_numpy().argsort(kind="stable")
        columns = [here[c].to_numpy()[order] for c in ("seq", "action", "output", "elapsed")]
        for seq, action, output, elapsed in zip(*columns, strict=True):
            if action == "run":
                held = []
            elif action == "output":
                held.append(output or "")
            elif action in FINISHED:
                done.append((*key, int(seq), action, None if pd.isna(elapsed) else float(elapsed), "".join(held)))
                held = []
        if known:
            self.handle.deleteTimer(known[1])
        if held:
            forgotten = int(here["time"].max().timestamp() * 1000) + self.forget_ms
            self.held.update((held, forgotten))
            self.handle.registerTimer(forgotten)
        elif known:
            self.held.clear()
        if done:
            yield pd.DataFrame(done, columns=["package", "test", "seq", "status", "elapsed", "output"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())


def test_results(rows: DataFrame, late: str = "1 hour", forget_ms: int = 3_600_000) -> DataFrame:
    """Finished tests of a stream of events (seq, time, package, test, action, output, elapsed), in append mode, in the columns of the batch form.

    Events of a test come in order of their batches, and none is more than ``late`` behind
    the newest ``time``. Timers are of event time, so a stream under ``availableNow`` ends with its
    input, whatever is held.
    """
    known = rows.where("test is not null and test <> ''").select("seq", "time", "package", "test", "action", "output", "elapsed")
    keyed = known.withWatermark("time", late).groupBy("package", "test")
    return telemetry.described(keyed.transformWithStateInPandas(Sessions(forget_ms), EVENT, "append", "eventTime"))


class Ring(StatefulProcessor):
    """The newest rows of a key by one column; older ones leave the state when newer ones come."""

    def __init__(self, size: int, by: str, columns: list[str], ddl: str):
        self.size, self.by, self.columns, self.ddl = size, by, columns, ddl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.ddl)
        self.rounds = handle.getValueState("rounds", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame([tuple(r) for r in self.rows.get()] if self.rows.exists() else [], columns=self.columns)
        for new in rows:  # never more than a batch and the ring at once
            both = pd.concat([kept, new[self.columns]]) if len(kept) else new[self.columns]
            kept = both.sort_values(self.by, ascending=False, kind="stable").head(self.size)
        n = (self.rounds.get()[0] if self.rounds.exists() else 0) + 1
        self.rows.put([tuple(None if pd.isna(x) else x for x in r) for r in kept.astype(object).itertuples(index=False)])
        self.rounds.update((n,))
        yield kept.assign(round=n)


def ring(rows: DataFrame, keys: list[str], by: str, size: int) -> DataFrame:
    """The newest ``size`` rows of each key by ``by``, once more after each batch that has rows of it; ``round`` counts a key's batches.

    The rows of a key's last round are its newest so far. ``by`` is unique within a key.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*keys).transformWithStateInPandas(Ring(size, by, rows.columns, ddl), f"{ddl}, round long", "append", "none")


def last_round(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that ``ring`` has written those that hold now."""
    newest = rings.groupBy(*keys).agg(F.max("round").alias("round"))
    return rings.join(newest, [*keys, "round"]).drop("round")
