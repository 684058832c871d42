"""State machines by composed maps against the sequential machine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import automata, graph
from tessera.operators import lines as L


def sequential(lines, states):
    now, out = "start" if "start" in states else min(states), []
    for line in lines:
        if now not in states:
            break
        c = states[now]
        if c.get("until") and re.search(c["until"], line):
            now = c.get("next") or now
        elif not c.get("keep") or re.search(c["keep"], line):
            out.append(line)
    return out


def run(spark, docs, states, parts):
    rows = [(d, float(i), x) for d, lines in docs.items() for i, x in enumerate(lines)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = L.state_machine(L.Stream(spark.createDataFrame(rows, "doc_id string, line_no double, line string").repartition(3)), states).lines.orderBy("doc_id", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {d: [] for d in docs}
    for r in got:
        found[r.doc_id].append(r.line)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_random_machines(spark, seed):
    rng = random.Random(seed)
    names = ["start", "a", "b", "c"][: rng.randint(1, 4)] if seed else ["z", "y"]
    states = {n: {"until": rng.choice(["x", "y$", "^z", "", "(", "xy"]), "keep": rng.choice(["", "z", "^x", "[xy]"]), "next": rng.choice([*names, "", "gone"])} for n in names}
    states["note"] = "no map"
    line = lambda: "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 5)))
    docs = {f"d{i}": [line() for _ in range(rng.choice([1, 5, 40]))] for i in range(12)} | {"long": [line() for _ in range(3000)]}
    used = {k: {**c, "until": "" if c["until"] == "(" else c["until"]} for k, c in states.items() if isinstance(c, dict)}
    assert run(spark, docs, states, 7) == {d: sequential(v, used) for d, v in docs.items()}


def test_one_log_is_spread_over_tasks(spark):
    """A single document of 100,000 lines lies in many tasks, and no task groups it in Python."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("double").alias("line_no"), F.when(F.col("id") % 1000 == 999, "turn").otherwise(F.concat(F.lit("line "), F.col("id").cast("string"))).alias("line"))
        tasks = automata.mapped(rows, [(F.col("line") == "turn", 1), (F.col("line") == "turn", 0)]).groupBy("task").count().collect()
        assert len(tasks) >= 12 and max(r["count"] for r in tasks) < 20_000
        kept = L.state_machine(L.Stream(rows), {"start": {"until": "^turn", "next": "skip"}, "skip": {"until": "^turn", "next": "start", "keep": "$^x"}}).lines
        assert kept.count() == 50 * 999 and "FlatMapGroups" not in kept._jdf.queryExecution().toString()
        assert kept.agg(F.min("line_no"), F.max("line_no")).first()[:] == (0.0, 98_998.0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_bounds(spark):
    s = L.Stream(spark.createDataFrame([], "doc_id int, line_no double, line string"))
    assert L.state_machine(s, {"start": {}}).lines.count() == 0 and L.state_machine(s, {}).lines.count() == 0
    with pytest.raises(ValueError):
        automata.states(s.lines, [(F.lit(False), 0)] * 300, 0, graph.cut)
