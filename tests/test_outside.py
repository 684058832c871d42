"""Commands, settings, rewrites, staged edits and propagation on small inputs."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import jsonc
from tessera.operators import graph, ledger
from tessera.operators.tokens import rewritten
from tessera.sources import commands, files


def test_capture(spark):
    out, err, code = commands.capture(spark, ["sh", "-c", "printf 'a\\n\\nb'; exit 4"])
    assert [r.line for r in out.orderBy("line_no").collect()] == ["a", "", "b"] and err.count() == 0 and code == 4
    with pytest.raises(ValueError):
        commands.capture(spark, ["sh"], allowed={"git"})
    assert commands.capture(spark, ["sleep", "5"], 0.2)[2] == -9


def test_comments_and_commas():
    text = '{ // one\n "a//b": "/* no */", /* two */ "c": [1, 2,], "d": ",]",\n}'
    assert jsonc.parse(text) == {"a//b": "/* no */", "c": [1, 2], "d": ",]"}
    assert jsonc.merge({"a": {"b": 1, "c": 2}, "x": 1}, {"a": {"b": {"__replace__": {"z": 1}}}, "n": {"m": {"__replace__": 3}}, "x": {"y": 2}}) == {"a": {"b": {"z": 1}, "c": 2}, "n": {"m": 3}, "x": {"y": 2}}
    assert json.loads(jsonc.merge_texts("garbage", '{"a": 1}')) == {"a": 1}
    with pytest.raises(ValueError):
        jsonc.merge_texts("{}", "[1]")


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8))
def test_plain_json_is_left_alone(value):
    assert jsonc.parse(json.dumps(value)) == value


def test_rewrite():
    new, done = rewritten("a = f(f(1), 2)\nf(3)  # f(4)\n", "py", "f($X)", "g[$X]")
    assert new == "a = f(g[1], 2)\ng[3]  # f(4)\n" and done == [(1, "f(1)", "g[1]"), (2, "f(3)", "g[3]")]


def test_staged_edits(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    edits = spark.createDataFrame([("a", "one", 1), ("c", "new", 2)], "path string, content string, staged_at long")
    staged = ledger.stage(spark.createDataFrame([], ledger.STAGED), known, edits)
    assert staged.count() == 2 and ledger.unstage(staged, spark.createDataFrame([("c",)], "path string")).count() == 1
    done, journal = ledger.apply(staged, known)
    assert {r.path: r.content for r in done.collect()} == {"a": "one", "b": "2", "c": "new"}
    assert {r.path: r.content for r in ledger.roll_back(done, journal).collect()} == {"a": "1", "b": "2"}
    moved = done.withColumn("content", F.when(F.col("path") == "a", "else").otherwise(F.col("content")))
    assert {r.path: r.content for r in ledger.roll_back(moved, journal).collect()} == {"a": "else", "b": "2"}
    with pytest.raises(ValueError):
        ledger.apply(staged, known.withColumn("content", F.lit("x")))
    assert "+one" in {r.path: r.diff for r in ledger.diffs(staged, known).collect()}["a"]


def test_propagation_takes_a_strategy(spark):
    found = spark.createDataFrame([("x", 1), ("y", 2)], "impacted string, depth int")
    p = graph.Propagation(lambda symbols, edges, start, depth: found.where(F.col("depth") <= depth), lambda t: t.withColumn("action", F.lit("transform")), lambda t: t["impacted"] != "y")
    assert [tuple(r) for r in p.run(None, None, "s").collect()] == [("x", 1, "transform")]


def test_paths_stay_inside(spark):
    rows = [("a/../b",), ("../x",), ("/root/w/a",), ("/root/wide",), ("",), ("a/../../w/c",), (".",)]
    got = [r.p for r in spark.createDataFrame(rows, "path string").select(files.inside(F.col("path"), "/root/w").alias("p")).collect()]
    assert got == ["/root/w/b", None, "/root/w/a", None, None, "/root/w/c", "/root/w"]
