"""Sources, sinks, streams and column functions."""

import datetime
import json

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.functions import vectors as V
from tessera.operators import telemetry
from tessera.sources import events, files, sinks
from tessera.streaming import jobs, stateful


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("v")).first().v


def test_scan(spark, tmp_path):
    for name, text in {"a/x.go": "package a\n", "a/x.txt": "no", "vendor/v.go": "no", "b/skip.py": "no", "b/keep.py": "yes", "big.go": "x" * 70_000, "go.mod": "module m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n", "package.json": json.dumps({"dependencies": {"x": "^1"}, "devDependencies": {"y": "2", "x": "3"}})}.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = f"file:{tmp_path}/t"
    found = files.scan(spark, root, ["# note", "b/*.py", "!b/keep.py"])
    assert {r.path for r in found.collect()} == {"a/x.go", "b/keep.py"}
    every = files.scan(spark, root, manifests=True)
    assert {(r.name, r.version, r.direct) for r in files.gomod(every).collect()} == {("github.com/a/b", "v1.2.3", True), ("github.com/c/d", "v0.1.0", False)}
    assert {(r.name, r.version, r.direct) for r in files.npm(every).collect()} == {("x", "^1", True), ("y", "2", True)}
    again = jobs.incremental(found.select("path", "hash", F.when(F.col("path") == "a/x.go", F.col("mtime")).otherwise(0).alias("mtime")), files.scan(spark, root))
    assert {r.path: r.action for r in again.collect()} == {"a/x.go": "skip", "b/keep.py": "touch", "b/skip.py": "parse"}


def test_slices_of_files(spark):
    df = spark.createDataFrame([("a", "l1\nl2\nl3\nl4é\n", "h" * 64)], "path string, content string, hash string")
    assert files.extract_lines(df, "a", 2, 3).first().text == "l2\nl3"
    assert files.fragment(df, "a", 3, 5).first().fragment == "l2" and files.fragment(df, "a", 0, 99).first().fragment is None and files.fragment(df, "a", 11, 12).first().fragment is None
    places = spark.createDataFrame([("a", 2)], "path string, at int")
    assert files.context_window(df, places, 1).first().text == "  l1\n> l2\n  l3"
    s = spark.createDataFrame([("f", "a", 3, 5)], "name string, path string, start_byte long, end_byte long")
    h = spark.createDataFrame([("a", "xyz", "ab" * 32)], "path string, content string, hash string")
    assert tuple(files.resolve_pointer(df, s, '{"path": "a", "start": 1, "end": 2}').first()) == ("a", 1, 2)
    assert tuple(files.resolve_pointer(h, s, "ab" * 32).first()) == ("a", 0, 3) and tuple(files.resolve_pointer(df, s, "f").first()) == ("a", 3, 5)


def test_jsonl(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"symbol_name": "f", "hit_count": 0, "extra": 1}\nbad\n{"symbol_path": "x"}\n{"symbol_name": "g", "symbol_path": "p", "hit_count": 4, "last_used": 9}\n')
    assert {tuple(r) for r in events.usage(spark, str(tmp_path / "u.jsonl")).collect()} == {("f", "", 1, None), ("g", "p", 4, 9)}
    rows = spark.createDataFrame([(1, '{"Action":"run","Package":"p","Test":"T"}'), (2, '{"Action":"pass","Package":"p","Test":"T","Elapsed":0.5}'), (3, "junk")], "seq int, value string")
    assert [(r.seq, r.action, r.elapsed) for r in events.test_events_of(rows).collect()] == [(1, "run", None), (2, "pass", 0.5)]


def test_sinks(spark, tmp_path):
    symbols = spark.createDataFrame([("a/b", "f", "function", 1, 2)], "path string, name string, type string, start_line int, end_line int")
    calls = spark.createDataFrame([("a/b", "f", "g", 1, "call")], "path string, caller string, callee string, line int, link_type string")
    sinks.export_delta(symbols, calls, f"{tmp_path}/delta")
    back = events.deltas(spark, f"{tmp_path}/delta").first()
    assert back.path == "a/b" and back.symbols[0].name == "f" and back.calls[0].callee == "g"
    commands = spark.createDataFrame([(datetime.datetime(2024, 1, 2), "run --token=abc", 100, 25, 3)], "timestamp timestamp, original_cmd string, input_tokens long, output_tokens long, exec_time_ms long")
    done = telemetry.prepare(commands)
    row = done.first()
    assert (row.original_cmd, row.saved_tokens, row.savings_pct) == ("run --token=[REDACTED]", 75, 75.0)
    assert sinks.insert(done.limit(0), commands).count() == 1
    sinks.export_csv(telemetry.daily(done), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().savings_pct == "75.0"
    data = json.loads(sinks.gain_json(telemetry.summary(done), telemetry.daily(done), telemetry.by_command(done)).first().json)
    assert data["summary"]["total_saved"] == 75 and data["daily"][0]["day"] == "2024-01-02" and data["by_command"][0]["count"] == 1
    assert sinks.tee("x" * 300, f"{tmp_path}/tee", False) is None and sinks.tee("x", f"{tmp_path}/tee", True) is None
    for i in range(4):
        sinks.tee(f"{i}" * 300, f"{tmp_path}/tee", True, keep=2)
    assert len(list((tmp_path / "tee").iterdir())) == 2


def test_usage_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    resolve = lambda df: df.select(F.length("symbol_name").cast("long").alias("symbol_id"), F.lit("prod").alias("environment"), "hit_count", "last_used")
    for i, hits in enumerate((5, 3)):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"symbol_name": "f", "hit_count": hits, "last_used": 1000 * (i + 1)}) + "\nbad\n")
        q = jobs.ingest_usage(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/checkpoint", resolve)
        q.awaitTermination()
    assert [tuple(r) for r in jobs.usage_table(spark, f"{tmp_path}/table").collect()] == [(1, "prod", 8, 2000)]
    assert [tuple(r) for r in jobs.usage_table(spark, f"{tmp_path}/table", 0).collect()] == [(1, "prod", 5, 1000)]
    q = jobs.usage_counts(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("usage_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("usage_counts").first().hit_count == 8


def test_usage_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "MERGE_EVERY", 2)
    (tmp_path / "in").mkdir()
    resolve = lambda df: df.select(F.lit(1).cast("long").alias("symbol_id"), F.lit("prod").alias("environment"), "hit_count", "last_used")
    for i in range(4):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"symbol_name": "f", "hit_count": 10**i, "last_used": i + 1}) + "\n")
        jobs.ingest_usage(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/checkpoint", resolve).awaitTermination()
    assert (tmp_path / "table" / "base=2").is_dir() and jobs.usage_table(spark, f"{tmp_path}/table").first().hit_count == 1111


def test_notes_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (text, at) in enumerate([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"content": text, "created_at": at}))
    rows = spark.readStream.schema("content string, created_at timestamp").json(f"{tmp_path}/in")
    q = jobs.fresh_notes(rows).writeStream.format("memory").queryName("notes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.content for r in spark.table("notes").collect()) == ["a", "b"]


def test_window_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = jobs.windowed_usage(stream, "ts", ["event_type"], "value").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.event_type, str(r.d)): r.n for r in rows.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert {(r.event_type, str(r.start.date())): r.n for r in spark.table("windows").collect()} == want


def test_event_stream(spark, tmp_path):
    """Output is held over batches and starts of the stream; what never ends is forgotten."""
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    lines = [
        (1, at(0), "p", "TestA_x", "run", "", None), (2, at(0), "p", "TestA_x", "output", "--- FAIL: x\na.go:1: one ", None), (3, at(1), "p", "TestB", "output", "never heard of again", None),
        (4, at(2), "p", "TestA_x", "output", "two\n", None), (5, at(3), "p", "TestA_x", "fail", "", 0.5), (6, at(3), "p", None, "output", "nobody's", None),
        (7, at(600), "p", "TestC", "pass", "", None), (8, at(601), "p", "TestB", "pass", "", 0.25), (9, at(602), "p", "TestA_x", "skip", "", 0.0),
    ]
    rows = spark.createDataFrame(lines, "seq long, time timestamp, package string, test string, action string, output string, elapsed double")
    stateful.stored_state(spark)
    got = jobs.run_in_batches(rows, "seq", 3, f"{tmp_path}/s", stateful.test_results).collect()
    assert sorted((r.seq, r.test, r.status, r.error_message, r.duration_ms, r.target_symbol) for r in got) == [
        (5, "TestA_x", "fail", "a.go:1: one two", 500, "A"), (7, "TestC", "pass", "", 0, "C"), (8, "TestB", "pass", "", 250, "B"), (9, "TestA_x", "skip", "", 0, "A"),
    ]


def test_ring_after_every_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, f"t{i}" if i % 5 else None) for i in range(24)], "k long, at long, text string")
    stateful.stored_state(spark)
    rings = jobs.run_in_batches(rows, "at", 3, f"{tmp_path}/s", lambda r: stateful.ring(r, ["k"], "at", 2))
    cuts = sorted(r.m for r in spark.read.parquet(f"{tmp_path}/s/all").groupBy("_batch").agg(F.max("at").alias("m")).collect())
    for n, last in enumerate(cuts, 1):
        want = sorted((i % 3, i, f"t{i}" if i % 5 else None) for i in range(24) if i <= last and i + 6 > max(j for j in range(24) if j <= last and j % 3 == i % 3))
        assert sorted((r.k, r.at, r.text) for r in rings.where(F.col("round") == n).collect()) == want
    assert {r.at for r in stateful.last_round(rings, ["k"]).collect()} == set(range(18, 24))


def test_line_and_note_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\x1b[1mkeep\x1b[0m\n\nDEBUG x\n")
    q = jobs.line_filter(spark.readStream.text(f"{tmp_path}/in").withColumnRenamed("value", "line"), "aggressive").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.line for r in spark.table("kept").collect()] == ["keep"]
    with pytest.raises(ValueError):
        jobs.line_pipeline(spark.range(1), [{"action": "head", "n": 3}])
    cut = jobs.line_pipeline(spark.createDataFrame([("src/abcdefgh",)], "line string"), [{"action": "compact_path"}, {"action": "truncate_lines", "max": 6}])
    assert cut.first().line == "abc..."
    seen = []
    q = jobs.index_changes(spark, f"{tmp_path}/in", "path string", lambda df: seen.append(df.count()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sum(seen) == 2


def test_string_functions(spark):
    t = F.col("t")
    assert value(spark, S.count_lines(t), t="a\nb") == 2 and value(spark, S.count_lines(t), t="a\n") == 1 and value(spark, S.count_lines(t), t="") == 0
    assert value(spark, S.estimate_tokens(t), t="éé1") == 2
    assert [value(spark, S.format_tokens(F.lit(n))) for n in (5, 59_200, 1_200_000)] == ["5", "59.2K", "1.2M"]
    assert value(spark, S.truncate(t, 5), t="abcdefgh") == "ab..." and value(spark, S.truncate(t, 2), t="abc") == "ab"
    assert value(spark, S.clean_comment(t), t="/** One\n * two\n\n */") == "One\ntwo" and value(spark, S.clean_comment(t), t="// a\n# b") == "a\nb"
    assert value(spark, S.redact_secrets(t), t="x --password hunter2 API_KEY=abc http://u:pw@h/p") == "x --password [REDACTED] API_KEY=[REDACTED] http://u:[REDACTED]@h/p"
    assert value(spark, S.extract_json(t), t="so {\"a\": [1]} end") == '{"a": [1]}' and value(spark, S.extract_json(t), t="none") == "none"
    assert value(spark, S.extract_code_block(t), t="x\n```go\ncode\n```\n") == "code" and value(spark, S.extract_code_block(t), t=" raw ") == "raw"
    assert value(spark, S.parse_rating(t), t="about 8.5 / 10") == 8.5 and value(spark, S.parse_rating(t), t="no") is None
    assert value(spark, S.extract_list(t, "risks"), t="Intro\nRisks:\n\n- one\n* two\nend\n- three") == ["one", "two"] and value(spark, S.extract_list(t, "risks"), t="x") == []
    assert [value(spark, S.era(F.lit(m))) for m in ("fix it", "perf: x", "add y", "docs")] == ["Fix", "Refactor", "Feature", "Chore"]
    assert tuple(value(spark, S.go_failure(t), t="   a b/c-d.go:12: x e.go:3: y")) == ("a b/c-d.go", 12) and value(spark, S.go_failure(t), t="c.go:1: x") is None
    assert [value(spark, S.map_test_to_symbol(F.lit(x))) for x in ("TestStore_Get_x", "TestSum_neg", "TestSum")] == ["Store.Get", "Sum", "Sum"]
    assert value(spark, S.fqn(F.lit("p"), F.lit("n"))) == "p.n" and value(spark, S.fqn(F.lit(""), F.lit("n"))) == "n" and value(spark, S.local_name(t), t="a.b.c") == "c"
    assert value(spark, S.module_path(t), t="a/b/__init__.py") == "a.b" and value(spark, S.dirname(t), t="x") == "."


def test_weeks_match_the_calendar(spark):
    days = [datetime.date(2023, 1, 1) + datetime.timedelta(days=i) for i in range(900)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", S.week_of_year(F.col("d")).alias("w")).collect()
    assert all(r.w == r.d.strftime("%Y-W%W") for r in rows)


def test_embedder(spark):
    v = value(spark, V.hash_embedder(8)(F.col("t")), t="one two one")
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-6
    assert value(spark, V.l2_distance(F.array(F.lit(0.0), F.lit(3.0)), [4.0, 0.0])) == 5.0


def test_a_session_costs_few_requests():
    """A key's batch reads the store once and writes what changed: each request is a round trip to the JVM."""
    asked, stored, timers = [], [], set()

    class Value:
        def get(self):
            asked.append("get")
            return stored[-1] if stored else None

        def update(self, value):
            asked.append("update")
            stored.append(value)

        def clear(self):
            asked.append("clear")
            stored.clear()

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

        def registerTimer(self, at):  # noqa: N802
            asked.append("register")
            timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            asked.append("delete")
            timers.remove(at)

    sessions = stateful.Sessions(1000)
    sessions.init(Handle())

    def batch(*rows):
        asked.clear()
        frame = pd.DataFrame([(s, a, o, 0.5, pd.Timestamp(s, unit="s")) for s, a, o in rows], columns=["seq", "action", "output", "elapsed", "time"])
        return [tuple(r) for out in sessions.handleInputRows(("p", "t"), iter([frame]), None) for r in out.itertuples(index=False)]

    assert batch((2, "output", "b"), (1, "run", "")) == [] and asked == ["get", "update", "register"] and timers == {3000}
    assert batch((3, "output", "c")) == [] and asked == ["get", "delete", "update", "register"] and timers == {4000}
    assert batch((4, "pass", ""), (5, "skip", "")) == [("p", "t", 4, "pass", 0.5, "bc"), ("p", "t", 5, "skip", 0.5, "")]
    assert asked == ["get", "delete", "clear"] and not timers and not stored
    assert batch((6, "fail", "")) == [("p", "t", 6, "fail", 0.5, "")] and asked == ["get"]
