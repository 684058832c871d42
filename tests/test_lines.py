"""Line actions, templates and specs on small streams."""

import pytest

from tessera.functions import templates
from tessera.operators import lines as L
from tessera.sources import specs


def stream(spark, *texts):
    return L.of_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def out(s, doc=0):
    return [r.line for r in s.lines.where(f"doc_id = {doc}").orderBy("line_no").collect()]


def test_keep_remove_and_errors(spark):
    s = stream(spark, "ok one\nbad\nok two\n", None)
    assert out(L.keep_lines(s, "^ok")) == ["ok one", "ok two"] and out(L.remove_lines(s, "^ok")) == ["bad"]
    assert out(s, 1) == [""]
    for bad in ("", "("):
        with pytest.raises(ValueError):
            L.keep_lines(s, bad)
    assert out(L.keep_lines(s, "^(?P<word>ok) [[:alpha:]]+$")) == ["ok one", "ok two"]


def test_truncate_counts_code_points(spark):
    assert out(L.truncate_lines(stream(spark, "äöüäöüäöü\nshort"), 6)) == ["äöü...", "short"]
    assert out(L.truncate_lines(stream(spark, "abcdef"), 2, "..")) == ["a.."]


def test_heads_and_tails(spark):
    s = stream(spark, "\n".join(map(str, range(40))))
    assert out(L.head(s, 2)) == ["0", "1", "+38 more lines"] and out(L.head(s, 2, "more"))[-1] == "more" and len(out(L.head(s, 40))) == 40
    assert out(L.tail(s, 2)) == ["38", "39"]
    assert out(L.head_tail(s, 1, 1)) == ["0", "... [truncated 38 lines of noise] ...", "39"]
    assert len(out(L.head_tail(s, 20, 15))) == 40 and len(out(L.head_tail(s, params={"head": 2, "tail": 2}))) == 5


def test_runs_of_lines(spark):
    assert out(L.snr_dedup(stream(spark, " a\na\n\na \nb\na"))) == ["a [x3]", "b", "a"]


def test_group_by_and_dedup(spark):
    s = stream(spark, "ERR 1\nWARN\nERR 2\nERR 3\nWARN\nINFO")
    assert out(L.group_by(s, "^([A-Z]+)")) == ["ERR: 3", "WARN: 2", "INFO: 1"]
    assert out(L.group_by(s, "^([A-Z]+)", 1, "{{.Count}} of {{.Key}}")) == ["3 of ERR"]
    assert out(L.dedup(s, [" \\d+", "("])) == ["ERR (x3)", "WARN (x2)", "INFO"]
    assert {(r.key, r.n) for r in L.group_by(s, "^([A-Z]+)", 1).groups.collect()} == {("ERR", 3), ("WARN", 2), ("INFO", 1)}


def test_aggregate(spark):
    s = stream(spark, "a1\nb\na2")
    assert out(L.aggregate(s, {"a": "^a", "digit": "\\d", "bad": "("})) == ["a: 2", "digit: 2"]
    assert out(L.aggregate(s, {"a": "^a", "c": "^c"}, "{{if eq .c 0}}only {{.a}}{{else}}both{{end}}")) == ["only 2"]
    with pytest.raises(ValueError):
        L.aggregate(s)


def test_state_machine(spark):
    s = stream(spark, "x\nbegin\nkeep 1\nno\nend\nkeep 2")
    states = {"start": {"until": "^begin", "next": "body", "keep": "$^"}, "body": {"until": "^end", "next": "done", "keep": "^keep"}}
    assert out(L.state_machine(s, states)) == ["keep 1"]
    assert out(L.state_machine(s, {"b": {"keep": "1"}, "c": {}})) == ["keep 1"]
    with pytest.raises(ValueError):
        L.state_machine(s, None)


def test_json_actions(spark):
    s = stream(spark, '{"k": 1, "n": null}\nbad\n{"k": 2.5}\n{"k": 1}\n{"x": 1}')
    assert out(L.ndjson_stream(s, "k")) == ["1: 2 events", "2.5: 1 events", ": 1 events"]
    assert out(L.ndjson_stream(s, "k", "{{.Key}}={{len .Events}}")) == ["1=2", "2.5=1", "=1"]
    one = stream(spark, '{"a": 3, "b": {"c": [1]}, "d": "x",\n "e": 1e21, "f": null, "g": true}')
    assert out(L.json_extract(one, ["a", "d", "e", "f", "g", "no", "b"])) == ["a: 3", "d: x", "e: 1e+21", "f: <nil>", "g: true", "b: map[c:[1]]"]
    assert out(L.json_extract(one, ["a"], "v={{.a}}")) == ["v=3"]
    assert out(L.json_schema(one, 2)) == ["{", "  a: number", "  b: {", "    c: ...", "  }", "  d: string", "  e: number", "  f: null", "  g: bool", "}"]


def test_whole_documents_in_batches(spark):
    """Many small documents share a call of Python, and lines come in their order whatever the rows' is."""
    rows = [(f"d{k}", float(i), x) for k in range(2500) for i, x in enumerate(['{"a":', f"{k}", "}"])]
    s = L.Stream(spark.createDataFrame(rows[::-1], "doc_id string, line_no double, line string"))
    found = L.json_extract(s, ["a"]).lines
    assert {(r.doc_id, r.line_no, r.line) for r in found.collect()} == {(f"d{k}", 0.0, f"a: {k}") for k in range(2500)}
    assert found.count() == 2500 and "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_counts_that_no_tag_shows_are_not_joined(spark):
    s = stream(spark, "a 1\nb\nc 2")
    counted = L.Stream(s.lines, stats=L.aggregate(s, {"digits": "[0-9]"}).stats)
    plan = lambda template: L.format_template(counted, template).lines._jdf.queryExecution().optimizedPlan().toString()
    assert ["LeftOuter" in plan(x) for x in ("{{.lines}}", "{{.lines}}{{.stats.digits}}", "{{.}}")] == [False, True, True]
    assert out(L.format_template(counted, "{{.lines}}\n{{.stats.digits}} of {{.count}}\n")) == ["a 1", "b", "c 2", "2 of 3"]
    assert out(L.format_template(counted, "{{.lines}}")) == ["a 1", "b", "c 2"]


def test_regex_extract(spark):
    s = stream(spark, "k=v\nnone\na=b")
    assert out(L.regex_extract(s, "(\\w)=(\\w)")) == ["k v", "a b"] and out(L.regex_extract(s, "(\\w)=(\\w)", "$2<-$1 ($0)")) == ["v<-k (k=v)", "b<-a (a=b)"]
    assert out(L.regex_extract(s, "\\w=")) == ["k=", "a="]


def test_pure_signal(spark):
    assert out(L.pure_signal(stream(spark, "\x1b[31mred\x1b[0m\n\n....\nProgress: 3\nred\n1/20 files\nDEBUG x"), "aggressive")) == ["red", "red"]
    assert out(L.pure_signal(stream(spark, "\x1b[31mred\x1b[0m\nDEBUG x"))) == ["red", "DEBUG x"]


def test_source_context(spark):
    code = spark.createDataFrame([("pkg/a.go", i, f"line {i}") for i in range(1, 9)], "path string, line_no int, line string")
    got = out(L.semantic_purify(stream(spark, "FAIL\n    pkg/a.go:4: broken\nend"), code, 1))
    assert got == ["FAIL", "    pkg/a.go:4: broken", "\n--- SOURCE CONTEXT ---", "  line 3\n> line 4\n  line 5", "--- END CONTEXT ---\n", "end"]


@pytest.mark.parametrize(
    ("template", "data", "want"),
    [
        ("{{.a}} {{.b.c}}", {"a": 1.0, "b": {"c": "x"}}, "1 x"),
        ("{{if and .a (gt .a 2)}}big{{else}}small{{end}}", {"a": 3}, "big"),
        ("{{range .l}}<{{.}}>{{end}}", {"l": [1, 2]}, "<1><2>"),
        ("{{with .m}}{{.k}}{{else}}none{{end}}!", {"m": None}, "none!"),
        ("{{if .x}}a{{if .y}}b{{end}}{{else}}c{{end}}d", {"x": 0, "y": 1}, "cd"),
        ('{{if eq .s "q"}}yes{{end}}', {"s": "q"}, "yes"),
        ("{{len .l}} {{not .z}}", {"l": "abc", "z": False}, "3 true"),
    ],
)
def test_templates(template, data, want):
    assert templates.render(template, data) == want


def test_specs(spark):
    by = {s.name: s for s in specs.BUILT_IN}
    assert len(by) == 10
    log = "\n".join(f"{i:07x} a change with quite a long subject line that goes on and on and on, more than eighty ({i} days ago) <me>" for i in range(4)) + "\n\n"
    got = out(by["git-log"].apply(stream(spark, log)))
    assert got[0] == "4 commits:" and len(got) == 5 and all(len(x) <= 80 for x in got)
    assert out(by["git-status"].apply(stream(spark, " M a\n M b\n?? c"))) == ["2 changes:", " M (2 files)", "?? (1 files)"]
    assert out(by["go-test"].apply(stream(spark, "plain output"))) == []
    tests = '{"Action":"pass","Test":"TestA"}\n{"Action":"fail","Test":"TestB"}\n{"Action":"run","Test":"TestB"}'
    assert out(by["go-test"].apply(stream(spark, tests))) == ["1 passed, 1 failed"]
    cargo = "   Compiling x v0.1\nrunning 2 tests\ntest a ... ok\ntest b ... FAILED\n\nfailures:\n  b\ntest result: FAILED"
    assert out(by["cargo-test"].apply(stream(spark, cargo))) == ["fail: 1", "ignored: 0", "pass: 1"]
    assert out(by["bundle-install"].apply(stream(spark, "Using a\nUsing b\nInstalling c\nBundle complete!"))) == ["Bundle complete (2 cached, 1 installed)"]
    assert out(by["rails-migrate"].apply(stream(spark, "== 1 AddA: migrating\n-- add\n== 1 AddA: migrated (0.1s)\n== 2 AddB: migrated"))) == ["2 migrations executed:", "migrated: 2"]
    assert out(by["rails-routes"].apply(stream(spark, "  Prefix Verb\n a GET /a\n b POST /b"))) == ["2 routes total (showing first 15):", "routes: 2"]
    assert out(by["rspec"].apply(stream(spark, "..\n\n3 examples, 1 failure\nrspec ./a.rb:3"))) == ["3 examples, 1 failure", "rspec ./a.rb:3"]
    assert len(out(by["snr-default"].apply(stream(spark, "\n".join(map(str, range(100))))))) == 41
    assert out(by["git-diff"].apply(stream(spark, "a | 2\nb | 3"))) == ["2 files changed:", "a | 2", "b | 3"]


def test_spec_choice_and_injection(tmp_path):
    known = specs.load()
    assert L.find_spec(known, "git", ["log"]).name == "git-log" and L.find_spec(known, "git", ["log", "--oneline"]).name == "snr-default"
    assert L.find_spec(known, "ls", []).name == "snr-default" and L.find_spec(known, "rspec", ["x"]).name == "rspec"
    log = L.find_spec(known, "git", ["log"])
    assert L.inject_args(log, ["log", "--", "f"]) == ["log", "--pretty=format:%h %s (%ar) <%an>", "--no-merges", "-n", "10", "--", "f"]
    assert "10" not in L.inject_args(log, ["log", "-n", "3"]) and L.inject_args(log, ["log", "--merges"]) == ["log", "--merges"]
    (tmp_path / "a.json").write_text('{"name": "git-log", "match": {"command": "git", "subcommand": "log"}, "pipeline": [{"action": "head", "n": 1}]}')
    (tmp_path / "b.json").write_text('{"name": "x", "pipeline": [{"action": "nope"}]}')
    mine = {s.name: s for s in specs.load(str(tmp_path))}
    assert mine["git-log"].pipeline == [{"action": "head", "n": 1}] and "x" not in mine and len(mine) == 10


def test_failed_spec_passes_its_input_on(spark):
    s = stream(spark, "a\nb")
    assert out(L.Spec("x", [{"action": "keep_lines", "pattern": "("}]).run(s)) == ["a", "b"]
    with pytest.raises(ValueError):
        L.Spec("x", [{"action": "keep_lines", "pattern": "("}], on_error="raise").run(s)


def test_an_order_of_more_than_ten_failures_keeps_them_all(spark, tmp_path):
    import duckdb

    from tessera.plans import registry

    rows = [(1, n, n % 3, n, "R") for n in range(12)] + [(2, 5, 1, 1, "A"), (2, 6, 1, 2, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = registry.QUERIES["spec_rspec"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(registry.ORACLES["spec_rspec"]).fetchall())
    assert got.count() == 13
