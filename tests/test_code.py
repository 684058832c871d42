"""Parsing, graph, risk, search and store operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, graph, parse, risk, search, store, telemetry
from tessera.sources import diffs

EDGE = "caller string, callee string, path string, line int, callee_path string, link_type string"
SYMBOL = "id long, name string, type string, package_path string, path string, start_line int, end_line int, churn_score double, pagerank double, structural_hash string, logic_hash string, metrics_json string, runtime_hits long"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, p, n, cp, t) for a, b, p, n, cp, t in rows], EDGE)


def symbols(spark, *rows):
    return spark.createDataFrame([(i, n, t, pkg, p, s, e, 0.8, 0.5, f"h{n[-1]}", "", json.dumps({"cognitive": 50}), 0) for i, (n, t, pkg, p, s, e) in enumerate(rows)], SYMBOL)


PYTHON = '''import os.path as osp
from tools import scale as sc, other
from functools import partial

class Box(Base):
    """A box."""
    def put(self, item):
        if item and self.open or item.force:
            for x in item.parts:
                sc(x)
        return item

async def run(values):
    total = values
    out = map(sc, values)
    done = partial(helper, total)
    osp.join("a", total)
    return out, done

def helper(a):
    return a

f = lambda q: q + 1
'''


def test_python_parse(spark):
    files = spark.createDataFrame([("pkg/box.py", PYTHON), ("bad.py", "def ("), ("x.txt", "text"), ("none.py", None)], "path string, content string")
    parsed = parse.parse(files)
    s = {r.name: r for r in parse.rows_of(parsed, "symbol").collect()}
    assert {k: r.type for k, r in s.items()} == {"Box": "class", "Box.put": "method", "run": "function", "helper": "function", "func1": "function"}
    put = s["Box.put"]
    assert put.receiver_type == "Box" and put.package_path == "pkg.box" and (put.start_line, put.end_line) == (7, 11)
    assert s["Box"].doc == "A box." and s["run"].signature == "def run(values)"
    m = json.loads(put.metrics_json)
    assert m["cyclomatic"] == 5 and m["cognitive"] == 1 + 1 + 1 and m["has_loop"] and json.loads(s["run"].metrics_json)["is_async"]
    raw = PYTHON.encode()
    assert raw[put.start_byte : put.end_byte].decode().startswith("def put") and raw[put.start_byte : put.end_byte].decode().endswith("return item")
    calls = {(r.caller, r.callee, r.link_type) for r in parse.rows_of(parsed, "call").collect()}
    assert {("pkg.box.Box.put", "tools.scale", "call"), ("pkg.box.run", "tools.scale", "reference"), ("pkg.box.run", "pkg.box.helper", "reference"), ("pkg.box.run", "os.path.join", "call"), ("pkg.box.Box", "Base", "embeds")} <= calls
    assert {r["import"] for r in parse.rows_of(parsed, "import").collect()} == {"os.path", "tools", "functools"}
    flows = {(r.source, r.sink, r.type) for r in parse.rows_of(parsed, "flow").collect()}
    assert {("values", "total", "assignment"), ("total", "functools.partial:arg1", "argument"), ("out", "pkg.box.run:return0", "return"), ("done", "pkg.box.run:return1", "return")} <= flows


def test_hashes_mask_names_only(spark):
    one, two, three = "def f(a, b):\n    return a + b\n", "def g(x, y):\n    return x + y\n", "def h(x, y):\n    return x * y\n"
    rows = {r.path: r for r in parse.rows_of(parse.parse(spark.createDataFrame([("1.py", one), ("2.py", two), ("3.py", three)], "path string, content string")), "symbol").collect()}
    assert rows["1.py"].structural_hash == rows["2.py"].structural_hash == rows["3.py"].structural_hash
    assert rows["1.py"].logic_hash == rows["2.py"].logic_hash != rows["3.py"].logic_hash


GO = 'package shop\n\nimport "fmt"\n\n// Cart holds items.\ntype Cart struct {\n\tn int\n}\n\ntype Payer interface {\n\tPay(n int) error\n}\n\nfunc (c *Cart) Pay(n int) error {\n\tif n > 0 && c.n > 0 {\n\t\tfmt.Println(n)\n\t}\n\treturn nil\n}\n\nfunc Total(c Cart) int {\n\tm := c\n\treturn sum(c.n)\n}\n'
TS = "import { x } from './x';\nexport interface Shape { area(): number; }\nexport class Circle extends Base {\n  area(): number {\n    return compute(this.r);\n  }\n}\nexport const twice = (n: number) => {\n  return n;\n};\n"
RS = "use std::fmt;\npub trait Draw { fn draw(&self); }\npub struct Dot;\nimpl Draw for Dot {\n    fn draw(&self) {\n        paint(self);\n    }\n}\n"


def test_brace_languages(spark):
    parsed = parse.parse(spark.createDataFrame([("shop/cart.go", GO), ("c.ts", TS), ("d.rs", RS)], "path string, content string"))
    s = {(r.path, r.name): r for r in parse.rows_of(parsed, "symbol").collect()}
    kinds = {k[1]: r.type for k, r in s.items() if k[0] == "shop/cart.go"}
    assert kinds == {"Cart": "class", "Payer": "interface", "Payer.Pay": "method_spec", "Cart.Pay": "method", "Total": "function"}
    pay = s[("shop/cart.go", "Cart.Pay")]
    assert (pay.signature, pay.receiver_type, pay.start_line, pay.end_line) == ("(int) -> (error)", "pointer", 14, 19)
    assert s[("shop/cart.go", "Cart")].doc == "Cart holds items." and s[("shop/cart.go", "Total")].end_line == 24
    assert {k[1]: r.type for k, r in s.items() if k[0] == "c.ts"} == {"Shape": "interface", "Circle": "class", "Circle.area": "method", "twice": "function"}
    assert {k[1] for k in s if k[0] == "d.rs"} >= {"Draw", "Dot", "Dot.draw"}
    calls = {(r.caller, r.callee, r.link_type) for r in parse.rows_of(parsed, "call").collect()}
    assert {("shop.Cart.Pay", "fmt.Println", "call"), ("shop.Total", "shop.sum", "call"), ("c.Circle", "Base", "embeds"), ("d.Dot", "Draw", "implements")} <= calls
    assert ("c", "m", "assignment") in {(r.source, r.sink, r.type) for r in parse.rows_of(parsed, "flow").collect()}
    assert {r["import"] for r in parse.rows_of(parsed, "import").collect()} == {"fmt", "./x", "std::fmt"}


def test_structural_search_and_audit(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    print(x, x)\n    print(1, 2)\n    log(print(y, y))\n"), ("b.py", "print(z, z)\n")], "path string, content string")
    found = {(r.path, r.line, r.captures["A"]) for r in parse.structural_search(files, "print($A, $A)").collect()}
    assert found == {("a.py", 2, "x"), ("a.py", 4, "y"), ("b.py", 1, "z")}
    assert {r.path for r in parse.structural_search(files, "print($A, $A)", inside="function").collect()} == {"a.py"}
    assert [r.line for r in parse.structural_search(files, "log($$$)", has="print($A, $B)").collect()] == [4]
    rows = parse.audit(files, [parse.ArchRule("no-print", "print($$$)", "do not print", "error", "b.py")]).collect()
    assert [(r.rule_id, r.file_path, r.line, r.severity) for r in rows] == [("no-print", "b.py", 1, "error")]


def test_aliases(spark):
    calls = edges(spark, ("c", "np.zeros", "a", 1, "", "call"), ("c", "q.x", "a", 1, "", "call"))
    aliases = spark.createDataFrame([("a", "np", "numpy"), ("a", "q", "one"), ("a", "q", "two")], "path string, alias string, target string")
    assert {r.callee for r in parse.normalize_callees(calls, aliases).collect()} == {"numpy.zeros", "q.x"}


def test_blast_radius_and_names(spark):
    e = edges(spark, ("b", "p.a", "f2", 1, "f1", "call"), ("c", "b", "f3", 1, "", "implements"), ("b", "c", "f2", 9, "f3", "call"), ("z", "p.a", "f9", 1, "other", "call"))
    got = {tuple(r) for r in graph.blast_radius(e, ["a", "p.a"], "f1", 3).collect()}
    assert got == {("b", "f2", 1, "call"), ("c", "f3", 2, "implements")}


def test_affected_tests(spark):
    s = symbols(spark, ("Sum", "function", "", "s.go", 1, 5), ("TestSum", "function", "", "s_test.go", 1, 5), ("main", "function", "", "m.go", 1, 2), ("TestMain", "function", "", "m_test.go", 1, 2), ("mid", "function", "", "k.go", 1, 2), ("TestMid", "method", "", "k.go", 5, 9))
    e = edges(spark, ("TestSum", "Sum", "s_test.go", 3, "s.go", "call"), ("main", "Sum", "m.go", 1, "", "call"), ("TestMain", "main", "m_test.go", 1, "m.go", "call"), ("mid", "Sum", "k.go", 1, "", "call"), ("TestMid", "mid", "k.go", 6, "", "call"))
    assert {r.name for r in graph.affected_tests(s, e, "Sum", "s.go").collect()} == {"TestSum", "TestMid"}
    diff = spark.createDataFrame(list(enumerate(["+++ b/s.go", "@@ -1,2 +3,2 @@", "+++ b/none.go", "@@ -9 +9 @@"])), "line_no int, line string").withColumn("doc_id", F.lit(1))
    assert {tuple(r) for r in diffs.changed_ranges(diff).collect()} == {("s.go", 3, 4), ("none.go", 9, 9)}
    assert {r.name for r in risk.predict_tests(diff, s, e).collect()} == {"TestSum", "TestMid"}
    assert risk.predict_tests(diff.limit(0), s, e).count() == 0


def test_ripple(spark):
    e = edges(spark, ("b", "a", "f", 1, "", "call"), ("c", "b", "f", 2, "", "call"), ("a", "i", "f", 3, "", "implements"), ("d", "i", "f", 4, "", "call"), ("x", "y", "f", 5, "", "call"))
    assert {(r.caller, r.callee, r.depth) for r in graph.ripple(e, "a", 2).collect()} == {("b", "a", 1), ("a", "i", 1), ("c", "b", 2), ("d", "i", 2)}
    tasks = {(r.kind, r.symbol, r.impacted, r.depth) for r in graph.discover_tasks(symbols(spark, ("a", "function", "", "f", 1, 2)), e, "a", 2).collect()}
    assert tasks == {("definition", "a", "a", 0), ("caller", "a", "b", 1), ("hierarchy", "a", "i", 1), ("caller", "b", "c", 2), ("caller", "i", "d", 2)}


def test_pagerank(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    e = spark.createDataFrame([("A", "B", 1, "call"), ("C", "B", 1, "call"), ("A", "gone", 1, "call")], "src string, dst string, line int, link_type string")
    r = {x.node: x.rank for x in graph.pagerank(nodes, e).collect()}
    assert r["B"] > r["A"] == pytest.approx(r["C"]) and sum(r.values()) == pytest.approx(1)
    seeded = {x.node: x.rank for x in graph.pagerank(nodes, e, seeds=["C"]).collect()}
    assert seeded["A"] == 0 and sum(seeded.values()) == pytest.approx(1)
    assert graph.pagerank(nodes.limit(0), e).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pagerank_deals_links_to_both_ends_and_sorts_no_pairs(spark, monkeypatch):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "node string")
    e = spark.createDataFrame([("A", "B", 1, "call"), ("C", "B", 1, "call"), ("A", "gone", 1, "call")], "src string, dst string, line int, link_type string")
    frame, held = type(nodes), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *level: (held.append(plan(df)), persist(df, *level))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranks = {(r.node, r["rank"]) for r in graph.pagerank(nodes, e).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(ranks) == 3 and sum(r for _, r in ranks) == pytest.approx(1)  # a node that is named twice is one
    (links,) = [p for p in held if "src" in p and "dst" in p and "rank" not in p]
    assert "Window" not in links and "SortAggregate" not in links
    moved = [x for x in links.splitlines() if "Exchange hashpartitioning(" in x and "(node" not in x]
    assert len(moved) == 2


def test_first_of_several_links_gives_the_weight(spark):
    cases = {(("call", 2), ("implements", 1)): 10, (("implements", 2), ("call", 1)): 1, (("implements", 1), ("call", 1)): 1, (("zzz", 1), ("satisfies", 1)): 5, (("satisfies", 1), ("dynamic", 1)): 2, (("embeds", -3), ("satisfies", 0)): 3, ((None, 1), ("embeds", 1)): 1, (("call", -7), ("embeds", None)): 3, (("dynamical", 4), ("dynamic", 4)): 2, (("a", 4), ("dynamic", 4)): 1}
    nodes = spark.createDataFrame([(i,) for i in range(len(cases) + 1)], "node int")
    for kind in ("int", "long", "string"):
        rows = [(i, i + 1, n if n is None or kind != "string" else chr(80 + n), t) for i, links in enumerate(cases) for t, n in links]
        e = spark.createDataFrame(rows, f"src int, dst int, line {kind}, link_type string")
        assert [r.w for r in graph.weighted_links(nodes, e).orderBy("src").collect()] == list(cases.values()), kind
    e = spark.createDataFrame([(0, 1, "satisfies"), (0, 1, "implements")], "src int, dst int, link_type string")
    assert [r.w for r in graph.weighted_links(nodes, e).collect()] == [10]


def test_rows_of_a_join_are_dealt_out_before_equal_ones_are_sought(spark):
    e = edges(spark, ("A", "I", "a.go", 1, "", "call"), ("A", "I", "a.go", 1, "", "call"), ("T", "I", "t.go", 3, "i.go", "satisfies"))
    found = graph.class_hierarchy_calls(e)
    lines = plan(found).split("\n")
    assert "Union" in lines[next(i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x) + 1]
    assert sorted(tuple(r) for r in found.select("caller", "callee", "line").collect()) == [("A", "I", 1), ("A", "T", 1)]


def test_critical_and_churn(spark):
    s = symbols(spark, ("A", "function", "", "a.go", 1, 2), ("B", "function", "", "b.go", 1, 2), ("C", "function", "", "c.go", 1, 2))
    e = edges(spark, ("A", "B", "a.go", 1, "b.go", "call"), ("A", "C", "a.go", 2, "", "call"))
    failed = spark.createDataFrame([("B",)], "target_symbol string")
    assert [(r.name, r.centrality, r.fragility) for r in graph.critical(s, e, failed, 2).collect()] == [("B", 1, 1), ("C", 1, 0)]
    commits = spark.createDataFrame([(1, 1, "f1"), (1, 1, "f2"), (2, 2, "f2"), (2, 2, "f3")], "commit int, ts int, path string")
    scores = {r.path: r.score for r in graph.churn(commits).collect()}
    assert scores == {"f1": 0.5, "f2": 0.75, "f3": 0.5}
    assert {r.path for r in graph.churn(commits, 1).collect()} == {"f2", "f3"}


def test_interfaces_and_closure(spark):
    faces = spark.createDataFrame([("I", "m"), ("I", "n"), ("J", "q")], "name string, method string")
    types = spark.createDataFrame([("T", "m"), ("T", "n"), ("T", "z"), ("U", "m")], "name string, method string")
    assert [tuple(r) for r in graph.resolve_interfaces(faces, types).collect()] == [("T", "I")]
    flows = spark.createDataFrame([("v", "f:arg0"), ("f:arg0", "w"), ("x", "y")], "source string, sink string")
    assert {(r.node, r.depth) for r in graph.closure(flows, "v").collect()} == {("f:arg0", 1), ("w", 2)}
    assert [r.sink for r in graph.flows_to(flows, "w").collect()] == ["w"]


def test_risk(spark):
    one = spark.range(1)
    value = risk.score(F.lit(1), F.lit(50), F.lit(0.8), F.lit(1.0), F.lit(100), F.lit(0.5), F.lit(3))
    assert one.select(value.alias("v")).first().v == pytest.approx(0.8437, abs=1e-3)
    s = symbols(spark, ("f", "function", "pkg", "a.go", 1, 100))
    e = edges(spark, ("g", "pkg.f", "b.go", 1, "", "call"), ("h", "f", "c.go", 1, "", "reference"))
    row = risk.impact(s, e, "f", "a.go", spark.createDataFrame([("a.go",)], "path string"), 3).first()
    assert row.blast == 1 and row.level == "Critical" and row.risk == pytest.approx(0.8437, abs=1e-3)
    rows = risk.test_gap(spark.createDataFrame([("a.go",), ("b.py",), ("c.ts",)], "path string"), spark.createDataFrame([("a_test.go",), ("c.test.ts",)], "path string"))
    assert {r.path: r.test_gap for r in rows.collect()} == {"a.go": 0.0, "b.py": 1.0, "c.ts": 0.0}
    notes = spark.createDataFrame([(1, "bug in f", 1), (2, "Fix f and pkg.f", 2), (3, "none", 3)], "id int, content string, created_at int")
    assert risk.historical_risk(notes, ["bug in f", "fix f", "pkg.f"]).first().bugfixes == 2


def test_file_context(spark):
    s = symbols(spark, ("f", "function", "", "a.go", 1, 2))
    e = edges(spark, ("x", "f", "b.go", 1, "a.go", "call"), ("y", "f", "c.go", 1, "a.go", "call"), ("z", "x", "d_test.go", 1, "b.go", "call"), ("f", "f", "a.go", 1, "a.go", "call"))
    row = risk.file_context(spark.createDataFrame([("a.go", 6)], "path string, loc int"), s.withColumn("churn_score", F.lit(0.0)), e).first()
    assert (row.symbols, row.direct_dependents, row.transitive, row.test_hints) == (1, ["b.go", "c.go"], 3, ["d_test.go"])
    assert tuple(row.edit_cost) == (524, "medium", "caution")


def test_diagnose_and_spike(spark):
    log = spark.createDataFrame([("    pkg/a.go:4: nil",), ("ok",)], "line string")
    s = symbols(spark, ("f", "function", "", "/r/pkg/a.go", 2, 6), ("g", "function", "", "/r/pkg/a.go", 8, 9))
    assert [tuple(r) for r in risk.diagnose(log, s).collect()] == [("pkg/a.go", 4, "f", "/r/pkg/a.go")]
    rank = lambda v: spark.createDataFrame([("f", "p", v)], "name string, path string, relevance double")
    assert risk.centrality_spike(rank(1.0), rank(1.3)).count() == 1 and risk.centrality_spike(rank(1.0), rank(1.1)).count() == 0


def test_store(spark):
    s = symbols(spark, ("a", "function", "", "p1", 1, 2), ("b", "class", "q", "p2", 3, 4), ("b", "class", "q", "p3", 3, 4))
    e = edges(spark, ("a", "b", "p1", 1, "", "call"), ("a", "b", "p1", 1, "", "call"))
    new = symbols(spark, ("c", "function", "", "p1", 1, 9))
    tables = {"file_index": spark.createDataFrame([("p1", "h"), ("p2", "h")], "path string, hash string"), "symbols": s, "calls": e, "violations": spark.createDataFrame([("r", "p1"), ("r", "p2")], "rule_id string, file_path string")}
    out = store.save_batch(tables, {"file_index": tables["file_index"].where("path = 'p1'"), "symbols": new, "calls": e})
    assert {r.name for r in out["symbols"].collect()} == {"b", "c"} and out["calls"].count() == 1 and [r.file_path for r in out["violations"].collect()] == ["p2"]
    assert store.resolve_name(s, "a") == ("a", "p1") and store.resolve_name(s, "x/y") == ("x/y", "")
    for bad in ("b", "none"):
        with pytest.raises(LookupError):
            store.resolve_name(s, bad)
    with pytest.raises(ValueError):
        store.symbols_of(s, path_prefix="relative")
    assert store.conform(s.select("name"), store.schema("symbols")).columns == store.schema("symbols").fieldNames()
    assert store.parse_metrics(s).first().metrics.cognitive == 50
    assert store.decode_cursor(store.encode_cursor(7, 500)) == (7, 100) and store.decode_cursor(None) == (0, 50)
    with pytest.raises(ValueError):
        store.decode_cursor("???")
    assert [tuple(r) for r in store.split_key(spark.createDataFrame([("n:a:b",)], "key string")).select("name", "path").collect()] == [("n", "a:b")]
    assert {tuple(r) for r in store.difference(s.select("name", "id"), new.select("name", "id"), ["name"], "id").collect()} == {("a", "missing"), ("b", "missing"), ("c", "added")}


def test_search(spark):
    rows = spark.createDataFrame([(1, "search symbols", "x"), (2, "symbols to search", "search symbols"), (3, "other", "")], "id int, name string, doc string")
    index, ids = search.build_index(rows, "id", ["name", "doc"]), rows.select("id")
    assert {r.id for r in search.phrase_match(index, "Search sym*").collect()} == {1, 2} and {r.id for r in search.phrase_match(index, "to search").collect()} == {2}
    assert search.phrase_match(index, '"').count() == 0 and search.sanitize('a"b*') == '"a""b"*' and search.sanitize("*") == ""
    assert [r.id for r in search.weighted_search(index, ids, "search symbols").collect()] == [1, 2]
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0])], "id int, embedding array<float>")
    assert [r.id for r in search.knn(vectors, [1.0, 0.0], 5).collect()] == [3, 1]
    assert [r.id for r in search.search(index, ids, vectors, "search symbols", lambda q: [0.0, 1.0]).collect()][0] == 1

    def broken(q):
        raise RuntimeError("no model")

    assert {r.id for r in search.search(index, ids, vectors, "search symbols", broken).collect()} == {1, 2}
    s = symbols(spark, ("a1", "function", "", "p", 1, 2), ("b1", "function", "", "p", 1, 2), ("c2", "function", "", "p", 1, 2))
    assert [r.name for r in search.twins(s, "a1", "p").collect()] == ["b1"]
    with pytest.raises(LookupError):
        search.twins(s, "zz", "p")
    assert {r.id: r.runtime_hits for r in search.bump(s, s.where("id = 1")).collect()} == {0: 0, 1: 1, 2: 0}


def test_insights(spark):
    notes = spark.createDataFrame([(1, "# Title one\n**Why**: a reason\n**why**: better", "p", 1), (2, "[3] #7 (bugfix) — Sum broke\n**Learned**: check Sum.go", "p", 2)], "id int, content string, project string, created_at int")
    got = {r.id: tuple(r)[1:] for r in search.parse_insight(notes).collect()}
    assert got == {1: ("", "Title one", "better", ""), 2: ("bugfix", "Sum broke", "", "check Sum.go")}
    s = symbols(spark, ("Sum", "function", "", "b", 1, 2), ("Sum", "function", "", "a", 1, 2), ("one", "function", "", "c", 1, 2), ("um", "function", "", "d", 1, 2))
    assert {tuple(r) for r in search.insight_links(s, search.parse_insight(notes)).collect()} == {(0, 2), (1, 2), (2, 1)}
    assert {(r.memory_id, r.symbol, tuple(r.paths)) for r in search.correlate(notes, s).collect()} == {(2, "Sum", ("a", "b")), (1, "one", ("c",))}
    assert search.memory_scan(notes, "p", 2).count() == 1


def test_usage(spark):
    s = symbols(spark, ("f", "function", "pkg", "a", 1, 2), ("f", "function", "", "b", 1, 2))
    usage = spark.createDataFrame([("f", "a", 5, 1000), ("pkg.f", "", 3, 2000), ("none", "", 1, 1)], "symbol_name string, symbol_path string, hit_count long, last_used long").withColumn("environment", F.lit("prod"))
    merged = telemetry.merge_usage(*[telemetry.usage_rollup(telemetry.resolve_usage(usage.where(c), s)) for c in ("symbol_path <> ''", "symbol_path = ''")])
    assert [tuple(r) for r in merged.collect()] == [(0, "prod", 8, 2000)]


def test_results_of_tests(spark):
    rows = [(1, "run", "", None), (2, "output", "lost\n", None), (3, "run", "", None), (4, "output", "--- FAIL: TestStore_Get\n", None), (5, "output", "  a.go:3: boom\nmore\n", None), (6, "fail", "", 0.25), (7, "pass", "", 1.0)]
    events = spark.createDataFrame([(i, "p", "TestStore_Get", a, o, e) for i, a, o, e in rows] + [(9, "p", "", "pass", "", 1.0)], "seq int, package string, test string, action string, output string, elapsed double")
    got = [tuple(r)[3:] for r in telemetry.test_results(events).orderBy("seq").collect()]
    assert got == [("fail", "a.go:3: boom", "  a.go:3: boom\nmore", 250, "Store.Get"), ("pass", "", "", 1000, "Store.Get")]
    assert telemetry.health_report(telemetry.test_results(events), "Store.Get", True).count() == 1


def test_encodings(spark):
    s = symbols(spark, ("f", "function", "", "b", 1, 2), ("g", "class", "", "a", 3, 4)).withColumn("start_col", F.lit(0)).withColumn("signature", F.lit(None).cast("string")).withColumn("doc", F.lit("d"))
    ids = encode.path_ids(s, "id")
    assert {tuple(r) for r in ids.collect()} == {("b", 1), ("a", 2)}
    assert {r.line for r in encode.hakai_symbols(s, ids).collect()} == {"S|1|f|function|1|0||d", "S|2|g|class|3|0||d"}
    assert {r.line for r in encode.hakai_symbols(s, ids, False).collect()} == {"S|1|f|function|1|0", "S|2|g|class|3|0"}
    assert {r.line for r in encode.hakai_scores(s, ids, "R", "pagerank").collect()} == {"R|1|0.5000", "R|2|0.5000"}
    e = edges(spark, ("x", "y", "b", 1, "", "call"), ("x", "y", "b", 2, "", "call"))
    assert encode.mermaid(e, "t") == 'graph TD\n  subgraph "t"\n  "x" --> "y"\n  end\n'
    assert [r.line for r in encode.zon(s.limit(0), ["name"], ["name"]).collect()] == ["@(0)[]"]
    assert "- [[x]]" in encode.note("f", {"risk": 0.5}, ["x"], "graph TD") and encode.bar(5, 10, 4) == "██░░" and encode.text_table([{"a": 1}], ["a", "b"]).startswith("a  b")
    assert encode.staged_diff("p", "a\n", "b\n").startswith("--- a/p")
    assert {(r.child, r.parent, r.arrow) for r in graph.impact_edges(graph.blast_radius(edges(spark, ("b", "a", "f", 1, "", "call"), ("c", "b", "f", 1, "", "implements")), ["a"]), "a").collect()} == {("b", "a", "-->"), ("c", "b", "-.->")}
    assert encode.cold_lines(s, "path").count() == 2


def test_insight_links_send_no_notes_through_the_driver(spark, tmp_path):
    """A file of notes is small, its words with a text on each are not: names met them in a broadcast of the words."""
    spark.range(50).select("id", F.lit("Sum of it").alias("title"), F.lit("").alias("why"), F.lit("").alias("learned")).write.parquet(str(tmp_path / "notes"))
    names = spark.createDataFrame([(0, "sum"), (1, "it of")], "id int, name string")
    links = search.insight_links(names, spark.read.parquet(str(tmp_path / "notes")))
    assert links.count() == 50
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().sparkPlan().toString()


def test_one_kind_alone_is_what_all_kinds_have_of_it(spark):
    """Files of one part go to many tasks, and a kind read alone has the rows that it has among all."""
    files = spark.createDataFrame([("shop/cart.go", GO), ("c.ts", TS), ("d.rs", RS), ("a.py", PYTHON), ("bad.py", "def ("), ("x.md", "# no")], "path string, content string").coalesce(1)
    parsed = parse.parse(files)
    for kind in ("symbol", "call", "flow", "import"):
        alone = parse.parse_only(files, kind)
        want = parse.rows_of(parsed, kind)
        assert alone.rdd.getNumPartitions() > 4 and alone.dtypes == want.dtypes
        assert sorted(map(str, alone.collect())) == sorted(map(str, want.collect())) != []


def test_few_nodes_are_sent_to_edges(spark, monkeypatch):
    """A level of few nodes goes to the edges, a large one is shuffled; the edges are read in one pass and both give the same rows."""
    rows = [(f"n{i + 1}", f"n{i}", "p", i, "p", "implements" if i == 2 else "call") for i in range(6)] + [("n1", "n5", "p", 9, "", "satisfies")]
    edges = spark.createDataFrame(rows, "caller string, callee string, path string, line int, callee_path string, link_type string")
    want = {("n1", 0, 1), ("n2", 1, 2), ("n3", 2, 3), ("n4", 3, 4), ("n1", 9, 2), ("n6", 5, 3)}
    for most, hint in ((100_000, True), (0, False)):
        monkeypatch.setattr(graph, "MOST_SENT", most)
        met = graph.ripple(edges, "n0", 4)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == hint and "Union" not in plan.split("Join")[1].split("LogicalRDD")[0]
        got = {(r.caller, r.line, r.depth) for r in met.collect()}
        assert got == want, got
