"""A small tree indexed, changed and asked about."""

import datetime
import os

import pytest

from tessera.__main__ import main
from tessera.operators.parse import ArchRule
from tessera.workspace import Workspace

CORE = "def scale(x):\n    return x\n\n\ndef boost(x):\n    return scale(x)\n"
USE = "from core import scale\n\n\ndef test_scale():\n    assert scale(1)\n\n\ndef twin(y):\n    return y\n"


@pytest.fixture(scope="module")
def w(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("w")
    (root / "src").mkdir()
    (root / "src" / "core.py").write_text(CORE)
    (root / "src" / "use.py").write_text(USE)
    (root / "src" / "go.mod").write_text("module m\n\nrequire a.b/c v1.0.0\n")
    space = Workspace(spark, f"{root}/store")
    space.src = root / "src"
    assert space.index(f"file:{root}/src") == {"parse": 3, "gone": 0}
    return space


def test_questions(w):
    assert {r.path for r in w.map().collect()} == {"core.py", "use.py"}
    assert w.search("scale").first().name in ("scale", "test_scale")
    row, callers = w.impact("scale")
    assert row.first().level in ("Low", "Medium") and {r.caller for r in callers.collect()} == {"core.boost", "use.test_scale"}
    assert w.graph("scale").count("-->") == 2
    assert {r.name for r in w.twins("twin").collect()} == {"scale", "boost"}
    assert {r.name for r in w.predict("+++ b/core.py\n@@ -1 +1,2 @@\n").collect()} == {"test_scale"}
    assert w.critical(3).count() == 3
    assert w.read("boost") == "def boost(x):\n    return scale(x)"
    assert {(r.kind, r.a) for r in w.neighborhood("use.py").collect()} >= {("IMP", "core"), ("CALL", "use.test_scale")}
    assert w.context("core.py").first().symbols == 2 and w.flow("core.scale:return0").count() == 1
    assert {r.impacted for r in w.propagate("scale", 1).collect()} >= {"core.boost"}
    page, cursor = w.callers("scale")
    assert page.count() == 2 and cursor
    assert [r.line for r in w.audit([ArchRule("a", "scale($X)", "no")]).orderBy("file_path").collect()] == [6, 5]
    assert w.table("dependencies").first().name == "a.b/c"
    assert w.condense("a\n\na\nb", ["ls"]) == ["a [x2]", "b"]
    assert [r.path for r in w.structural("scale($X)").collect()] == ["core.py", "use.py"]
    before = w.version()
    found, notes = w.search_all("boost")
    assert found.first().name == "boost" and notes.count() == 0 and w.version() == before + 1
    assert w.symbols_with_hits().where("name = 'boost'").first().runtime_hits == w.table("hits").join(w.table("symbols").where("name = 'boost'"), "id").count() > 0
    row = w.diagnose("x\n    core.py:2: boom\n".replace("core.py", "core.go")) or w.diagnose("    nowhere.go:1: x")
    assert row.first().failing_symbol == "Unknown" and w.diagnose("fine") is None


def test_versions_keep_what_they_name(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(i,)], "id long")
    space.save({"hits": row(1), "imports": spark.createDataFrame([("a", "b")], "path string, import string")})
    for i in range(2, 14):
        space.save({"hits": row(i)})
    assert space.version() == 12 and len(space.versions()) == 10
    assert space.table("hits").first().id == 13 and space.table("hits", 5).first().id == 6
    assert space.table("imports").first()["import"] == "b" and len(list((tmp_path / "s" / "tables" / "hits").iterdir())) == 10
    assert space.table("calls").count() == 0


def test_go_interfaces_are_linked(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text("package shop\n\ntype Named interface {\n\tName() string\n}\n\ntype Payer interface {\n\tNamed\n\tPay(n int) error\n}\n")
    (src / "b.go").write_text("package shop\n\ntype Base struct{}\n\nfunc (b Base) Name() string { return \"\" }\n\ntype Cart struct {\n\tBase\n}\n\nfunc (c *Cart) Pay(n int) error { return nil }\n\ntype Odd struct{}\n\nfunc (o Odd) Name() int { return 1 }\n")
    (src / ".gitignore").write_text("skip.go\n")
    (src / "skip.go").write_text("package shop\n\nfunc Skipped() {}\n")
    space = Workspace(spark, str(tmp_path / "s"))
    assert space.index(f"file:{src}") == {"parse": 2, "gone": 0}
    got = {(r.caller, r.callee, r.link_type) for r in space.table("calls").collect()}
    p = "shop."
    assert got == {
        (p + "Payer", p + "Named", "embeds"), (p + "Cart", p + "Base", "embeds"), (p + "Payer.Name", p + "Named.Name", "embeds"),
        (p + "Cart", p + "Payer", "implements"), (p + "Cart", p + "Named", "implements"), (p + "Base", p + "Named", "implements"),
        (p + "Cart.Pay", p + "Payer.Pay", "satisfies"), (p + "Cart.Name", p + "Payer.Name", "satisfies"), (p + "Cart.Name", p + "Named.Name", "satisfies"), (p + "Base.Name", p + "Named.Name", "satisfies"),
    }
    assert {r.caller for r in space.impact("Named")[1].collect()} >= {p + "Cart", p + "Payer"}


def test_changes(w, spark, capsys):
    before = w.version()
    (w.src / "core.py").write_text(CORE.replace("return scale(x)", "return scale(x) + 1"))
    (w.src / "use.py").unlink()
    assert w.index(f"file:{w.src}") == {"parse": 1, "skip": 1, "gone": 1}
    assert {(r.name, r.state) for r in w.verify(before).collect()} == {("core.py:boost", "mangled"), ("use.py:test_scale", "missing"), ("use.py:twin", "missing")}
    usage = w.src.parent / "u.jsonl"
    usage.write_text('{"symbol_name": "scale", "hit_count": 5, "last_used": 10}\n')
    w.ingest(str(usage), "prod")
    w.ingest(str(usage), "prod")
    assert w.table("symbols").where("name = 'scale'").first().runtime_hits == 10
    w.score_churn(spark.createDataFrame([(1, 1, "core.py")], "commit int, ts int, path string"))
    w.score_pagerank()
    row = w.table("symbols").where("name = 'scale'").first()
    assert row.churn_score == 0.5 and row.pagerank > 0 and row.runtime_hits == 10
    w.track(spark.createDataFrame([(1, datetime.datetime(2024, 1, 2), "x", 10, 4)], "id long, timestamp timestamp, original_cmd string, input_tokens long, output_tokens long"))
    assert w.gain("summary").first().total_saved == 6
    assert main(["--store", w.root, "search", "boost"], spark) == 0 and "core.py" in capsys.readouterr().out
    assert main(["--store", w.root, "impact", "nothing"], spark) == 1


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """Files are told by their times: what is behind an equal time is not looked at, and one changed file writes one shard."""
    src = tmp_path / "src"
    for d in "abcdef":
        (src / d).mkdir(parents=True)
        (src / d / "m.py").write_text(f"def {d}1():\n    return {d}2()\n\n\ndef {d}2():\n    return 0\n")
    space = Workspace(spark, str(tmp_path / "s"))
    assert space.index(f"file:{src}") == {"parse": 6, "gone": 0}
    assert space.search("a1", bump=False).first().name == "a1"
    times = (src / "a" / "m.py").stat()
    (src / "a" / "m.py").write_text("def never():\n    return read_()\n")
    os.utime(src / "a" / "m.py", ns=(times.st_atime_ns, times.st_mtime_ns))
    before = space.version()
    assert space.index(f"file:{src}") == {"gone": 0, "skip": 6} and space.version() == before
    os.utime(src / "b" / "m.py", ns=(times.st_atime_ns, times.st_mtime_ns + 10**9))
    (src / "c" / "m.py").write_text("def other():\n    return c1()\n")
    assert space.index(f"file:{src}") == {"parse": 1, "touch": 1, "skip": 4, "gone": 0}
    old, new = (space.tables.manifest(v)["symbols"] for v in (before, space.version()))
    assert sum(old.get(k) != new.get(k) for k in {*old, *new}) == 1 and len(old) > 2
    state = space.search_state()
    assert len(state.segments) == 2 and state.segments[1].rows == 1 and sum(r.rows for r in state.removals) == 2
    assert space.search("other", bump=False).first().path == "c/m.py"
    assert {r.name for r in space.table("symbols").collect()} == {"a1", "a2", "b1", "b2", "d1", "d2", "e1", "e2", "f1", "f2", "other"}
    assert space.table("vec_symbols").count() == 11 and space.table("symbols").where("name = 'd2'").first().relevance == 1
