"""A change feed with renames, and a table that follows it once."""

import random

from tessera.sources.tables import Tables
from tessera.streaming import feed


def state(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, hash string")


def test_changes_and_replay(spark, tmp_path):
    rng = random.Random(1)
    before = {f"d{i % 4}/f{i}": f"h{i % 9}" for i in range(30)}
    now = {p: h for p, h in before.items() if rng.random() < 0.6}
    now |= {f"new/f{i}": f"h{i}" for i in range(12)} | {p: "edited" for p in list(now)[:4]}
    rows = feed.changes(state(spark, before), state(spark, now)).collect()
    built = dict(before)
    for r in rows:
        if r.op in ("delete", "rename"):
            assert built.pop(r.old_path or r.path) == r.before
        if r.op == "change":
            assert built[r.path] == r.before
    for r in rows:
        if r.op != "delete":
            built[r.path] = r.after
    assert built == now and {r.op for r in rows} == {"add", "delete", "rename", "change"}
    assert all(r.before == r.after for r in rows if r.op == "rename")
    assert feed.changes(state(spark, now), state(spark, now)).count() == 0

    tables = Tables(spark, f"{tmp_path}/s", {"files": "path string, hash string"})
    tables.update(lambda c: c.replace_paths("files", state(spark, before), state(spark, before).select("path")))
    fresh = lambda b: b.selectExpr("path", "after as hash")
    batch = spark.createDataFrame(rows)
    apply = lambda n: tables.update(lambda c: feed.follow(c, "files", batch, fresh) if feed.once(c, "x", n) else None)
    content = lambda: {r.path: r.hash for r in tables.table("files").collect()}
    apply(0)
    assert content() == now and tables.version() == 1
    apply(0)
    assert content() == now and tables.version() == 1
