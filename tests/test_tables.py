"""Versioned tables with two writers at once."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.strings import shard_route
from tessera.sources.tables import Change, Conflict, Tables

SCHEMAS = {"symbols": "path string, name string", "hits": "id long"}


def rows(spark, *data):
    return spark.createDataFrame(data, "path string, name string")


def paths(spark, *data):
    return spark.createDataFrame([(p,) for p in data], "path string")


def content(t, version=None):
    return {tuple(r) for r in t.table("symbols", version).collect()}


@pytest.fixture
def two(spark, tmp_path):
    a, b = (Tables(spark, f"{tmp_path}/s", SCHEMAS) for _ in range(2))
    a.update(lambda c: c.replace_paths("symbols", rows(spark, ("x/1.go", "one"), ("x/2.go", "two"), ("y/3.go", "three")), paths(spark)))
    shard = lambda p: spark.range(1).select(shard_route(F.lit(p))).first()[0][:1]
    assert shard("x/1.go") != shard("y/3.go")
    return a, b, tmp_path


def test_one_changed_file_writes_one_shard(spark, two):
    a, _, _ = two
    before = a.manifest(0)["symbols"]
    a.update(lambda c: c.replace_paths("symbols", rows(spark, ("x/1.go", "uno")), paths(spark, "x/1.go")))
    after = a.manifest(1)["symbols"]
    assert len(before) == 2 and sum(before[s] != after[s] for s in before) == 1
    assert content(a) == {("x/1.go", "uno"), ("x/2.go", "two"), ("y/3.go", "three")}
    assert content(a, 0) == {("x/1.go", "one"), ("x/2.go", "two"), ("y/3.go", "three")}


def test_writers_of_different_shards_both_stay(spark, two):
    a, b, _ = two
    first, second = Change(a), Change(b)
    first.replace_paths("symbols", rows(spark, ("x/1.go", "uno")), paths(spark, "x/1.go"))
    second.replace_paths("symbols", rows(spark), paths(spark, "y/3.go"))
    first.append("hits", spark.createDataFrame([(1,)], "id long"))
    second.append("hits", spark.createDataFrame([(2,)], "id long"))
    assert first.commit() == 1 and second.commit() == 2
    assert content(a) == {("x/1.go", "uno"), ("x/2.go", "two")} == content(b)
    assert sorted(r.id for r in a.table("hits").collect()) == [1, 2]
    assert content(a, 1) == {("x/1.go", "uno"), ("x/2.go", "two"), ("y/3.go", "three")}


def test_writers_of_one_shard_run_again(spark, two):
    a, b, _ = two
    late = Change(b)
    late.replace_paths("symbols", rows(spark, ("x/2.go", "late")), paths(spark, "x/2.go"))
    calls = []

    def change(c):
        calls.append(c.base)
        if len(calls) == 1:
            Change.commit(late)  # another writer comes first
        c.replace_paths("symbols", rows(spark, ("x/1.go", "uno")), paths(spark, "x/1.go"))

    a.update(change)
    assert calls == [0, 1] and content(a) == {("x/1.go", "uno"), ("x/2.go", "late"), ("y/3.go", "three")}
    stale = Change(a)
    stale.table("symbols")
    b.update(lambda c: c.replace_paths("symbols", rows(spark), paths(spark, "y/3.go")))
    stale.append("hits", spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Conflict):
        stale.commit()
    assert a.table("hits").count() == 0


def test_the_same_version_is_created_once(spark, two):
    a, b, root = two
    assert a.put("x", "versions", "77") and not b.put("y", "versions", "77")
    assert (root / "s" / "versions" / "77").read_text() == "x" and not [p for p in (root / "s" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_whole_tables_and_shards(spark, two):
    a, b, _ = two
    a.update(lambda c: c.replace("symbols", rows(spark, ("z/9.go", "nine"))))
    assert content(a) == {("z/9.go", "nine")}
    whole, part = Change(a), Change(b)
    part.replace_paths("symbols", rows(spark, ("x/1.go", "new")), paths(spark))
    whole.replace("symbols", rows(spark, ("w/1.go", "w")))
    assert part.commit() == 2
    with pytest.raises(Conflict):
        whole.commit()
    assert content(a) == {("z/9.go", "nine"), ("x/1.go", "new")}
    assert a.update(lambda c: None) is None and a.version() == 2
