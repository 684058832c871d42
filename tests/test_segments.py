"""The segmented index against a full build, through changes and merges; and the ranked classes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, segments

COLUMNS = ("name", "doc")
DDL = "id long, name string, doc string"


def rows(seed, ids, n=30):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "rare", *["common"] * 6])
    return {i: (i, " ".join(word() for _ in range(rng.randint(0, 3))), " ".join(word() for _ in range(rng.randint(0, n)))) for i in ids}


def frame(spark, data):
    return spark.createDataFrame(list(data.values()), DDL)


def same(spark, index, data):
    table = frame(spark, data)
    whole = search.build_index(table, "id", list(COLUMNS))
    stored = index.stored(spark)
    key = lambda df: sorted(map(tuple, df.select("token", "id", "col", "pos").collect()))
    assert key(stored.postings) == key(whole)
    assert index.rows == len(data) and index.tokens == whole.count()
    for query in ("alpha beta", "rare", "comm*"):
        want = {r.id: round(r.relevance, 9) for r in search.bm25(whole, table.select("id"), query, {"name": 3.0}).collect()}
        assert {r.id: round(r.relevance, 9) for r in search.bm25(stored, table.select("id"), query, {"name": 3.0}).collect()} == want
    for word, weights in (("common", None), ("rare", {"name": 3.0}), ("absent", None)):
        want = [(r.id, round(r.relevance, 9)) for r in search.bm25(whole, table.select("id"), word, weights).orderBy("relevance", "id").limit(7).collect()]
        found, report = index.best(spark, word, 7, weights)
        assert [(r.id, round(r.relevance, 9)) for r in found.collect()] == want
        assert report.rows <= report.of_rows


def test_changes_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 3)
    data = rows(1, range(60))
    index = segments.Segments(str(tmp_path), COLUMNS).changed(frame(spark, data))
    same(spark, index, data)
    rng = random.Random(2)
    for step in range(6):
        old = {i: data[i] for i in rng.sample(sorted(data), 4)}
        new = rows(10 + step, [*list(old)[:3], 100 + step])  # three of them change, one goes, one comes
        index = index.changed(frame(spark, new), frame(spark, old))
        data = {i: r for i, r in data.items() if i not in old} | new
        assert segments.Segments.from_json(index.to_json()) == index
    same(spark, index, data)
    assert len(index.segments) < 7  # some were merged


def test_a_small_change_writes_little(spark, tmp_path):
    """One row in a hundred changes: about a hundredth of the postings is written, and no earlier file is touched."""
    data = rows(3, range(2000))
    index = segments.Segments(str(tmp_path), COLUMNS).changed(frame(spark, data))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    after = index.changed(frame(spark, rows(4, range(20))), frame(spark, {i: data[i] for i in range(20)}))
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert after.segments[0] == index.segments[0] and len(after.segments) == 2 and len(after.removals) == 1
    count = lambda part, table: spark.read.parquet(f"{tmp_path}/{part.folder}/{table}").count()
    assert count(after.segments[1], "postings") < 0.02 * count(after.segments[0], "postings")
    assert count(after.removals[0], "ids") == 20


def test_the_best_rows_without_reading_all(spark, tmp_path):
    """Of a frequent word only the classes are read that can hold one of the best."""
    data = {i: (i, "common" if i % 50 == 0 else "", " ".join(["common"] * (1 + i % 7) + ["filler"] * (i % 90))) for i in range(3000)}
    index = segments.Segments(str(tmp_path), COLUMNS).changed(frame(spark, data))
    for weights, most in ((search.COLUMN_WEIGHTS, 600), (None, 2900)):  # bounds are close for the weights that rows were classed by
        found, report = index.best(spark, "common", 10, weights)
        want = search.bm25(index.stored(spark), frame(spark, data).select("id"), "common", weights).orderBy("relevance", "id").limit(10)
        assert [r.id for r in found.collect()] == [r.id for r in want.collect()]
        assert report.of_rows == 3000 and report.rows < most and report.classes < report.of_classes
    for query in ("two words", "pre*", ""):
        with pytest.raises(ValueError):
            index.best(spark, query, 3)


def test_no_rows(spark, tmp_path):
    index = segments.Segments(str(tmp_path), COLUMNS).changed(spark.createDataFrame([], DDL))
    assert index.rows == 0 and index.best(spark, "x", 3)[0].count() == 0
    data = rows(5, range(3))
    index = index.changed(frame(spark, data))
    gone = index.changed(spark.createDataFrame([], DDL), frame(spark, data))
    assert gone.rows == 0 and gone.stored(spark).postings.where(F.col("id") >= 0).count() == 0


def test_a_token_of_a_row_is_dealt_once(spark, tmp_path):
    """Postings and ranks were two tables, each dealt anew; a row for each token of a row has both."""
    from tessera.operators import segments

    rows = spark.createDataFrame([(1, "a b a", "b"), (2, "", "c a"), (3, None, None)], "id long, x string, y string")
    made = segments.Segments(str(tmp_path / "i"), ("x", "y"))
    got = {(r.token, r.id): (r.length, r.counts, r.places) for r in made.packed(rows).collect()}
    assert got == {("a", 1): (4, [2, 0], [0, 2]), ("b", 1): (4, [1, 1], [1, 1 << 32]), ("c", 2): (2, [0, 1], [1 << 32]), ("a", 2): (2, [0, 1], [(1 << 32) + 1])}
    stored = made.changed(rows).stored(spark)
    assert {(r.token, r.id, r.col, r.pos) for r in stored.postings.collect()} == {("a", 1, "x", 0), ("b", 1, "x", 1), ("a", 1, "x", 2), ("b", 1, "y", 0), ("c", 2, "y", 0), ("a", 2, "y", 1)}
