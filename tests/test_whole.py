"""Registered queries over all of their input, on fixtures that a cut would change."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from tessera.plans import registry


def test_embed_reads_texts(spark, tmp_path):
    head = "word " * 200
    texts = [head + "alpha beta", head + "gamma delta delta", "", None, "é " * 500 + "Straße straße"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [[w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in texts]
    slot = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for ws in words for w in ws}
    got = {i: [0.0] * 16 for i in range(len(texts))}
    for r in registry.QUERIES["embed"](spark, str(tmp_path)).collect():
        got[r.doc_id][r.slot] = r.weight
    for i, ws in enumerate(words):
        count = Counter(slot[w] for w in ws)
        norm = math.sqrt(sum(n * n for n in count.values()))
        assert got[i] == pytest.approx([count[k] / norm if norm else 0.0 for k in range(16)], abs=6e-4)
    assert got[0] != got[1]


def test_json_schema_reads_every_event(spark, tmp_path):
    props = [(1, 1, '{"k": 1}'), (2, 1, '{"k": 2}'), (3, 1, '{"k": "x", "z": [1]}'), (4, 2, '{"k": null}'), (5, 2, "[]")]
    spark.createDataFrame(props, "event_id long, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = Counter(tuple(r) for r in registry.QUERIES["json_schema"](spark, str(tmp_path)).select("doc_id", "line").collect())
    want = {1: ["{", "  k: number", "}", "{", "  k: string", "  z: [number]", "}"], 2: ["{", "  k: null", "}", "[]"]}
    assert got == Counter((u, line) for u, rows in want.items() for line in rows)


def parts(spark, folder, keys):
    rows = [(k, k % 9 + 1, "b", "n", "t") for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")


def calls(spark, folder, pairs):
    """Two line items of an order for each call (caller, callee, line), no hierarchy links."""
    rows = [(i, line + j, k, "A") for i, (a, b, line) in enumerate(pairs) for j, k in enumerate((a, b))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")


def test_diffs_of_every_part(spark, tmp_path):
    parts(spark, tmp_path, [1, 2, 10])
    calls(spark, tmp_path, [(10, 2, 4)])
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert len(run("git_diff_parse")) == 6
    assert run("diff_symbols") == [(1,), (2,), (10,)]
    assert run("predict_tests") == [("sym10", "/pkg3/f10_test.go")]


def test_every_call_counts(spark, tmp_path):
    parts(spark, tmp_path, [1, 2, 5, 10])
    calls(spark, tmp_path, [(2, 1, 2), (5, 2, 3), (10, 5, 4)])
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("unused_symbols") == []
    assert {r[0]: r[3:] for r in run("file_context")} == {"/pkg1/f1.go": (1, 3), "/pkg2/f2.go": (1, 2), "/pkg5/f5.go": (1, 1), "/pkg3/f10_test.go": (0, 0)}


def brute_ranks(nodes, links):
    out = {a: [b for x, b in links if x == a] for a in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(500):
        loose = sum(r for n, r in rank.items() if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (loose / len(nodes) + sum(rank[a] / len(out[a]) for a in nodes if n in out[a])) for n in nodes}
    return rank


def test_depths_are_the_defaults(spark, tmp_path):
    keys = [3, 14, 15, 16, 17, 100]
    parts(spark, tmp_path, keys)
    pairs = [(14, 3), (15, 14), (16, 15), (17, 16), (100, 17)]
    calls(spark, tmp_path, [(a, b, 1) for a, b in pairs])
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("affected_tests") == [(100, "sym100", "/pkg2/f0_test.go")]
    assert {r[0]: r[2] for r in run("blast_radius")} == {"sym14": 1, "Sym15": 2, "sym16": 3}
    name = lambda k: f"{'sym' if k % 3 else 'Sym'}{k}"
    want = {name(k): r for k, r in brute_ranks(keys, pairs).items()}
    assert dict(run("pagerank")) == pytest.approx(want, abs=1e-5)


def test_pagerank_converges_on_a_cycle(spark, tmp_path):
    """Ranks that five steps leave far from their limit."""
    keys = [1, 2, 4, 5, 7]
    parts(spark, tmp_path, keys)
    pairs = [(1, 2), (2, 4), (4, 1), (5, 1), (7, 5)]
    calls(spark, tmp_path, [(a, b, 1) for a, b in pairs])
    want = {f"sym{k}": r for k, r in brute_ranks(keys, pairs).items()}
    rank = lambda q: {r.node: r["rank"] for r in registry.QUERIES[q](spark, str(tmp_path)).collect()}
    assert rank("pagerank") == pytest.approx(want, abs=1e-5)


def test_ripple_goes_on_until_no_node_is_new(spark, tmp_path):
    """Calls and hierarchy links of every depth, a cycle and a null end; what is not linked stays out."""
    chain = list(range(3, 16))
    rows = [(b, a, "A") for a, b in zip(chain, chain[1:], strict=False)] + [(15, 40, "N"), (41, 40, "A"), (15, 42, "A"), (3, 41, "A"), (50, 51, "R"), (None, 14, "A")]
    items = [(i, 1 + j, k, flag) for i, (a, b, flag) in enumerate(rows) for j, k in enumerate((a, b))]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["ripple"](spark, str(tmp_path))
    number = lambda name: name and int(name[3:])
    want = {(b, a): i for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False), 1)} | {(None, 14): 12, (15, 40): 13, (41, 40): 14, (3, 41): 15}
    assert {(number(r.caller), number(r.callee)): r.depth for r in df.collect()} == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert compare(con, df, registry.ORACLES["ripple"]) == len(want)


def test_interfaces_of_every_line(spark, tmp_path):
    items = [(1, 1, 7, "A", "2020-01-01"), (1, 2, 8, "A", "2020-01-01"), (2, 1, 8, "A", "2020-01-01"), (2, 3, 9, "N", "2020-01-01")]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_shipdate string").withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "high"), (2, "low")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select("type", "interface").collect())
    assert run("resolve_interfaces") == [(8, "high")]
