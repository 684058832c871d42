"""Simple paths by representative families against enumeration, and reach sets by bitmaps against a plain walk."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, paths, risk

EDGE = "caller string, callee string, path string, line int, callee_path string, link_type string"


def enumerated(edges, names, path, depth):
    out = set()
    level = {((c, p),): link for c, e, p, _, ep, link in edges if e in names and (path is None or ep in (path, ""))}
    found = {(t, link) for c, e, p, _, ep, link in edges if e in names and (path is None or ep in (path, "")) for t in [((c, p),)]}
    for d in range(1, depth + 1):
        out |= {(*t[-1], d, link) for t, link in found}
        level = {t for t, _ in found}
        found = {((*t, (c, p)), link) for t in level for c, e, p, _, ep, link in edges if e == t[-1][0] and (ep == t[-1][1] or (ep == "" and t[-1][1] != "")) and (c, p) not in t}
    return out


@pytest.mark.parametrize(("seed", "depth"), [(1, 3), (2, 4), (3, 6), (4, 5)])
def test_as_enumeration(spark, monkeypatch, seed, depth):
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.choice(["a.go", "b.go", ""])) for i in range(8)]
    edges = []
    for i in range(26):
        (c, p), (e, ep) = rng.choice(nodes), rng.choice(nodes)
        edges.append((c, e, p, i, rng.choice([ep, ep, ""]), rng.choice(["call", "implements"])))
    table = spark.createDataFrame(edges, EDGE)
    path = rng.choice([None, nodes[0][1]])
    got = {tuple(r) for r in graph.blast_radius(table, ["n0"], path, depth).collect()}
    assert got == enumerated(edges, {"n0"}, path, depth)


@pytest.mark.parametrize(("size", "left"), [(1, 1), (2, 2), (3, 2), (2, 3)])
def test_families_are_representative_and_small(size, left):
    rng = random.Random(size)
    universe = range(7)
    sets = [frozenset(rng.sample(universe, size)) for _ in range(60)]
    family = []
    for s in sets:
        paths.extended(family, left, s)
    assert len(family) <= math.comb(size + left, left)
    for q in itertools.chain.from_iterable(itertools.combinations(universe, n) for n in range(left + 1)):
        assert any(not s & set(q) for s in sets) == any(not s & set(q) for s in family)


def test_a_hub_keeps_a_bounded_family(spark):
    """2,000 paths meet in one node at each depth; what is kept of them is bounded by the depth alone."""
    rows = spark.range(2000).select(F.lit("hub").alias("caller"), F.lit("x").alias("path"), F.array("id", (F.col("id") * 7 % 501).alias("b")).alias("before"))
    kept = paths.family(rows, ["caller", "path"], 3, 2)
    assert 3 <= kept.count() <= math.comb(4, 2)
    assert paths.family(rows.withColumn("before", F.slice("before", 1, 1)), ["caller", "path"], 2, 1).count() == 2


def test_reach_sets(spark):
    rng = random.Random(8)
    links = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)}
    far = 1 << 33  # numbers of another partition lie on other pages
    links |= {(3, far + 5), (far + 5, far + 40_000), (far + 40_000, 7)}
    links = {(a, b) for a, b in links if a != b}
    table = spark.createDataFrame(sorted(links), "src long, dst long")
    nodes = sorted({x for e in links for x in e})
    for depth in (1, 3):
        want = set()
        for root in {a for a, _ in links}:
            level = {root}
            for _ in range(depth):
                level = {b for a, b in links if a in level}
                want |= {(root, b) for b in level}
        reached = risk.reach_sets(table, depth)
        assert {tuple(r) for r in risk.members(reached, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()} == want
        assert reached.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(want)
        own = reached.where(F.col("page") == F.bitmap_bucket_number("root")).select("root", risk.bit(F.col("bits"), F.bitmap_bit_position("root")).alias("b"))
        assert {r.root for r in own.where("b = 1").collect()} == {a for a, b in want if a == b}
