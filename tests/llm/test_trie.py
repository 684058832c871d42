"""The conversation trie against a plain Python version, with blocks of any size, and running sums over split keys."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import scratch, trie

DDL = "conv_id long, turn long, role string, text string, c long, node string, depth int"


def brute(rows):
    said = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for key, of in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(key))))
        out.append((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 25), 500, 10**12 + 3]:
        for t in range(rng.choice([0, 1, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, t, 3, None]), rng.choice(["user", "assistant", None]), rng.choice(["é", "", None, "a", "bb"])))
    rows += [(7, i, "user", "same") for i in range(30)] + [(9, 0, "u", "x")] * 3 + [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 1), (3, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(trie, "PIECE", 32)
    rows = case(seed)
    data = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL).repartition(3)
    assert sorted((tuple(r) for r in trie.nodes(data, block).collect()), key=str) == brute(rows)


def test_many_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(c, 0, "user", "hello") for c in range(0, 500, 5)] + [(5, 1, "user", "more")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert sorted((tuple(r) for r in trie.nodes(data).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert trie.nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sums_of_a_key_split_over_tasks(spark):
    rows = [(1 if i % 3 else i, i % 50, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, w long").repartition(4)
    got = scratch.streamed_sums(df, "k", [F.col("o").desc(), F.col("w")], {"total": F.col("w"), "n": F.lit(1)})
    parts = got.where("k = 1").select("o", "w", "total", "n").collect()
    total = n = 0
    for r in sorted(parts, key=lambda r: (-r.o, r.w)):
        total, n = total + r.w, n + 1
        assert (r.total, r.n) == (total, n)
    assert n == 2000 and got.count() == 3000
