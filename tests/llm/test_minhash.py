"""MinHash near-duplicates against all pairs of whole sets."""

import random
from collections import Counter

import pytest

from tessera.llm import minhash

SPACE = " \t\n\v\f\r"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACE else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(data, percent=85):
    found = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= percent * (len(found[i]) + len(found[j]) - both):
                root[of(i)] = of(j)
    out = []
    for i, (doc_id, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if of(j) == of(i) and data[j][0] is not None]
        name = min(ids, default=None)
        out.append((doc_id, len(found[i]), name, doc_id == name))
    return sorted(out, key=str)


def check(spark, data):
    docs = spark.createDataFrame([(i, t, "x", 1, b"z") for i, t in data], "doc_id long, text string, part string, n int, sig binary").repartition(3)
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == brute(data)


def near_copies(seed, groups, size, edits):
    """Groups of texts that differ in some words from a text of their own, many with shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    line = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 160))] + (line if rng.random() < 0.5 else [])
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text[rng.randint(0, 3) :]))
    return [(i, t) for i, t in enumerate(out)]


def test_odd_rows(spark):
    data = near_copies(1, 3, 6, 2)
    data += [(None, None), (200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE "), (205, "one two three four"), (206, "one two three four five"), (None, "only words without a number here now"), (None, "only words without a number here now"), (3, "again and again and again"), (3, "again and again and again"), (207, "w " * 30_000), (208, "w " * 4), (209, "Ä ä a b c d e"), (210, "ä ä a b c d e"), (211, "k" * 100_000)]
    check(spark, data)


@pytest.mark.parametrize(("small", "chunk"), [(64, 1024), (2, 3)])
def test_groups_in_cells(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    check(spark, near_copies(2, 5, 25, 3))


def test_one_large_group(spark):
    """Best matches and the pairs across components of a list of more sets than a chunk; pairs grow with the sets and not with their square."""
    data = near_copies(5, 1, 400, 2)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thresholds():
    assert [minhash.least_agreements(n, 85) for n in (40, 128)] == [17, 79] and minhash.least_agreements(40, 100) == 40 and minhash.least_agreements(40, 1) == 1


def test_signatures_agree_as_sets_do():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    words = [f"w{rng.random()}" for _ in range(3000)]
    texts = [" ".join(words[:2000]), " ".join(words[500:2500]), " ".join(words[2000:])]
    value, first = minhash.sets(pa.array(texts), 1)
    assert Counter(np.diff(first).tolist()) == {2000: 2, 1000: 1}
    signs = minhash.signatures(value, first[:-1])
    same = lambda a, b: (signs[a] == signs[b]).mean()
    assert abs(same(0, 1) - 0.6) < 0.13 and same(0, 2) == 0
