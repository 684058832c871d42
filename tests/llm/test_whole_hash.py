"""The hash that names a whole stretch, kept whole."""

import numpy as np

from tessera.llm import scratch, substrings


def test_stretches_keep_64_bits(spark):
    text = " ".join(f"word{i * i}" for i in range(200))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    buf = np.frombuffer(text.encode(), np.uint8)
    want = substrings.stretches(buf, np.array([0, len(buf)]), 200, 48)[4].view(np.int64)
    assert (np.abs(want) >= 2**32).any()
    listed = substrings.store(docs, substrings.Job(scratch.fresh_path(spark, "texts")))
    got = [r.u for r in listed.where("h is not null").orderBy("start").select("u").collect()]
    assert got == want.tolist()


def test_stretches_alike_in_32_bits_are_two_classes(spark):
    """Two stretches of one anchor whose names differ in their low bits only both have their windows compared."""
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 123, 260, np.uint8)).decode()
    other = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    docs = spark.createDataFrame([(i, other(90) + shared + other(90)) for i in range(2)], "doc_id long, text string").coalesce(1)
    job = substrings.Job(scratch.fresh_path(spark, "texts"))
    listed = substrings.store(docs, job).where("h is not null")
    # the top halves made equal: what is left of each name is what store() kept of its low half
    rows = listed.collect()
    assert listed.schema["u"].dataType.simpleString() == "bigint"
    alike = spark.createDataFrame([(r.part, r.row, r.start, r.n, r.h, r.u & 0xFFFFFFFF) for r in rows], listed.schema)
    named = lambda df: {(r.row, r.start + k) for r in substrings.candidates(df, job).collect() for k in range(r.length - 199)}
    assert named(alike) == named(listed) and len(named(alike)) >= 2 * (260 - 199)
