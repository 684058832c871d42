"""The pipeline stage by stage, each against brute force on its own input."""

import re
import zlib

import corpus_pipeline
from test_layout import check_packing
from test_scans import brute_hits, brute_print, brute_secrets
from tessera.llm.scratch import materialize

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]

    def step(name, before):
        out = materialize(stages[name](spark, before, SF))
        if name != "best_fit_packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        return out, [tuple(r) for r in out.collect()]

    raw = {r.doc_id: r for r in docs.collect()}
    one, rows = step("quality_classifier", docs)
    kept = {r[0] for r in rows}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in kept for i in held if labels[i] == 1) >= 0.98 * sum(labels[i] == 1 for i in held) and len(kept) < len(raw)

    two, rows = step("simhash_near_dedup", one)
    prints = {i: brute_print(raw[i].text) for i in kept}
    group = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    assert {r[0] for r in rows} == set(group.values()) and len(rows) == len(set(group.values()))

    three, rows = step("benchmark_decontamination", two)
    hit = {h[0] for h in brute_hits([(i, raw[i].text) for i in set(group.values())], bench) if h[-1]}
    assert {r[0] for r in rows} == set(group.values()) - hit

    four, rows = step("secret_scan", three)
    for r in rows:
        text, n = r[columns.index("text")], r[columns.index("n_chars")]
        assert n == len(text) and not any(k == "access" or k == "hex" for k, _, _ in brute_secrets(text))
        if not brute_secrets(raw[r[0]].text) and not re.search("PRIVATE KEY|eyJ|Bearer |://", raw[r[0]].text):
            assert text == raw[r[0]].text
    _, rows = step("best_fit_packing", four)
    packed = stages["best_fit_packing"](spark, four, SF).collect()
    check_packing(packed, [(r[0], r[1]) for r in [tuple(x) for x in four.select("doc_id", "text").collect()]])


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "token=abcdefgh " * 3, "en", None, 45), (2, "token=abcdefgh " * 3, "en", None, 45), (3, "w " * 50_000, None, "s", 1), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == docs.columns
        assert out.count() <= len(data) + 30
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF).collect())
    assert kept == [(False, 1), (False, 2), (False, 3)]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
