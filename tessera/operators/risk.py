"""Composite scores of changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, store
from tessera.sources.diffs import changed_ranges


def score(blast: Column, cognitive: Column, churn: Column, test_gap: Column, lines: Column, pagerank: Column, bugfixes: Column) -> Column:
    """0 to 1; ``test_gap`` is 1 if there is no companion test."""
    base = (
        0.20 * F.least(F.lit(1.0), F.log1p(blast) / F.log1p(F.lit(500.0)))
        + 0.35 * F.least(F.lit(1.0), cognitive / 100.0)
        + 0.15 * churn
        + 0.15 * test_gap
        + 0.05 * F.least(F.lit(1.0), lines / 500.0)
        + 0.10 * pagerank
    )
    return F.least(F.lit(1.0), base * (1 + 0.2 * bugfixes))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "Critical").when(score >= 0.5, "High").when(score >= 0.2, "Medium").otherwise("Low")


def public_export(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def companion(path: Column) -> Column:
    """Path of the test file that goes with a source file; null for other kinds."""
    swap = lambda end, to: F.regexp_replace(path, end, to)
    return F.when(path.endswith(".go"), swap("\\.go$", "_test.go")).when(path.endswith(".py"), swap("\\.py$", "_test.py")).when(path.endswith(".ts"), swap("\\.ts$", ".test.ts"))


def test_gap(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (path, ...) with test_gap 1.0 where no companion is in ``files`` (path)."""
    tests = files.select(F.col("path").alias("_t")).distinct()
    return rows.withColumn("_c", companion(F.col("path"))).join(tests, F.col("_c") == F.col("_t"), "left").withColumn("test_gap", F.when(F.col("_t").isNull(), 1.0).otherwise(0.0)).drop("_c", "_t")


def historical_risk(observations: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """Distinct bug-fix notes over the newest hits of each search term."""
    found = None
    for t in terms:
        hit = observations.where(F.contains(F.lower("content"), F.lit(t.lower()))).orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id")
        found = hit if found is None else found.union(hit)
    return found.agg(F.countDistinct("id").alias("bugfixes"))


def impact(symbols: DataFrame, edges: DataFrame, name: str, path: str, files: DataFrame, bugfixes: int = 0, max_depth: int = 3) -> DataFrame:
    """The symbol's row with blast, test_gap, risk and level; reference callers do not count."""
    full = graph.full_name()
    own = symbols.where(((F.col("name") == name) | (full == name)) & (F.col("path") == path)).limit(1)
    names = own.select("name", full.alias("f")).collect()  # one row
    known = [name, *([names[0]["name"], names[0]["f"]] if names else [])]
    radius = graph.blast_radius(edges, sorted(set(known)), path, max_depth).where("link_type <> 'reference'")
    blast = radius.agg(F.count("*").alias("blast"))
    rows = test_gap(own, files).crossJoin(F.broadcast(blast))
    cognitive = F.coalesce(F.from_json("metrics_json", store.METRICS)["cognitive"], F.lit(0))
    value = score(F.col("blast"), cognitive, F.col("churn_score"), F.col("test_gap"), F.col("end_line") - F.col("start_line") + 1, F.col("pagerank"), F.lit(bugfixes))
    return rows.withColumn("risk", value).withColumn("level", level(F.col("risk")))


def predict_tests(diff: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Tests that the symbols under a diff reach, one traversal for all of them."""
    touched = store.in_ranges(symbols, changed_ranges(diff))
    return graph.tests_reaching(symbols, edges, touched).dropDuplicates(["path", "name"])


def over_threshold(diff: DataFrame, symbols: DataFrame, risks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Symbols under a diff whose risk (name, path, risk) is over the threshold."""
    return store.in_ranges(symbols, changed_ranges(diff)).join(risks, ["name", "path"]).where(F.col("risk") > threshold)


def edit_cost(loc: Column, files: Column, cascade: Column, churn: Column) -> Column:
    """(tokens, risk, verdict) of an edit."""
    high = (files >= 5) | (churn >= 0.7) | (cascade >= 10)
    medium = (files >= 2) | (churn >= 0.3) | (cascade >= 4)
    risk = F.when(high, "high").when(medium, "medium").otherwise("low")
    verdict = F.when(high, "danger").when(medium, "caution").otherwise("safe")
    return F.struct((4 * loc + 250 * files).cast("long").alias("tokens"), risk.alias("risk"), verdict.alias("verdict"))


def bit(bits: Column, position: Column) -> Column:
    """The bit at a position of a bitmap, as 0 or 1."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)).cast("int") % 2


def reach_sets(links: DataFrame, max_depth: int) -> DataFrame:
    """(root, page, bits): of each node of ``links`` (src, dst: numbers) all that ``max_depth`` steps reach, as bitmaps of pages of numbers."""
    first = graph.cut(links.groupBy(F.col("src").alias("root"), F.bitmap_bucket_number("dst").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("dst")).alias("bits")))
    reached = first
    for _ in range(max_depth - 1):
        carried = links.join(reached, links["dst"] == reached["root"]).select(F.col("src").alias("root"), "page", "bits")
        reached = graph.cut(carried.unionByName(first).groupBy("root", "page").agg(F.bitmap_or_agg("bits").alias("bits")))
    return reached


def members(reached: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root, node) of the members of ``reached`` that are ``wanted`` (node): what bitmaps of both have in common, read out."""
    page = F.bitmap_bucket_number("node")
    masks = wanted.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("node")).alias("mask"), F.min(F.col("node") - F.bitmap_bit_position("node")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for root, bits, mask, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                both = np.frombuffer(bits, np.uint8) & np.frombuffer(mask, np.uint8)
                nodes.append(np.flatnonzero(np.unpackbits(both, bitorder="little")) + base)
                roots.append(np.full(len(nodes[-1]), root))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(roots), pa.int64()), pa.array(np.concatenate(nodes), pa.int64())], ["root", "node"])

    return reached.join(masks, "page").select("root", "bits", "mask", "base").mapInArrow(run, "root long, node long")


def file_context(files: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """For each file (path, loc): symbols, churn, direct and transitive dependents, tests, edit cost.

    A file depends on another if a call in it has a callee there. Dependents are found
    for all files at once, level by level, as bitmaps of numbered files: a level moves a
    page of bits for each link and page, and no row for a pair of files.
    """
    named = edges.where("callee_path <> '' and callee_path <> path").select(F.col("callee_path").alias("a"), F.col("path").alias("b")).distinct()
    named = graph.cut(named)
    # numbers in place of paths: pairs of files are what the steps below are made of
    number = graph.cut(named.select(F.col("a").alias("path")).union(named.select("b")).distinct().withColumn("id", F.monotonically_increasing_id()))
    of = lambda c, name: number.select(F.col("path").alias(c), F.col("id").alias(name))
    links = graph.cut(named.join(of("a", "src"), "a").join(of("b", "dst"), "b").select("src", "dst"))
    direct = named.groupBy(F.col("a").alias("path")).agg(F.array_sort(F.collect_set("b")).alias("direct_dependents"))
    reached = reach_sets(links, max_depth)
    root = of("path", "root")
    own = F.when(F.col("page") == F.bitmap_bucket_number("root"), bit(F.col("bits"), F.bitmap_bit_position("root"))).otherwise(0)
    cascade = reached.groupBy("root").agg((F.sum(F.bitmap_count("bits")) - F.sum(own)).alias("transitive")).join(root, "root").select("path", "transitive")
    tests = number.where(F.col("path").rlike("(_test\\.go|_test\\.py|\\.test\\.ts)$")).select(F.col("id").alias("node"), F.col("path").alias("hint"))
    hints = members(reached, tests).where("root <> node").join(tests, "node").groupBy("root").agg(F.array_sort(F.collect_set("hint")).alias("test_hints")).join(root, "root").select("path", "test_hints")
    facts = symbols.groupBy("path").agg(F.count("*").alias("symbols"), F.max("churn_score").alias("churn"))
    out = files.join(facts, "path", "left").join(direct, "path", "left").join(cascade, "path", "left").join(hints, "path", "left")
    none = F.array().cast("array<string>")
    out = out.select("path", "loc", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("churn", F.lit(0.0)).alias("churn"), F.coalesce("direct_dependents", none).alias("direct_dependents"), F.coalesce("transitive", F.lit(0)).alias("transitive"), F.coalesce("test_hints", none).alias("test_hints"))
    return out.withColumn("edit_cost", edit_cost(F.col("loc"), F.size("direct_dependents"), F.col("transitive"), F.col("churn")))


def index_savings(files: Column, symbols: Column) -> Column:
    return 1500 * files + 100 * symbols


def predict_savings(tests: Column) -> Column:
    return 4000 + 500 * tests


def centrality_spike(before: DataFrame, after: DataFrame, growth: float = 0.2) -> DataFrame:
    """Symbols (name, path, relevance) whose relevance grew by more than ``growth``."""
    b = before.select("name", "path", F.col("relevance").alias("before"))
    return after.select("name", "path", F.col("relevance").alias("after")).join(b, ["name", "path"]).where(F.col("after") > F.col("before") * (1 + growth)).where("before > 0")


def diagnose(log: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, line, name, path) of the symbols around the failure lines of a log (line)."""
    from tessera.functions.strings import go_failure

    refs = log.select(go_failure(F.col("line")).alias("r")).where("r is not null").select("r.file", "r.line").distinct()
    tail = F.element_at(F.split("file", "/"), -1)
    s = symbols.withColumn("base", F.element_at(F.split("path", "/"), -1))
    return refs.withColumn("base", tail).join(s, "base").where(F.endswith("path", "file") & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))).select("file", "line", "name", "path")


def hud(log: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame, blame: DataFrame, similar: Callable[[str], DataFrame] | None = None) -> DataFrame | None:
    """One row on the first failure line of a log (line_no, line): failing_symbol, path, last_commit, risk_level, risk, blast, similar_path.

    ``blame``: (path, line, commit, subject) of source lines. ``similar`` finds places
    (path) like a symbol, best first. Facts that are not known are ``Unknown``, 0 or
    ``None``; None itself if the log names no place.
    """
    from tessera.functions.strings import era, go_failure

    ref = log.select("line_no", go_failure(F.col("line")).alias("r")).where("r is not null").orderBy("line_no").select("r.file", "r.line").first()
    if ref is None:
        return None
    spark = log.sparkSession
    base = spark.range(1).select(F.lit(ref.file).alias("file"), F.lit(ref.line).alias("line"))
    commit = blame.where(F.endswith(F.lit(ref.file), F.col("path")) | F.endswith(F.col("path"), F.lit(ref.file))).where(F.col("line") == ref.line).limit(1).select(F.concat("commit", F.lit(" ("), era(F.col("subject")), F.lit(")")).alias("last_commit"))
    at = diagnose(spark.createDataFrame([(f"    {ref.file}:{ref.line}:",)], "line string"), symbols).join(symbols.select("name", "path", "start_line"), ["name", "path"]).orderBy("start_line", "name").select("name", "path").first()
    if at is None:
        return base.join(commit, how="left").select(F.lit("Unknown").alias("failing_symbol"), F.col("file").alias("path"), F.coalesce("last_commit", F.lit("Unknown")).alias("last_commit"), F.lit("Unknown").alias("risk_level"), F.lit(0.0).alias("risk"), F.lit(0).cast("long").alias("blast"), F.lit("None").alias("similar_path"))
    row = impact(symbols, edges, at["name"], at.path, files, max_depth=1).select("risk", "level", "blast")
    near = similar(at["name"]).where(F.col("path") != at.path).limit(1).select(F.col("path").alias("similar_path")) if similar else spark.createDataFrame([], "similar_path string")
    # one row on each side
    return base.join(commit, how="left").join(row, how="left").join(near, how="left").select(F.lit(at["name"]).alias("failing_symbol"), F.lit(at.path).alias("path"), F.coalesce("last_commit", F.lit("Unknown")).alias("last_commit"), F.coalesce("level", F.lit("Unknown")).alias("risk_level"), F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("blast", F.lit(0)).cast("long").alias("blast"), F.coalesce("similar_path", F.lit("None")).alias("similar_path"))
