"""A stored code base and the questions asked of it.

Tables are versioned folders of Parquet (``sources.tables``): rows of files are kept by
shards of their folders, so a changed file writes its shard of each table anew and no
other; what is derived from all rows (links of interfaces, numbers of callers) is in narrow
tables of its own. Several writers may work at once. Files are compared by their times
first, and only new and changed ones are read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import hash_embedder
from tessera.operators import encode, graph, parse, risk, search, segments, store, telemetry
from tessera.operators import lines as L
from tessera.sources import events, files, specs
from tessera.sources.tables import Change, Tables

#: Derived tables, and those with the path by which they are dealt to shards.
EXTRA = {
    "contents": "path string, content string", "imports": "path string, import string", "blame": "path string, line int, commit string, subject string", "hits": "id long",
    "links": store.SCHEMAS["calls"], "fan_in": "full string, callers double", "vec_symbols": "symbol_id long, embedding array<float>, path string",
}
DIMENSION = 64
#: States of the search index that are kept.
KEPT_STATES = 3


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = Tables(spark, self.root, store.SCHEMAS | EXTRA)
        self.at, self.system = self.tables.at, self.tables.system

    # ---- tables

    def versions(self) -> list[int]:
        return self.tables.versions()

    def version(self) -> int:
        return self.tables.version()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the data model; calls have the links of interfaces, and symbols the number of their callers."""
        version = self.version() if version is None else version
        read = lambda n: self.tables.table(n, version)
        if name == "calls":
            return read("calls").unionByName(read("links"))
        if name == "symbols":
            rows = read("symbols")
            ranked = rows.withColumn("_full", graph.full_name()).join(read("fan_in").withColumnRenamed("full", "_full"), "_full", "left")
            return ranked.withColumn("relevance", F.coalesce("callers", F.lit(0.0))).select(*rows.columns)
        return read("vec_symbols").drop("path") if name == "vec_symbols" else read(name)

    def save(self, changed: dict[str, DataFrame]) -> None:
        """The next version, with whole tables in place of theirs."""

        def change(c: Change) -> None:
            for name, rows in changed.items():
                c.replace(name, rows)

        self.tables.update(change)

    def add(self, name: str, rows: DataFrame) -> None:
        """More rows of a table, as a part of their own."""
        self.tables.update(lambda c: c.append(name, rows))

    # ---- filling

    def index(self, source: str, ignore: list[str] | None = None, rules: list[parse.ArchRule] | None = None) -> dict[str, int]:
        """Parse new and changed files of a tree, drop those that are gone; counts of what was done.

        A file whose time is as it was is not opened; one of another time is read, and parsed if its hash differs.
        """
        return self.tables.update(lambda c: self.change(c, source, ignore, rules))

    def change(self, c: Change, source: str, ignore: list[str] | None, rules: list[parse.ArchRule] | None) -> dict[str, int]:
        present = graph.cut(files.listed(self.spark, source, ignore, manifests=True))
        known = c.table("file_index").select("path", "hash", "mtime")
        moved = graph.cut(present.join(known.select("path", "mtime"), ["path", "mtime"], "left_anti"))
        gone = graph.cut(store.orphans(known, present))
        read = graph.cut(files.contents(self.spark, source, moved))
        old = known.select("path", F.col("hash").alias("_h"))
        action = F.when(F.col("_h").eqNullSafe(F.col("hash")), "touch").otherwise("parse")
        actions = graph.cut(read.join(old, "path", "left").select("path", "hash", "mtime", action.alias("action")))
        counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()} | {"gone": gone.count()}
        same = present.count() - sum(v for k, v in counts.items() if k != "gone")
        counts |= {"skip": same} if same else {}
        if c.base >= 0 and set(counts) <= {"skip", "gone"} and not counts["gone"]:
            return counts  # nothing to do
        fresh = graph.cut(read.join(actions.where("action = 'parse'").select("path"), "path", "left_semi"))
        parsed = graph.cut(parse.parse(fresh))
        stale = graph.cut(fresh.select("path").union(gone))
        symbols = graph.cut(parse.rows_of(parsed, "symbol").withColumn("id", store.symbol_id(F.col("path"), F.col("name"), F.col("start_byte"))))
        calls = graph.cut(store.insert_ignore(parse.rows_of(parsed, "call")))
        embed = hash_embedder(DIMENSION)
        text = F.concat_ws(" ", "name", F.when(F.coalesce("doc", F.lit("")) != "", F.col("doc")).otherwise(F.col("signature")))
        c.replace_paths("file_index", actions.select("path", "hash", "mtime"), actions.select("path").union(gone))
        for name, rows in {
            "symbols": symbols,
            "calls": calls,
            "flows": parse.rows_of(parsed, "flow"),
            "imports": parse.rows_of(parsed, "import"),
            "contents": fresh.select("path", "content"),
            "vec_symbols": symbols.select(F.col("id").alias("symbol_id"), embed(text).alias("embedding"), "path"),
        }.items():
            c.replace_paths(name, rows, stale)
        c.replace_paths("dependencies", files.gomod(fresh).unionByName(files.npm(fresh)), stale, "manifest")
        if rules:
            c.replace_paths("violations", parse.audit(fresh, rules), stale, "file_path")
        # of all files, in narrow columns
        every = store.clear_paths(c.table("symbols"), stale).unionByName(symbols, allowMissingColumns=True)
        written = store.clear_paths(c.table("calls"), stale).unionByName(calls)
        go = graph.cut(every.where(F.col("path").endswith(".go")))
        links = self.spark.createDataFrame([], store.SCHEMAS["calls"])
        if not go.isEmpty():
            found = graph.interface_edges(go, written)
            links = graph.cut(store.insert_ignore(found).join(written.select(*store.EDGE_KEY), store.EDGE_KEY, "left_anti"))
        c.replace("links", links)
        c.replace("fan_in", graph.indegree(written.unionByName(links.select(*written.columns))).select(F.col("callee").alias("full"), F.col("indegree").cast("double").alias("callers")))
        return counts

    def ingest(self, path: str, environment: str = "") -> None:
        """Add usage lines to the usage table, and their hits to the symbols."""
        found = telemetry.resolve_usage(events.usage(self.spark, path), self.table("symbols")).withColumn("environment", F.lit(environment))
        rollup = telemetry.usage_rollup(found).select("symbol_id", "environment", "last_used", "hit_count")

        def change(c: Change) -> None:
            merged = graph.cut(telemetry.merge_usage(c.table("symbol_usage"), rollup))
            hits = merged.groupBy(F.col("symbol_id").alias("id")).agg(F.sum("hit_count").alias("value"))
            c.replace("symbol_usage", merged)
            self.scored(c, lambda s: store.bulk_update(s, hits, ["id"], "runtime_hits"))

        self.tables.update(change)

    def scored(self, c: Change, rescore) -> None:
        """Symbols with new scores, in their shards: all of these are written."""
        now = c.table("symbols")
        c.replace_paths("symbols", rescore(now), now.select("path").distinct())

    def ingest_tests(self, path: str) -> None:
        rows = telemetry.test_results(events.test_events(self.spark, path)).withColumn("project", F.col("package"))
        self.add("test_results", rows)

    def score_churn(self, commits: DataFrame) -> None:
        """Churn of symbols from (commit, ts, path)."""
        scores = graph.cut(graph.churn(commits).select("path", F.col("score").alias("value")))
        self.tables.update(lambda c: self.scored(c, lambda s: store.bulk_update(s, scores, ["path"], "churn_score")))

    def score_pagerank(self) -> None:
        full = graph.full_name()
        nodes = self.table("symbols").select(full.alias("node")).distinct()
        edges = self.table("calls").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "line", "link_type")
        ranks = graph.pagerank(nodes, edges).withColumnRenamed("rank", "pagerank")
        self.tables.update(lambda c: self.scored(c, lambda s: s.withColumn("node", full).drop("pagerank").join(ranks, "node", "left").select(*s.columns)))

    # ---- questions

    def search_state(self) -> segments.Segments:
        """The search index of the symbols as they are: what changed since its last state is added to it."""
        shards = self.tables.manifest(self.version()).get("symbols", {})
        name = hashlib.sha256(json.dumps(shards, sort_keys=True).encode()).hexdigest()[:32]
        self.system.mkdirs(self.at("indexes", "states"))
        states = sorted((f.getModificationTime(), f.getPath().getName()) for f in self.system.listStatus(self.at("indexes", "states")) if not f.getPath().getName().startswith("."))
        if any(n == name for _, n in states):
            return segments.Segments.from_json(json.loads(self.tables.text("indexes", "states", name))["index"])
        columns = list(search.COLUMN_WEIGHTS)
        rows = lambda folders: self.tables.read("symbols", folders).select("id", *columns)
        state, before = segments.Segments(f"{self.root}/indexes", tuple(columns)), {}
        if states:
            last = json.loads(self.tables.text("indexes", "states", states[-1][1]))
            folders = [f for v in last["shards"].values() for f in v]
            if all(self.system.exists(self.at(*f.split("/"))) for f in folders):
                state, before = segments.Segments.from_json(last["index"]), last["shards"]
        # of shards that were written since; a row whose text is as it was is left alone
        changed = [s for s in {*shards, *before} if shards.get(s) != before.get(s)]
        old = graph.cut(rows([f for s in changed for f in before.get(s, [])]))
        new = graph.cut(rows([f for s in changed for f in shards.get(s, [])]))
        key = ["id", *columns]
        differ = lambda a, b: graph.cut(a.join(b.withColumns({f"_{c}": F.col(c) for c in key}).drop(*key), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti"))
        added, removed = differ(new, old), differ(old, new)
        state = state.changed(added, removed)
        self.tables.put(json.dumps({"index": state.to_json(), "shards": shards}), "indexes", "states", name)
        self.forget([n for _, n in states][: 1 - KEPT_STATES])
        return state

    def forget(self, names: list[str]) -> None:
        """Remove old states of the search index, and the parts that no state names."""
        for n in names:
            self.system.delete(self.at("indexes", "states", n), False)
        if names:
            kept = [f.getPath().getName() for f in self.system.listStatus(self.at("indexes", "states")) if not f.getPath().getName().startswith(".")]
            states = [segments.Segments.from_json(json.loads(self.tables.text("indexes", "states", n))["index"]) for n in kept]
            named = {p.folder for s in states for p in (*s.segments, *s.removals)}
            for f in self.system.listStatus(self.at("indexes")):
                if f.getPath().getName() not in named | {"states"}:
                    self.system.delete(f.getPath(), True)

    def search_index(self) -> search.Stored:
        return self.search_state().stored(self.spark)

    def search(self, query: str, limit: int = 20, path_prefix: str = "", bump: bool = True) -> DataFrame:
        return self.search_all(query, limit, path_prefix, bump)[0]

    def search_all(self, query: str, limit: int = 20, path_prefix: str = "", bump: bool = True) -> tuple[DataFrame, DataFrame]:
        """Symbols by reciprocal ranks of text and vectors, and the notes with the text; found symbols get a hit."""
        s = store.symbols_of(self.table("symbols"), path_prefix=path_prefix)
        index = self.search_index()
        if path_prefix:
            index = search.Stored(index.postings.join(s.select("id"), "id", "left_semi"), index.lengths.join(s.select("id"), "id", "left_semi"))
        vectors = self.table("vec_symbols").withColumnRenamed("symbol_id", "id")
        if path_prefix:
            vectors = vectors.join(s.select("id"), "id", "left_semi")
        embed = lambda q: list(self.spark.range(1).select(hash_embedder(DIMENSION)(F.lit(q)).alias("v")).first().v)
        found, notes = search.search_all(index, s.select("id"), vectors, self.table("observations"), query, embed, limit)
        found = graph.cut(found)  # ``limit`` rows, read for the answer and for the hits
        if bump:
            self.add("hits", found.select("id"))
        return s.join(found, "id").select("name", "type", "path", "start_line", "end_line", F.round("rrf_score", 6).alias("score")).orderBy(F.desc("score"), "path", "name"), notes

    def symbols_with_hits(self) -> DataFrame:
        """Symbols with the hits of searches added to those of usage."""
        hits = self.table("hits").groupBy("id").agg(F.count("*").alias("_hits"))
        s = self.table("symbols")
        return s.join(hits, "id", "left").withColumn("runtime_hits", F.col("runtime_hits") + F.coalesce("_hits", F.lit(0))).select(*s.columns)

    def diagnose(self, log: str) -> DataFrame | None:
        """What is known of the first failure that a log names: symbol, last commit, risk, blast and a like place."""
        lines = L.of_texts(self.spark.createDataFrame([(0, log)], "doc_id int, text string")).lines
        similar = lambda name: self.search(name, 10, bump=False)
        return risk.hud(lines, self.table("symbols"), self.table("calls"), self.table("file_index"), self.table("blame"), similar)

    def impact(self, name: str, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """The symbol's risk row and its callers by distance."""
        full, path = store.resolve_name(self.table("symbols"), name)
        short = full.rsplit(".", 1)[-1] if not self.table("symbols").where(F.col("name") == name).count() else name
        row = risk.impact(self.table("symbols"), self.table("calls"), short, path, self.table("file_index"), max_depth=max_depth)
        return row, graph.blast_radius(self.table("calls"), sorted({full, short}), path, max_depth).orderBy("distance", "path", "caller")

    def predict(self, diff: str) -> DataFrame:
        lines = L.of_texts(self.spark.createDataFrame([(0, diff)], "doc_id int, text string")).lines
        return risk.predict_tests(lines, self.table("symbols"), self.table("calls")).select("name", "path", "start_line")

    def critical(self, limit: int = 20) -> DataFrame:
        failed = self.table("test_results").where("status = 'fail'")
        return graph.critical(self.table("symbols"), self.table("calls"), failed, limit).select("name", "path", "centrality", "fragility")

    def graph(self, name: str) -> str:
        full, _ = store.resolve_name(self.table("symbols"), name)
        around = graph.callees(self.table("calls"), full).unionByName(graph.callers(self.table("calls"), full, 50))
        return encode.mermaid(around, name)

    def twins(self, name: str) -> DataFrame:
        _, path = store.resolve_name(self.table("symbols"), name)
        return search.twins(self.table("symbols"), name, path).select("name", "path", "start_line")

    def flow(self, sink: str) -> DataFrame:
        return graph.flows_to(self.table("flows"), sink)

    def context(self, path: str) -> DataFrame:
        every = self.table("contents").select("path", F.size(F.split("content", "\n")).alias("loc"))
        return risk.file_context(every, self.table("symbols"), self.table("calls")).where(F.col("path") == path)

    def neighborhood(self, path: str) -> DataFrame:
        return graph.neighborhood(self.table("symbols"), self.table("calls"), self.table("imports"), path)

    def propagate(self, name: str, depth: int = 3) -> DataFrame:
        full, _ = store.resolve_name(self.table("symbols"), name)
        return graph.discover_tasks(self.table("symbols"), self.table("calls"), full, depth).orderBy("depth", "path", "line")

    def map(self, path_prefix: str = "") -> DataFrame:
        return store.map_by_file(self.table("symbols"), path_prefix).orderBy("path")

    def callers(self, name: str, cursor: str | None = None) -> tuple[DataFrame, str]:
        full, _ = store.resolve_name(self.table("symbols"), name)
        return store.page(graph.callers(self.table("calls"), full, None), cursor, ["caller", "path", "line", "link_type"])

    def read(self, pointer: str) -> str | None:
        """Text of a fragment pointer."""
        place = files.resolve_pointer(self.table("contents").withColumn("hash", F.sha2("content", 256)), self.table("symbols"), pointer).first()
        row = place and files.fragment(self.table("contents"), *place).first()
        return row.fragment if row else None

    def verify(self, version: int) -> DataFrame:
        """Symbols that changed since an earlier version."""
        old = self.table("symbols", version)
        key = F.concat_ws(":", "path", "name").alias("name")
        columns = [key, "structural_hash", "logic_hash"]
        return store.snapshot_diff(old.select(*columns), self.table("symbols").select(*columns)).where("state <> 'unchanged'").orderBy("name")

    def audit(self, rules: list[parse.ArchRule]) -> DataFrame:
        return parse.audit(self.table("contents"), rules)

    def structural(self, pattern: str, inside: str = "", has: str = "") -> DataFrame:
        return parse.structural_search(self.table("contents"), pattern, inside, has).orderBy("path", "line")

    def gain(self, period: str = "daily") -> DataFrame:
        return {"summary": telemetry.summary, "daily": telemetry.daily, "weekly": telemetry.weekly, "monthly": telemetry.monthly, "commands": telemetry.by_command, "recent": telemetry.recent}[period](self.table("commands"))

    def track(self, commands: DataFrame) -> None:
        self.add("commands", telemetry.prepare(store.conform(commands, store.schema("commands"))))

    def condense(self, text: str, command: list[str] | None = None, folder: str | None = None) -> list[str]:
        """Output of a command through the pipeline that serves it."""
        spec = L.find_spec(specs.load(folder), *((command[0], command[1:]) if command else ("*", [])))
        s = L.of_texts(self.spark.createDataFrame([(0, text)], "doc_id int, text string"))
        return [r.line for r in (spec.run(s) if spec else s).lines.orderBy("line_no").collect()]
