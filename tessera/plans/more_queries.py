"""Queries of single functions and of operators that answer one question: scores, twins, notes, tasks and string functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.operators import encode, graph, risk, search, store, telemetry
from tessera.operators import lines as L
from tessera.plans import adapters as A
from tessera.plans.adapters import COMMANDS_SQL, EDGES_SQL, LINES_SQL, OBSERVATIONS_SQL, SYMBOLS_SQL, USAGE_SQL
from tessera.plans.base import SEED, query, rounded, with_
from tessera.sources import sinks
from tessera.streaming import jobs

PATH = "/pkg3/f3.go"

# ---- relational store ---------------------------------------------------------------------------

VIOLATIONS_SQL = "SELECT o_orderpriority AS rule_id, o_orderstatus AS severity, 'm' || CAST(o_orderkey AS VARCHAR) AS message, 'f' || CAST(o_custkey % 20 AS VARCHAR) AS file_path, CAST(o_orderkey % 100 AS INTEGER) AS line FROM orders"


@query(f"SELECT * FROM ({VIOLATIONS_SQL}) WHERE file_path = 'f3'")
def violations_by_file(s, d):
    k = F.col("o_orderkey")
    rows = A.table(s, d, "orders").select(F.col("o_orderpriority").alias("rule_id"), F.col("o_orderstatus").alias("severity"), F.concat(F.lit("m"), k.cast("string")).alias("message"), F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("file_path"), (k % 100).cast("int").alias("line"))
    return store.violations_of(rows, "f3")


@query(f"SELECT DISTINCT name AS \"full\", path FROM ({SYMBOLS_SQL}) WHERE name = 'Sym{SEED}'")
def exact_name_resolution(s, d):
    return store.candidates(A.symbols(s, d), f"Sym{SEED}")


@query(f"SELECT caller, callee, path, line FROM ({EDGES_SQL}) WHERE callee = 'Sym{SEED}'")
def flows_to(s, d):
    flows = A.edges(s, d).select(F.col("caller").alias("source"), F.col("callee").alias("sink"), F.lit("argument").alias("type"), "path", "line")
    return graph.flows_to(flows, f"Sym{SEED}").select(F.col("source").alias("caller"), F.col("sink").alias("callee"), "path", "line")


@query("SELECT CAST(0 AS BIGINT) AS version, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 1, n_nationkey + 100 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, n_nationkey + 100 FROM nation WHERE n_regionkey = 1")
def transaction(s, d):
    """Three versions of a store: the third changes another table, and the first is still there."""
    from tessera.workspace import Workspace

    space = Workspace(s, f"{graph.shared_folder(s)}/store-{uuid.uuid4().hex}")
    nation = A.table(s, d, "nation")
    space.save({"hits": nation.select(F.col("n_nationkey").alias("id"))})
    space.save({"hits": nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("id"))})
    space.save({"imports": nation.select(F.col("n_name").alias("path"), F.lit("x").alias("import"))})
    parts = [space.table("hits", v).select(F.lit(v).cast("long").alias("version"), "id") for v in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


WRITERS = "SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN 'first ' || n_name WHEN n_regionkey = 1 THEN 'second ' || n_name ELSE n_name END AS snippet FROM nation"


@query(f"SELECT 'both' AS state, name, snippet FROM ({WRITERS}) UNION ALL SELECT 'between', name, CASE WHEN starts_with(snippet, 'first') THEN snippet ELSE name END FROM ({WRITERS})")
def two_writers(s, d):
    """Two writers change different files of one version; the later keeps what the earlier has committed."""
    from tessera.sources.tables import Change, Tables

    schemas = {"files": "path string, snippet string"}
    one, two = (Tables(s, root, schemas) for root in [f"{graph.shared_folder(s)}/store-{uuid.uuid4().hex}"] * 2)
    nation = A.table(s, d, "nation")
    rows = nation.select(F.concat_ws("/", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name").alias("path"), F.col("n_name").alias("snippet"), "n_regionkey")
    one.update(lambda c: c.replace_paths("files", rows.drop("n_regionkey"), rows.select("path")))
    first, second = Change(one), Change(two)
    for change, region, word in ((first, 0, "first "), (second, 1, "second ")):
        mine = rows.where(F.col("n_regionkey") == region)
        change.replace_paths("files", mine.select("path", F.concat(F.lit(word), "snippet").alias("snippet")), mine.select("path"))
    between, both = first.commit(), second.commit()
    seen = lambda state, v: one.table("files", v).select(F.lit(state).alias("state"), F.substring_index("path", "/", -1).alias("name"), "snippet")
    return seen("both", both).unionByName(seen("between", between))


FILES_NOW = "SELECT source || '/' || CASE WHEN doc_id % 7 = 2 THEN 'moved-' ELSE '' END || CAST(doc_id AS VARCHAR) AS path, md5(coalesce(text, '') || CAST(doc_id AS VARCHAR)) AS hash FROM documents WHERE doc_id % 7 <> 4"
FEED_SQL = "SELECT source || '/' || CASE WHEN doc_id % 7 = 2 THEN 'moved-' ELSE '' END || CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 7 WHEN 1 THEN 'change' WHEN 2 THEN 'rename' WHEN 4 THEN 'delete' ELSE 'add' END AS op, CASE WHEN doc_id % 7 = 2 THEN source || '/' || CAST(doc_id AS VARCHAR) END AS old_path FROM documents WHERE doc_id % 7 IN (1, 2, 4, 5)"


def file_states(s, d):
    """Files of documents before and after some were added, changed, deleted and renamed."""
    k, text = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    docs = A.table(s, d, "documents")
    path = lambda mark: F.concat("source", F.lit("/"), mark, F.col("doc_id").cast("string")).alias("path")
    content = lambda end: F.md5(F.concat(text, F.col("doc_id").cast("string"), end)).alias("hash")
    before = docs.where(k != 5).select(path(F.lit("")), content(F.when(k == 1, "old").otherwise("")))
    return before, docs.where(k != 4).select(path(F.when(k == 2, "moved-").otherwise("")), content(F.lit("")))


@query(FEED_SQL)
def change_feed(s, d):
    from tessera.streaming import feed

    return feed.changes(*file_states(s, d)).select("path", "op", "old_path")


@query(FILES_NOW)
def shadow_index(s, d):
    """A table follows the feed in batches, and is as the files are; the last batch is given to it once more."""
    from tessera.sources.tables import Tables
    from tessera.streaming import feed

    root = f"{graph.shared_folder(s)}/shadow-{uuid.uuid4().hex}"
    tables = Tables(s, f"{root}/store", {"files": "path string, hash string"})
    before, now = file_states(s, d)
    tables.update(lambda c: c.replace_paths("files", before, before.select("path")))
    feed.changes(before, now).repartition(3).write.json(f"{root}/feed")
    fresh = lambda rows: rows.select("path", F.col("after").alias("hash"))
    for checkpoint in ("first", "again"):  # a stream that has lost its checkpoint gives all batches again
        feed.shadow(s, f"{root}/feed", tables, "files", fresh, f"{root}/{checkpoint}", files=2).awaitTermination()
    return tables.table("files")


RESOLVED = f"SELECT {A.name_sql('(user_id % 500 + 1)')} AS symbol_name, CASE WHEN user_id % 2 = 0 THEN '' ELSE {A.path_sql('(user_id % 500 + 1)')} END AS symbol_path FROM events"


@query(f"SELECT id AS symbol_id, count(*) AS n FROM ({RESOLVED}) u JOIN ({SYMBOLS_SQL}) s ON s.name = u.symbol_name AND (u.symbol_path = '' OR u.symbol_path = s.path) GROUP BY 1")
def resolve_usage(s, d):
    k = F.col("user_id") % 500 + 1
    usage = A.table(s, d, "events").select(A.symbol_name(k).alias("symbol_name"), F.when(F.col("user_id") % 2 == 0, "").otherwise(A.symbol_path(k)).alias("symbol_path"))
    return telemetry.resolve_usage(usage, A.symbols(s, d)).groupBy("symbol_id").agg(F.count("*").alias("n"))


@query(f"SELECT total_commands, total_saved, days, commands FROM (SELECT count(*) AS total_commands, CAST(sum(saved_tokens) AS BIGINT) AS total_saved, count(DISTINCT strftime(timestamp, '%Y-%m-%d')) AS days, count(DISTINCT original_cmd) AS commands FROM ({COMMANDS_SQL}))")
def json_export(s, d):
    """The exported object, read in again."""
    rows = A.commands(s, d)
    out = sinks.gain_json(telemetry.summary(rows), telemetry.daily(rows), telemetry.by_command(rows))
    field = lambda p: F.get_json_object("json", p).cast("long")
    size = lambda p: F.json_array_length(F.get_json_object("json", p)).cast("long")
    return out.select(field("$.summary.total_commands").alias("total_commands"), field("$.summary.total_saved").alias("total_saved"), size("$.daily").alias("days"), size("$.by_command").alias("commands"))


# ---- graph --------------------------------------------------------------------------------------

@query(
    with_(e=EDGES_SQL, one=f"SELECT DISTINCT caller, path, link_type FROM e WHERE callee = 'Sym{SEED}' AND callee_path IN ('{PATH}', '')", two="SELECT DISTINCT e.caller, e.path, e.link_type FROM one JOIN e ON e.callee = one.caller AND (e.callee_path = one.path OR e.callee_path = '') WHERE NOT (e.caller = one.caller AND e.path = one.path)", first="SELECT arg_min(caller, (path, caller, link_type)) AS parent FROM one")
    + f"SELECT DISTINCT caller AS child, 'Sym{SEED}' AS parent, CASE link_type WHEN 'implements' THEN '-.->' WHEN 'reference' THEN '--o' ELSE '-->' END AS arrow FROM one UNION SELECT caller, parent, CASE link_type WHEN 'implements' THEN '-.->' WHEN 'reference' THEN '--o' ELSE '-->' END FROM two, first"
)
def impact_mermaid(s, d):
    return graph.impact_edges(graph.blast_radius(A.edges(s, d), [f"Sym{SEED}"], PATH, 2), f"Sym{SEED}")


@query(f"WITH RECURSIVE k AS (SELECT DISTINCT caller AS src, callee AS dst FROM ({EDGES_SQL})), r AS (SELECT 'Sym{SEED}' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN k ON src = node WHERE depth < 10) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0")
def variable_radius(s, d):
    flows = A.edges(s, d).select(F.col("caller").alias("source"), F.col("callee").alias("sink"))
    return graph.closure(flows, f"Sym{SEED}")


TASKS_SQL = (
    f"WITH RECURSIVE e AS ({EDGES_SQL}), p AS (SELECT DISTINCT * FROM (SELECT callee AS src, caller AS dst FROM e UNION ALL SELECT caller, callee FROM e WHERE link_type IN ('satisfies', 'implements', 'embeds'))),"
    f" r AS (SELECT 'Sym{SEED}' AS node, 0 AS k UNION SELECT dst, k + 1 FROM p JOIN r ON src = node WHERE k < 1), m AS (SELECT node, min(k) AS k FROM r GROUP BY 1),"
    " t AS (SELECT caller, callee, path, line, callee_path, link_type, min(k) + 1 AS depth FROM (SELECT e.*, k FROM e JOIN m ON callee = node UNION ALL SELECT e.*, k FROM e JOIN m ON caller = node WHERE link_type IN ('satisfies', 'implements', 'embeds')) GROUP BY ALL),"
    " w AS (SELECT 'caller' AS kind, callee AS symbol, caller AS impacted, path, line, depth FROM t UNION ALL SELECT 'hierarchy', caller, callee, callee_path, line, depth FROM t WHERE link_type IN ('satisfies', 'implements', 'embeds')),"
    f" f AS (SELECT *, row_number() OVER (PARTITION BY impacted ORDER BY depth, path, line, symbol, kind) AS i FROM w WHERE impacted <> 'Sym{SEED}')"
    f" SELECT kind, symbol, impacted, path, CAST(line AS INTEGER) AS line, CAST(depth AS INTEGER) AS depth FROM f WHERE i = 1 UNION ALL SELECT DISTINCT 'definition', name, name, path, start_line, 0 FROM ({SYMBOLS_SQL}) WHERE name = 'Sym{SEED}'"
)


@query(TASKS_SQL)
def discover_tasks(s, d):
    return graph.discover_tasks(A.symbols(s, d), A.edges(s, d), f"Sym{SEED}", 2)


# ---- scores -------------------------------------------------------------------------------------

IMPACT = with_(
    e=EDGES_SQL, s=f"SELECT * FROM ({SYMBOLS_SQL}) WHERE name = 'Sym{SEED}' AND path = '{PATH}'", one=f"SELECT DISTINCT caller, path, link_type FROM e WHERE callee = 'Sym{SEED}' AND callee_path IN ('{PATH}', '')",
    two="SELECT DISTINCT one.caller AS c1, one.path AS p1, e.caller, e.path, e.link_type FROM one JOIN e ON e.callee = one.caller AND (e.callee_path = one.path OR e.callee_path = '') WHERE NOT (e.caller = one.caller AND e.path = one.path)",
    three="SELECT DISTINCT e.caller, e.path, e.link_type FROM two JOIN e ON e.callee = two.caller AND (e.callee_path = two.path OR e.callee_path = '') WHERE NOT (e.caller = two.caller AND e.path = two.path) AND NOT (e.caller = c1 AND e.path = p1)",
    b="SELECT count(*) AS blast FROM (SELECT caller, path, 1 AS distance, link_type FROM one UNION SELECT caller, path, 2, link_type FROM two UNION SELECT caller, path, 3, link_type FROM three)",
)


@query(IMPACT + f"SELECT id, blast, round(CAST(least(1.0, (0.20 * least(1.0, ln(1 + blast) / ln(501.0)) + 0.35 * least(1.0, (id % 60) / 100.0) + 0.15 * churn_score + 0.15 * CASE WHEN '{PATH.replace('.go', '_test.go')}' IN (SELECT path FROM ({SYMBOLS_SQL})) THEN 0 ELSE 1 END + 0.05 * least(1.0, (end_line - start_line + 1) / 500.0) + 0.10 * pagerank) * 1.4) AS DOUBLE), 6) AS risk FROM s, b")
def risk_impact(s, d):
    symbols = A.symbols(s, d)
    return risk.impact(symbols, A.edges(s, d), f"Sym{SEED}", PATH, symbols.select("path"), bugfixes=2).select("id", "blast", F.round("risk", 6).alias("risk"))


@query(f"SELECT count(DISTINCT id) AS bugfixes FROM ((SELECT id FROM ({OBSERVATIONS_SQL}) WHERE contains(lower(content), 'and') ORDER BY created_at DESC, id DESC LIMIT 10) UNION ALL (SELECT id FROM ({OBSERVATIONS_SQL}) WHERE contains(lower(content), 'the') ORDER BY created_at DESC, id DESC LIMIT 10))")
def historical_risk(s, d):
    return risk.historical_risk(A.observations(s, d), ["And", "the"])


@query(f"SELECT id, name GLOB '[A-Z]*' AS public, 1500 * CAST(id % 7 AS BIGINT) + 100 * CAST(id % 11 AS BIGINT) AS index_savings, 4000 + 500 * CAST(id % 5 AS BIGINT) AS predict_savings FROM ({SYMBOLS_SQL})")
def exports_and_savings(s, d):
    k = F.col("id")
    return A.symbols(s, d).select("id", risk.public_export(F.col("name")).alias("public"), risk.index_savings(k % 7, k % 11).cast("long").alias("index_savings"), risk.predict_savings(k % 5).cast("long").alias("predict_savings"))


def diff(s, d):
    from tessera.plans.registry import diff_lines

    return diff_lines(s, d).withColumn("line", F.regexp_replace("line", "^\\+\\+\\+ b/pkg", "+++ b//pkg"))


RANGES = f"SELECT {A.path_sql('p_partkey')} AS path, CAST(p_size AS INTEGER) AS a, CAST(p_size + p_partkey % 5 AS INTEGER) AS b FROM part UNION ALL SELECT {A.path_sql('p_partkey')}, 90, 90 FROM part"


@query(f"SELECT DISTINCT id FROM ({SYMBOLS_SQL}) s JOIN ({RANGES}) r ON r.path = s.path AND s.start_line <= b AND s.end_line >= a WHERE id % 100 > 60")
def risk_threshold(s, d):
    symbols = A.symbols(s, d)
    risks = symbols.select("name", "path", (F.col("id") % 100 / 100.0).alias("risk"))
    return risk.over_threshold(diff(s, d), symbols, risks, 0.6).select("id")


@query(f"SELECT id FROM ({SYMBOLS_SQL}) WHERE id % 30 > 0 AND id % 4 > 0")
def centrality_spike(s, d):
    symbols = A.symbols(s, d)
    after = symbols.withColumn("relevance", F.col("relevance") * (1 + F.col("id") % 4 * 0.25))
    return risk.centrality_spike(symbols, after).join(symbols.select("name", "path", "id"), ["name", "path"]).select("id")


@query(f"SELECT DISTINCT 'f' || CAST(k AS VARCHAR) || '.go' AS file, CAST(k + 1 AS INTEGER) AS line, name, path FROM (SELECT unnest(range(1, 50)) AS k) JOIN ({SYMBOLS_SQL}) ON path LIKE '%/f' || CAST(k AS VARCHAR) || '.go' AND start_line <= k + 1 AND end_line >= k + 1")
def diagnose(s, d):
    log = s.range(1, 50).select(F.concat(F.lit("    f"), F.col("id").cast("string"), F.lit(".go:"), (F.col("id") + 1).cast("string"), F.lit(": boom")).alias("line"))
    return risk.diagnose(log, A.symbols(s, d)).distinct()


@query(f"WITH s AS (SELECT * FROM ({SYMBOLS_SQL}) WHERE path = '{PATH}' AND start_line <= (SELECT p_size FROM part WHERE p_partkey = {SEED}) AND end_line >= (SELECT p_size FROM part WHERE p_partkey = {SEED})) SELECT arg_min(name, (start_line, name)) AS failing_symbol, '{PATH}' AS path, 'c7 (Fix)' AS last_commit, '/pkg0/f0_test.go' AS similar_path FROM s")
def diagnostic_hud(s, d):
    at = A.table(s, d, "part").where(f"p_partkey = {SEED}").first().p_size  # the first line of a symbol
    log = s.createDataFrame([(0, "ok"), (1, f"    {PATH[1:]}:{at}: boom"), (2, "    other.go:1: late")], "line_no int, line string")
    blame = s.createDataFrame([(PATH, at, "c7", "fix the sum"), (PATH, at + 1, "c8", "add")], "path string, line int, commit string, subject string")
    symbols = A.symbols(s, d)
    similar = lambda name: s.createDataFrame([(PATH,), ("/pkg0/f0_test.go",)], "path string")
    return risk.hud(log, symbols, A.edges(s, d), symbols.select("path"), blame, similar).select("failing_symbol", "path", "last_commit", "similar_path")


# ---- search -------------------------------------------------------------------------------------


@query(f"SELECT id FROM ({SYMBOLS_SQL}) WHERE structural_hash = (SELECT min(structural_hash) FROM ({SYMBOLS_SQL}) WHERE name = 'Sym{SEED}' AND path = '{PATH}') AND NOT (name = 'Sym{SEED}' AND path = '{PATH}')")
def symbol_twins(s, d):
    return search.twins(A.symbols(s, d), f"Sym{SEED}", PATH).select("id")


COLUMNS = {"name": 10.0, "type": 2.0, "signature": 5.0, "doc": 1.0, "path": 0.5}


@query(
    f"WITH t AS ({' UNION ALL '.join(f'SELECT id, {w} AS w, unnest(list_filter(string_split_regex(lower({c}), {chr(39)}[^{chr(92)}p{{L}}{chr(92)}p{{N}}]+{chr(39)}), lambda x: length(x) > 0)) AS token FROM ({SYMBOLS_SQL})' for c, w in COLUMNS.items())}),"
    " tf AS (SELECT id, CAST(sum(w) AS DOUBLE) AS tf FROM t WHERE token = 'widget' GROUP BY 1), ln AS (SELECT id, count(*) AS len FROM t GROUP BY 1), g AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM part) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM t) AS tokens, (SELECT CAST(count(*) AS DOUBLE) FROM tf) AS df)"
    " SELECT id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * n / tokens)), 6) AS relevance FROM tf JOIN ln USING (id), g ORDER BY relevance, id LIMIT 500"
)
def weighted_search(s, d):
    rows = A.symbols(s, d)
    found = search.bm25(search.build_index(rows, "id", list(search.COLUMN_WEIGHTS)), rows.select("id"), "widget", search.COLUMN_WEIGHTS)
    return rounded(found).orderBy("relevance", "id").limit(500)


QUESTIONS = [" plain ", "two words*", "*starred", 'say "so"', "*", ""]


@query("SELECT * FROM (VALUES (0, '\"plain\"'), (1, '\"two words\"*'), (2, '\"starred\"'), (3, '\"say \"\"so\"\"\"'), (4, ''), (5, '')) AS v(i, q)")
def sanitize_fts(s, d):
    """Questions are made ready on the driver, where they are asked."""
    return s.createDataFrame([(i, search.sanitize(q)) for i, q in enumerate(QUESTIONS)], "i int, q string")


@query(f"SELECT id, content FROM ({OBSERVATIONS_SQL}) WHERE project = 'user' AND created_at >= 3")
def memory_scan(s, d):
    return search.memory_scan(A.observations(s, d), "user", 3).select("id", "content")


NOTES = "'# Title ' || CAST(id AS VARCHAR) || chr(10) || '**Why**: old' || chr(10) || '**why**: turn ' || CAST(created_at AS VARCHAR) || chr(10) || '**Learned**: ' || project"


@query(f"SELECT id, '' AS type, 'Title ' || CAST(id AS VARCHAR) AS title, 'turn ' || CAST(created_at AS VARCHAR) AS why, project AS learned FROM ({OBSERVATIONS_SQL})")
def parse_insight(s, d):
    notes = A.observations(s, d)
    text = F.concat(F.lit("# Title "), F.col("id").cast("string"), F.lit("\n**Why**: old\n**why**: turn "), F.col("created_at").cast("string"), F.lit("\n**Learned**: "), "project")
    return search.parse_insight(notes.withColumn("content", text))


NAMES = "(VALUES (0, 'the', 'b.go'), (1, 'the', 'a.go'), (2, 'and', 'c.go'), (3, 'erea', 'd.go')) AS n(symbol_id, w, path)"


@query(f"WITH h AS (SELECT o.id AS memory_id, w AS symbol, path FROM {NAMES} JOIN ({OBSERVATIONS_SQL}) o ON regexp_matches(o.content, '(?i)\\b' || w || '\\b')), f AS (SELECT memory_id, min(symbol) AS symbol FROM h GROUP BY 1) SELECT memory_id, symbol, string_agg(path, ',' ORDER BY path) AS paths FROM h JOIN f USING (memory_id, symbol) GROUP BY 1, 2")
def correlate(s, d):
    named = s.createDataFrame([(0, "the", "b.go"), (1, "the", "a.go"), (2, "and", "c.go"), (3, "erea", "d.go")], "id int, name string, path string")
    return search.correlate(A.observations(s, d), named).withColumn("paths", F.array_join("paths", ","))


@query(f"SELECT id, runtime_hits + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS runtime_hits FROM ({SYMBOLS_SQL})")
def hit_bump(s, d):
    rows = A.symbols(s, d)
    return search.bump(rows, rows.where("id % 5 = 0").select("id")).select("id", "runtime_hits")


# ---- lines and streams --------------------------------------------------------------------------


@query(
    "WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\n\\z', ''), chr(10)) AS a FROM documents) SELECT doc_id, '    f' || CAST(doc_id AS VARCHAR) || '.go:2: boom' AS line FROM d UNION ALL SELECT doc_id, chr(10) || '--- SOURCE CONTEXT ---' FROM d"
    " UNION ALL SELECT doc_id, array_to_string(list_transform(range(1, least(len(a), 4) + 1), lambda i: CASE WHEN i = 2 THEN '> ' ELSE '  ' END || a[i]), chr(10)) FROM d UNION ALL SELECT doc_id, '--- END CONTEXT ---' || chr(10) FROM d"
)
def semantic_purify(s, d):
    docs = A.table(s, d, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".go"))
    failing = L.Stream(docs.select("doc_id", F.lit(0.0).alias("line_no"), F.concat(F.lit("    "), name, F.lit(":2: boom")).alias("line")))
    source = A.document_lines(s, d).lines.select(name.alias("path"), (F.col("line_no") + 1).cast("int").alias("line_no"), "line")
    return L.semantic_purify(failing, source).lines.select("doc_id", "line")


MODERATE = " AND ".join(f"NOT regexp_matches(line, '{p}')" for p in L.MODERATE_NOISE)


@query(f"SELECT doc_id, CASE WHEN length(line) > 40 THEN left(line, 37) || '...' ELSE line END AS line FROM ({LINES_SQL}) WHERE {MODERATE} AND regexp_matches(line, 'e')")
def line_pipeline(s, d):
    """A pipeline that streams could run, on lines at rest."""
    steps = [{"action": "strip_ansi"}, {"action": "noise_filter"}, {"action": "keep_lines", "pattern": "e"}, {"action": "truncate_lines", "max": 40}]
    return jobs.line_pipeline(A.document_lines(s, d).lines, steps).select("doc_id", "line")


@query(f"SELECT symbol_id, environment, CAST(sum(CASE WHEN coalesce(hit_count, 0) <= 0 THEN 1 ELSE hit_count END) AS BIGINT) AS hit_count, max(last_used) AS last_used FROM ({USAGE_SQL}) GROUP BY 1, 2")
def usage_parts(s, d):
    """A stream over files of usage lines, a part for each batch; read together."""
    root = f"{graph.shared_folder(s)}/usage-{uuid.uuid4().hex}"
    rows = A.usage(s, d).select(F.col("symbol_id").cast("string").alias("symbol_name"), F.col("environment").alias("symbol_path"), "hit_count", "last_used")
    rows.select(F.to_json(F.struct("*")).alias("value")).repartition(3).write.text(f"{root}/lines")
    resolve = lambda b: b.select(F.col("symbol_name").cast("long").alias("symbol_id"), F.col("symbol_path").alias("environment"), "hit_count", "last_used")
    jobs.ingest_usage(s, f"{root}/lines", f"{root}/table", f"{root}/checkpoint", resolve, files=1).awaitTermination()
    return jobs.usage_table(s, f"{root}/table")


@query(
    with_(i=f"SELECT path, row_number() OVER (ORDER BY first, path) AS path_id FROM (SELECT path, min(id) AS first FROM ({SYMBOLS_SQL}) GROUP BY 1)", b=f"SELECT callee, count(*) AS n FROM ({EDGES_SQL}) GROUP BY 1")
    + f"SELECT CAST(path_id AS INTEGER) AS path_id, concat_ws('|', 'X', path_id, name, coalesce(n, 0), id % 4) AS line FROM ({SYMBOLS_SQL}) JOIN i USING (path) LEFT JOIN b ON callee = name"
)
def hakai_critical(s, d):
    symbols = A.symbols(s, d)
    rows = graph.centrality(symbols, A.edges(s, d)).withColumn("fragility", F.col("id") % 4)
    return encode.hakai_critical(rows, encode.path_ids(symbols, "id"))


# ---- string functions ---------------------------------------------------------------------------

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("SELECT doc_id, CASE WHEN length(text) > 10 THEN left(text, 7) || '...' ELSE text END AS ten, left(text, 2) AS two FROM documents")
def truncate(s, d):
    t = F.col("text")
    return A.table(s, d, "documents").select("doc_id", S.truncate(t, 10).alias("ten"), S.truncate(t, 2).alias("two"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> ''), chr(10)) AS comment FROM documents")
def clean_comment(s, d):
    """Texts as comments of two kinds, in turn."""
    t = F.coalesce("text", F.lit(""))
    block, lines = F.concat(F.lit("/**\n * "), F.replace(t, F.lit("\n"), F.lit("\n * ")), F.lit("\n */")), F.concat(F.lit("// "), F.replace(t, F.lit("\n"), F.lit("\n// ")))
    return A.table(s, d, "documents").select("doc_id", S.clean_comment(F.when(F.col("doc_id") % 2 == 0, block).otherwise(lines)).alias("comment"))


@query("SELECT event_id, props AS json, props AS code FROM events")
def extract_blocks(s, d):
    p = F.col("props")
    return A.table(s, d, "events").select("event_id", S.extract_json(F.concat(F.lit("so "), p, F.lit(" end"))).alias("json"), S.extract_code_block(F.concat(F.lit("x\n```go\n"), p, F.lit("\n```\ny"))).alias("code"))


@query("SELECT c_custkey, c_name || ',two' AS items, c_custkey % 10 + 0.5 AS rating FROM customer")
def extract_lists(s, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Intro\nRisks:\n\n- "), F.col("c_name"), F.lit("\n* two\nend\n- three"))
    rating = F.concat(F.lit("about "), (k % 10).cast("string"), F.lit(".5 / 10"))
    return A.table(s, d, "customer").select("c_custkey", F.array_join(S.extract_list(text, "risks"), ",").alias("items"), S.parse_rating(rating).alias("rating"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'pkg/f' || CAST(p_partkey AS VARCHAR) || '.go' END AS file, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS INTEGER) END AS line FROM part")
def go_failure_ref(s, d):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "").otherwise("    "), F.lit("pkg/f"), k.cast("string"), F.lit(".go:"), F.col("p_size").cast("string"), F.lit(": boom"))
    return A.table(s, d, "part").select("p_partkey", S.go_failure(text).alias("r")).select("p_partkey", "r.file", "r.line")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'Store.Get' ELSE name END AS target FROM ({SYMBOLS_SQL})")
def map_test_to_symbol(s, d):
    test = F.concat(F.lit("Test"), F.when(F.col("id") % 2 == 0, F.lit("Store_Get_x")).otherwise(F.concat("name", F.lit("_case"))))
    return A.symbols(s, d).select("id", S.map_test_to_symbol(test).alias("target"))
