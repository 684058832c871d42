"""Queries over what other programs give: logs, blame, language servers, commands, settings, staged edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import jsonc
from tessera.functions import vectors as V
from tessera.operators import graph, ledger, parse, search, store
from tessera.plans import adapters as A
from tessera.plans.adapters import EDGES_SQL, OBSERVATIONS_SQL, SYMBOLS_SQL
from tessera.plans.base import SEED, query
from tessera.plans.source_queries import KEYS, PYTHON, TS, sources
from tessera.sources import commands, files, history, language_server
from tessera.streaming import jobs

# ---- history ------------------------------------------------------------------------------------


@query("SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS commit, CAST(epoch(o_orderdate) AS BIGINT) AS ts, 'fix ' || o_orderpriority AS subject, 's' || CAST(l_suppkey AS VARCHAR) AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def git_log_stats(s, d):
    """Orders as commits of a log, their suppliers as files."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz"))
    head = A.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("commit c"), F.col("o_orderkey").cast("string"), F.lit(" "), seconds.cast("string"), F.lit(" fix "), "o_orderpriority").alias("line"))
    body = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey") + 1).cast("long").alias("line_no"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("line"))
    return history.git_log(head.unionByName(body))


@query("SELECT 'f' || CAST(conv_id AS VARCHAR) || '.go' AS path, CAST(turn + 1 AS INTEGER) AS line, md5(role) AS commit, role AS author, CASE WHEN role = 'user' THEN 'Fix' ELSE 'Feature' END AS era FROM conversations")
def git_blame(s, d):
    """Conversations as files, turns as their lines."""
    rows = A.table(s, d, "conversations")
    subject = F.when(F.col("role") == "user", "fix it").otherwise("add it")
    at = (F.col("turn") + 1).cast("string")
    lines = F.array(F.concat(F.md5("role"), F.lit(" 1 "), at, F.lit(" 1")), F.concat(F.lit("author "), "role"), F.concat(F.lit("summary "), subject), F.concat(F.lit("filename f"), F.col("conv_id").cast("string"), F.lit(".go")), F.lit("\tcode"))
    porcelain = rows.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(lines).alias("i", "line")).select("doc_id", (F.col("turn") * 10 + F.col("i")).cast("long").alias("line_no"), "line")
    return history.git_blame(porcelain).select("path", "line", "commit", "author", "era")


@query("SELECT * FROM (VALUES (0, 'one', 'out'), (1, 'two', 'out'), (0, 'oops', 'err')) AS v(line_no, line, stream)")
def exec_capture(s, d):
    out, err, _ = commands.capture(s, ["sh", "-c", "echo one; echo two; echo oops >&2; exit 3"], 30, {"sh"})
    number = lambda df, name: df.select(F.col("line_no").cast("int").alias("line_no"), "line", F.lit(name).alias("stream"))
    return number(out, "out").unionByName(number(err, "err"))


# ---- language servers and what follows from types -----------------------------------------------

INTERFACES = f"SELECT id, name, path, start_line FROM ({SYMBOLS_SQL}) WHERE type = 'interface'"


def answers(s, d):
    """An answer for each interface: two places, one of them its own."""
    i = A.symbols(s, d).where("type = 'interface'")
    place = lambda path, line: F.concat(F.lit('{"uri":"file://'), path, F.lit('","range":{"start":{"line":'), line.cast("string"), F.lit(',"character":0},"end":{"line":9,"character":1}}}'))
    return i.select(F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id").cast("string"), F.lit(',"result":['), place(F.col("path"), F.col("start_line") - 1), F.lit(","), place(F.concat(F.lit("/a%20b"), "path"), F.col("start_line")), F.lit("]}")).alias("value"))


@query(f"SELECT id, path, CAST(start_line AS INTEGER) AS line FROM ({INTERFACES}) UNION ALL SELECT id, '/a b' || path, start_line + 1 FROM ({INTERFACES})")
def lsp_source(s, d):
    return language_server.locations(answers(s, d))


@query(f"SELECT DISTINCT 'impl' AS caller, name AS callee, '/a b' || path AS path, CAST(start_line + 1 AS INTEGER) AS line, path AS callee_path, 'implements' AS link_type FROM ({INTERFACES})")
def lsp_implements(s, d):
    return graph.located_implementations(A.symbols(s, d).where("type = 'interface'"), language_server.locations(answers(s, d)))


@query(f"SELECT DISTINCT caller, path, line FROM ({EDGES_SQL}) WHERE callee = 'Sym{SEED}' AND callee_path IN ('/pkg3/f3.go', '') AND link_type NOT IN ('satisfies', 'implements', 'embeds')")
def lsp_callers(s, d):
    return graph.incoming_calls(A.edges(s, d), [f"Sym{SEED}"], "/pkg3/f3.go")


@query(f"SELECT DISTINCT callee AS caller, caller AS callee, callee_path AS path, line, path AS callee_path, 'dynamic' AS link_type FROM ({EDGES_SQL}) WHERE link_type = 'satisfies'")
def enrich_dynamic(s, d):
    return graph.dynamic_edges(A.edges(s, d))


@query(
    f"WITH c AS (SELECT caller, callee, path, line, callee_path FROM ({EDGES_SQL}) WHERE link_type = 'call'), t AS (SELECT DISTINCT callee, caller AS target, path AS target_path FROM ({EDGES_SQL}) WHERE link_type = 'satisfies')"
    " SELECT *, 'ssa-call' AS link_type FROM (SELECT * FROM c UNION SELECT c.caller, t.target, c.path, c.line, t.target_path FROM c JOIN t USING (callee))"
)
def ssa_call_graph(s, d):
    return graph.class_hierarchy_calls(A.edges(s, d))


# ---- settings, rewrites, batches, bytes ---------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, 'new' AS inner, CAST(NULL AS VARCHAR) AS old FROM events")
def json_merge(s, d):
    """Settings with comments and trailing commas, under an overlay."""
    base = F.concat(F.lit('{ // settings\n "a": {"k": 0, "in": {"old": 1,},}, /* end */ "kind": "'), "event_type", F.lit('",\n}'))
    overlay = F.concat(F.lit('{"a": '), "props", F.lit(', "b": 1}'))
    replaced = F.lit('{"a": {"in": {"__replace__": {"new": "new"}}}}')
    out = A.table(s, d, "events").select("event_id", jsonc.merged(jsonc.merged(base, overlay), replaced).alias("j"))
    field = lambda p: F.get_json_object("j", p)
    return out.select("event_id", field("$.a.k").cast("long").alias("k"), field("$.kind").alias("kind"), field("$.a.in.new").alias("inner"), field("$.a.in.old").alias("old"))


@query(f"SELECT base || '.py' AS path, 16 AS line, 'return osp.join(out)' AS before, 'return join(*out)' AS after FROM ({KEYS}) UNION ALL SELECT base || '.ts', 12, 'return double(x)', 'return join(*x)' FROM ({KEYS})")
def ast_grep(s, d):
    """A pattern and what it becomes, over two languages."""
    python = parse.structural_rewrite(sources(s, d, ".py", *PYTHON), "return osp.join($X)", "return join(*$X)")
    ts = parse.structural_rewrite(sources(s, d, ".ts", *TS), "return double($X)", "return join(*$X)")
    return python.unionByName(ts).select("path", "line", "before", "after")


@query("SELECT count(*) AS rows, true AS fits FROM lineitem")
def batch_collector(s, d):
    sizes = jobs.in_batches(A.table(s, d, "lineitem").select("l_orderkey"), 500).groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), (F.max("n") <= 500).alias("fits"))


@query("SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, true AS same FROM embeddings")
def vector_bytes(s, d):
    rows = A.table(s, d, "embeddings").select("vec_id", "embedding", V.to_bytes(F.col("embedding").cast("array<float>")).alias("b"))
    return rows.select("vec_id", F.octet_length("b").cast("int").alias("bytes"), (V.from_bytes(F.col("b")) == F.col("embedding").cast("array<float>")).alias("same"))


@query(f"SELECT id, CASE WHEN id % 3 = 1 THEN '/repo' || path WHEN id % 3 = 2 THEN '/repo/x' END AS path FROM ({SYMBOLS_SQL})")
def path_jail(s, d):
    k = F.col("id")
    path = F.when(k % 3 == 0, F.concat(F.lit("../../etc"), "path")).when(k % 3 == 1, F.concat(F.lit("./a/.."), "path")).otherwise(F.lit("/repo/y/../x"))
    return A.symbols(s, d).select("id", files.inside(path, "/repo").alias("path"))


@query(f"SELECT project, string_agg(CAST(n AS VARCHAR), ',' ORDER BY created_at, id) AS text FROM (SELECT id, project, created_at, length(content) AS n FROM ({OBSERVATIONS_SQL})) GROUP BY 1")
def distill(s, d):
    """Notes of each kind given to a function, as a model would be."""
    return search.distilled(A.observations(s, d), "project", lambda texts: ",".join(str(len(t)) for t in texts))


VERSIONS = f"SELECT path, name, min(structural_hash) AS h FROM ({SYMBOLS_SQL}) WHERE {{}} GROUP BY 1, 2"


@query(f"SELECT coalesce(a.path, b.path) AS path, coalesce(a.name, b.name) AS name, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'added' WHEN a.h = replace(b.h, 'PROMO', 'OLD') THEN 'unchanged' ELSE 'mangled' END AS state FROM ({VERSIONS.format('id % 3 <> 0')}) a FULL JOIN ({VERSIONS.format('id % 4 <> 0')}) b ON a.path = b.path AND a.name = b.name")
def semantic_diff(s, d):
    """Two versions of all files: some symbols only in one, some of another shape."""
    of = lambda where, h: A.symbols(s, d).where(where).groupBy("path", "name").agg(F.min("structural_hash").alias("h")).withColumn("h", h)
    return store.difference(of("id % 3 <> 0", F.col("h")), of("id % 4 <> 0", F.replace("h", F.lit("PROMO"), F.lit("OLD"))), ["path", "name"], "h")


# ---- staged edits -------------------------------------------------------------------------------

DOCS = "SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS content FROM documents"


def staged(s, d):
    """Every third document is edited, and a new one is added; every seventh of all changes after that."""
    docs = A.table(s, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    edits = docs.where("doc_id % 3 = 0").select("path", F.concat("content", F.lit("!")).alias("content"), F.lit(1).cast("long").alias("staged_at"))
    edits = edits.unionByName(s.createDataFrame([("new", "text", 2)], "path string, content string, staged_at long"))
    known = docs.select("path", "content")
    return ledger.stage(s.createDataFrame([], ledger.STAGED), known, edits), known, docs.select("path", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("?"), "content")).otherwise(F.col("content")).alias("content"))


@query("SELECT 'f' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 21 = 0")
def staged_conflicts(s, d):
    edits, _, later = staged(s, d)
    return ledger.conflicts(edits, later)


@query(f"SELECT path, sha256(content || CASE WHEN CAST(substr(path, 2) AS BIGINT) % 3 = 0 THEN '!' ELSE '' END) AS hash FROM ({DOCS}) UNION ALL SELECT 'new', sha256('text')")
def staged_commit(s, d):
    edits, known, _ = staged(s, d)
    return ledger.apply(edits, known)[0].select("path", F.sha2("content", 256).alias("hash"))


@query(f"SELECT path, sha256(content) AS hash FROM ({DOCS})")
def staged_rollback(s, d):
    edits, known, _ = staged(s, d)
    done, journal = ledger.apply(edits, known)
    return ledger.roll_back(done, journal).select("path", F.sha2("content", 256).alias("hash"))


@query("SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, 1 AS added FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'new', 1")
def staged_diffs(s, d):
    edits, known, _ = staged(s, d)
    plus = F.filter(F.split("diff", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return ledger.diffs(edits, known).select("path", F.size(plus).alias("added"))
