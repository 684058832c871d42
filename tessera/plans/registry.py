"""Queries and their SQL, by the slug of the operator that each applies."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.functions import vectors as V
from tessera.operators import encode, graph, nearest, risk, search, segments, store, telemetry
from tessera.operators import lines as L
from tessera.plans import adapters as A
from tessera.plans.base import ORACLES, QUERIES, SEED, query, rounded, with_
from tessera.plans.adapters import COMMANDS_SQL, COMMITS_SQL, EDGES_SQL, LINES_SQL, OBSERVATIONS_SQL, SYMBOLS_SQL, USAGE_SQL
from tessera.streaming import jobs, stateful

NOW = datetime.datetime(2024, 1, 31)


def lines(s: SparkSession, d: str) -> L.Stream:
    return A.document_lines(s, d)


def no_of(stream: L.Stream) -> DataFrame:
    return stream.lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


OUT = "SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM "

# ---- line actions -------------------------------------------------------------------------------


@query(f"{OUT} ({LINES_SQL}) WHERE regexp_matches(line, '(?i)the .*and')")
def keep_lines(s, d):
    return no_of(L.keep_lines(lines(s, d), "(?i)the .*and"))


@query(f"{OUT} ({LINES_SQL}) WHERE NOT regexp_matches(line, '[aeiou]{{2}}')")
def remove_lines(s, d):
    return no_of(L.remove_lines(lines(s, d), "[aeiou]{2}"))


@query(f"{OUT} (SELECT doc_id, line_no, CASE WHEN length(line) > 40 THEN left(line, 37) || '...' ELSE line END AS line FROM ({LINES_SQL}))")
def truncate_lines(s, d):
    return no_of(L.truncate_lines(lines(s, d), 40))


@query("SELECT page_id, regexp_replace(html, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g') AS html FROM pages")
def strip_ansi(s, d):
    return A.table(s, d, "pages").select("page_id", S.strip_ansi(F.col("html")).alias("html"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '^(src|lib|internal|pkg|vendor)/', '') AS path FROM pages")
def compact_path(s, d):
    return A.table(s, d, "pages").select("page_id", S.compact_path(F.regexp_replace("url", "^[a-z]+://[^/]+/", "")).alias("path"))


@query(f"{OUT} (SELECT doc_id, line_no, regexp_extract(line, '(\\w+) (\\w+)', 2) || '/' || regexp_extract(line, '(\\w+) (\\w+)', 1) AS line FROM ({LINES_SQL}) WHERE regexp_matches(line, '(\\w+) (\\w+)'))")
def regex_extract(s, d):
    return no_of(L.regex_extract(lines(s, d), "(\\w+) (\\w+)", "$2/$1"))


NOISE = " AND ".join(f"NOT regexp_matches(line, '{p}')" for p in L.AGGRESSIVE_NOISE)


@query(f"{OUT} ({LINES_SQL}) WHERE {NOISE}")
def noise_filter(s, d):
    return no_of(L.noise_filter(lines(s, d), "aggressive"))


RANKED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id) AS t FROM ({LINES_SQL})"


@query(f"{OUT} (SELECT doc_id, line_no, line FROM ({RANKED}) WHERE r <= 3 UNION ALL SELECT doc_id, line_no, '+' || CAST(t - 3 AS VARCHAR) || ' more lines' FROM ({RANKED}) WHERE r = 4)")
def head(s, d):
    return no_of(L.head(lines(s, d), 3))


@query(f"{OUT} ({RANKED}) WHERE r > t - 3")
def tail(s, d):
    return no_of(L.tail(lines(s, d), 3))


def head_tail_sql(source: str, n: int, m: int) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id) AS t FROM ({source})"
    return f"SELECT doc_id, line_no, line FROM ({ranked}) WHERE t <= {n + m + 5} OR r <= {n} OR r > t - {m} UNION ALL SELECT doc_id, line_no, '... [truncated ' || CAST(t - {n + m} AS VARCHAR) || ' lines of noise] ...' FROM ({ranked}) WHERE t > {n + m + 5} AND r = {n + 1}"


@query(f"{OUT} ({head_tail_sql(LINES_SQL, 2, 2)})")
def head_tail(s, d):
    return no_of(L.head_tail(lines(s, d), 2, 2))


def rle_sql(source: str) -> str:
    trimmed = f"SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM ({source})"
    fresh = f"SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT DISTINCT FROM line THEN 0 ELSE 1 END AS fresh FROM ({trimmed}) WHERE line <> ''"
    islands = f"SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM ({fresh})"
    return f"SELECT doc_id, min(line_no) AS line_no, CASE WHEN count(*) > 1 THEN min(line) || ' [x' || CAST(count(*) AS VARCHAR) || ']' ELSE min(line) END AS line FROM ({islands}) GROUP BY doc_id, island"


@query(f"{OUT} ({rle_sql(LINES_SQL)})")
def snr_dedup(s, d):
    return no_of(L.snr_dedup(lines(s, d)))


MODERATE = " AND ".join(f"NOT regexp_matches(line, '{p}')" for p in L.MODERATE_NOISE)
BARE = f"SELECT doc_id, line_no, regexp_replace(line, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g') AS line FROM ({LINES_SQL})"


@query(f"{OUT} ({head_tail_sql(f'SELECT * FROM ({rle_sql(BARE)}) WHERE {MODERATE}', 5, 5)})")
def pure_signal(s, d):
    return no_of(L.pure_signal(lines(s, d), head=5, tail=5))


def counted_sql(key: str, where: str, line: str, top: int) -> str:
    counts = f"SELECT doc_id, {key} AS key, count(*) AS n, min(line_no) AS first FROM ({LINES_SQL}) WHERE {where} GROUP BY 1, 2"
    return f"SELECT doc_id, line_no, {line} AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS line_no FROM ({counts})) WHERE line_no <= {top}"


@query(f"{OUT} ({counted_sql(chr(39).join(['regexp_extract(line, ', '^(..)', ', 1)']), chr(39).join(['regexp_matches(line, ', '^(..)', ')']), chr(39).join(['key || ', ': ', ' || CAST(n AS VARCHAR)']), 3)})")
def group_by(s, d):
    return no_of(L.group_by(lines(s, d), "^(..)", top=3))


@query(f"{OUT} ({counted_sql(chr(39).join(['regexp_replace(regexp_replace(line, ', '[0-9]+', ', ', '', ', ', 'g', '), ', '^\\s+|\\s+$', ', ', '', ', ', 'g', ')']), 'true', chr(39).join(['CASE WHEN n > 1 THEN key || ', ' (x', ' || CAST(n AS VARCHAR) || ', ')', ' ELSE key END']), 4)})")
def dedup(s, d):
    return no_of(L.dedup(lines(s, d), ["[0-9]+", "("], top=4))


@query(f"SELECT doc_id, key, CAST(sum(CASE WHEN regexp_matches(line, p) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ({LINES_SQL}) CROSS JOIN (VALUES ('digits', '[0-9]'), ('long', '.{{80}}')) AS v(key, p) GROUP BY 1, 2")
def aggregate(s, d):
    return L.aggregate(lines(s, d), {"digits": "[0-9]", "long": ".{80}", "bad": "("}).stats.select("doc_id", "key", F.col("n").cast("long").alias("n"))


TURNS_SQL = "SELECT conv_id AS doc_id, CAST(turn AS DOUBLE) AS line_no, replace(text, chr(10), ' ') AS line FROM conversations"


def turns(s, d):
    rows = A.table(s, d, "conversations")
    return L.Stream(rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("double").alias("line_no"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("line")))


STATES = {"start": {"until": "the", "next": "rest", "keep": "$^x"}, "rest": {"keep": "and"}}
PASSED = "max(CASE WHEN regexp_matches(line, 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SECTION_SQL = f"SELECT doc_id, line FROM (SELECT *, {PASSED} AS p FROM ({TURNS_SQL})) WHERE p = 1 AND regexp_matches(line, 'and')"


@query(SECTION_SQL)
def state_machine(s, d):
    return L.state_machine(turns(s, d), STATES).lines.select("doc_id", "line")


MACHINE = {"start": {"until": "[aeiou]{2}", "next": "inner"}, "inner": {"until": "[0-9]|st", "next": "last", "keep": "^[A-Z]"}, "last": {"until": "e\\W*$", "next": "start", "keep": "a"}}
FOLD = """list_reduce(list_prepend({'s': 0, 'k': CAST([] AS VARCHAR[])}, list_transform(l, lambda x: {'s': 0, 'k': [x]})), lambda a, x: CASE
 WHEN a.s = 0 THEN CASE WHEN regexp_matches(x.k[1], '[aeiou]{2}') THEN {'s': 1, 'k': a.k} ELSE {'s': 0, 'k': list_concat(a.k, x.k)} END
 WHEN a.s = 1 THEN CASE WHEN regexp_matches(x.k[1], '[0-9]|st') THEN {'s': 2, 'k': a.k} WHEN regexp_matches(x.k[1], '^[A-Z]') THEN {'s': 1, 'k': list_concat(a.k, x.k)} ELSE a END
 ELSE CASE WHEN regexp_matches(x.k[1], 'e\\W*$') THEN {'s': 0, 'k': a.k} WHEN regexp_matches(x.k[1], 'a') THEN {'s': 2, 'k': list_concat(a.k, x.k)} ELSE a END END)"""


@query(f"SELECT doc_id, unnest({FOLD}.k) AS line FROM (SELECT doc_id, list(line ORDER BY line_no) AS l FROM ({LINES_SQL}) GROUP BY doc_id)")
def state_cycle(s, d):
    """Three states that lead into each other, over every line of the documents."""
    return L.state_machine(lines(s, d), MACHINE).lines.select("doc_id", "line")


@query(SECTION_SQL)
def state_sections(s, d):
    return L.sections(turns(s, d), "the", "and").select("doc_id", "line")


def props(s, d):
    return L.Stream(A.table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").cast("double").alias("line_no"), F.col("props").alias("line")))


@query("SELECT user_id AS doc_id, json_extract_string(props, '$.k') || ': ' || CAST(count(*) AS VARCHAR) || ' events' AS line FROM events WHERE json_valid(props) GROUP BY user_id, json_extract_string(props, '$.k')")
def ndjson_stream(s, d):
    return L.ndjson_stream(props(s, d), "k").lines.select("doc_id", "line")


@query("SELECT event_id AS doc_id, 'k: ' || json_extract_string(props, '$.k') AS line FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extract(s, d):
    rows = A.table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.lit(0.0).alias("line_no"), F.col("props").alias("line"))
    return L.json_extract(L.Stream(rows), ["k", "absent"]).lines.select("doc_id", "line")


@query("SELECT user_id AS doc_id, line FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES ('{'), ('  k: number'), ('}')) AS v(line)")
def json_schema(s, d):
    """The shapes of a user's events, shapes alike once; every text is a document, texts alike once."""
    events = A.table(s, d, "events").select("user_id", "props").distinct()
    rows = events.select(F.col("props").alias("doc_id"), F.lit(0.0).alias("line_no"), F.col("props").alias("line")).distinct()
    shapes = L.json_schema(L.Stream(rows)).lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("shape"))
    of_users = shapes.join(events.withColumnRenamed("props", "doc_id"), "doc_id").select(F.col("user_id").alias("doc_id"), F.col("shape.line").alias("shape")).distinct()
    return of_users.select("doc_id", F.explode("shape").alias("line"))


@query(f"SELECT doc_id, CAST(count(*) AS VARCHAR) || ' lines, ' || CAST(sum(CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END) AS VARCHAR) || ' with digits' AS line FROM ({LINES_SQL}) GROUP BY doc_id")
def format_template(s, d):
    counted = L.Stream(lines(s, d).lines, stats=L.aggregate(lines(s, d), {"digits": "[0-9]"}).stats)
    return L.format_template(counted, "{{.count}} lines, {{with .stats}}{{.digits}} with digits{{end}}\n").lines.select("doc_id", "line")


# ---- string functions ---------------------------------------------------------------------------


@query(
    "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS n_lines, sha256('a:' || lang || ':' || source) AS signature,"
    " CASE WHEN octet_length(encode(text)) > 500 THEN left(text, 100) || chr(10) || '... [pruned] ...' || chr(10) || right(text, 100) ELSE text END AS pruned FROM documents"
)
def text_measures(s, d):
    t = F.col("text")
    return A.table(s, d, "documents").select("doc_id", S.estimate_tokens(t).alias("tokens"), S.count_lines(t).alias("n_lines"), S.signature_hash(F.lit("a"), F.col("lang"), F.col("source")).alias("signature"), S.prune_history(t).alias("pruned"))


TENTHS = "(n + {0} // 2) // {0}"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 1000000 THEN CAST({TENTHS.format(100000)} // 10 AS VARCHAR) || '.' || CAST({TENTHS.format(100000)} % 10 AS VARCHAR) || 'M' WHEN n >= 1000 THEN CAST({TENTHS.format(100)} // 10 AS VARCHAR) || '.' || CAST({TENTHS.format(100)} % 10 AS VARCHAR) || 'K' ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT *, CAST(floor(l_extendedprice * 10) AS BIGINT) AS n FROM lineitem)")
def format_tokens(s, d):
    n = F.floor(F.col("l_extendedprice") * 10).cast("long")
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.format_tokens(n).alias("shown"))


FLAG, ENV, URI = S.SECRET_FLAG, S.SECRET_ENV, S.SECRET_URI


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{FLAG}', '\\1[REDACTED]', 'g'), '{ENV}', '\\1[REDACTED]', 'g'), '{URI}', '\\1[REDACTED]\\3', 'g') AS text FROM documents")
def redact_secrets(s, d):
    return A.table(s, d, "documents").select("doc_id", S.redact_secrets(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)fix|bug|patch') THEN 'Fix' WHEN regexp_matches(text, '(?i)refactor|perf|clean|optimize') THEN 'Refactor' WHEN regexp_matches(text, '(?i)feat|add|new|implement') THEN 'Feature' ELSE 'Chore' END AS era FROM documents")
def era(s, d):
    return A.table(s, d, "documents").select("doc_id", S.era(F.col("text")).alias("era"))


@query(f"SELECT id, substr(sha256(regexp_replace(path, '/[^/]*$', '')), 1, 4) AS shard, regexp_extract(path, '[^/]*$') AS file FROM ({SYMBOLS_SQL})")
def shard_route(s, d):
    return A.symbols(s, d).select("id", S.shard_route(F.col("path")).alias("shard"), F.substring_index("path", "/", -1).alias("file"))


# ---- telemetry ----------------------------------------------------------------------------------

SUMS = "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens, round(coalesce(sum(saved_tokens) * 100.0 / nullif(sum(input_tokens), 0), 0), 6) AS avg_savings"


@query(f"SELECT count(*) AS total_commands, CAST(sum(saved_tokens) AS BIGINT) AS total_saved, round(sum(saved_tokens) * 100.0 / nullif(sum(input_tokens), 0), 6) AS avg_savings, CAST(sum(exec_time_ms) AS BIGINT) AS total_time_ms FROM ({COMMANDS_SQL})")
def summary(s, d):
    return rounded(telemetry.summary(A.commands(s, d)))


@query(f"SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS commands, {SUMS} FROM ({COMMANDS_SQL}) WHERE timestamp >= TIMESTAMP '2024-01-11' GROUP BY 1")
def daily(s, d):
    return rounded(telemetry.daily(A.commands(s, d), NOW, 20))


@query(f"SELECT strftime(timestamp, '%Y-W%W') AS period, count(*) AS commands, {SUMS} FROM ({COMMANDS_SQL}) WHERE timestamp >= TIMESTAMP '2024-01-10' GROUP BY 1")
def weekly(s, d):
    return rounded(telemetry.weekly(A.commands(s, d), NOW, 3))


@query(f"SELECT strftime(timestamp, '%Y-%m') AS period, count(*) AS commands, {SUMS} FROM ({COMMANDS_SQL}) WHERE timestamp >= TIMESTAMP '2023-12-02' GROUP BY 1")
def monthly(s, d):
    return rounded(telemetry.monthly(A.commands(s, d), NOW, 2))


@query(f"SELECT original_cmd, count(*) AS count, {SUMS} FROM ({COMMANDS_SQL}) GROUP BY 1 ORDER BY saved_tokens DESC, original_cmd LIMIT 3")
def by_command(s, d):
    return rounded(telemetry.by_command(A.commands(s, d), 3))


@query(f"SELECT id, original_cmd, saved_tokens FROM ({COMMANDS_SQL}) ORDER BY id DESC LIMIT 25")
def recent(s, d):
    return telemetry.recent(A.commands(s, d), 25).select("id", "original_cmd", "saved_tokens")


@query(f"SELECT day, saved_tokens, CAST(floor(saved_tokens / max(saved_tokens) OVER () * 7) AS INTEGER) AS level FROM (SELECT strftime(timestamp, '%Y-%m-%d') AS day, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM ({COMMANDS_SQL}) GROUP BY 1 ORDER BY 1 DESC LIMIT 14)")
def sparkline_values(s, d):
    return telemetry.sparkline(telemetry.daily(A.commands(s, d))).select("day", "saved_tokens", "level")


SAVED = "coalesce(saved_tokens * 100.0 / nullif(input_tokens, 0), 0)"


@query(f"SELECT id, round({SAVED}, 6) AS savings_pct, round(CASE WHEN {SAVED} >= 100 THEN 99.9 ELSE least(100.0 / (100.0 - {SAVED}), 99.9) END, 6) AS density, CASE WHEN {SAVED} >= 90 THEN 'Elite' WHEN {SAVED} >= 75 THEN 'Great' WHEN {SAVED} >= 50 THEN 'Good' WHEN {SAVED} >= 25 THEN 'Fair' ELSE 'Low' END AS tier FROM ({COMMANDS_SQL})")
def savings_pct(s, d):
    pct = S.savings_pct(F.col("saved_tokens"), F.col("input_tokens"))
    return A.commands(s, d).select("id", F.round(pct, 6).alias("savings_pct"), F.round(telemetry.density(pct), 6).alias("density"), telemetry.tier(pct).alias("tier"))


@query(f"SELECT id, saved_tokens FROM ({COMMANDS_SQL}) WHERE timestamp >= TIMESTAMP '2024-01-16'")
def retention(s, d):
    return telemetry.retain(A.commands(s, d), NOW, 15).select("id", "saved_tokens")


@query(f"SELECT symbol_id, environment, CAST(sum(CASE WHEN coalesce(hit_count, 0) <= 0 THEN 1 ELSE hit_count END) AS BIGINT) AS hit_count, max(last_used) AS last_used FROM ({USAGE_SQL}) GROUP BY 1, 2")
def usage_rollup(s, d):
    return telemetry.usage_rollup(A.usage(s, d))


@query(f"SELECT symbol_id, environment, CAST(sum(CASE WHEN coalesce(hit_count, 0) <= 0 THEN 1 ELSE hit_count END) AS BIGINT) AS hit_count, max(last_used) AS last_used FROM ({USAGE_SQL}) GROUP BY 1, 2")
def merge_usage(s, d):
    rows = A.usage(s, d)
    old, new = rows.where("last_used % 2 = 0"), rows.where("last_used % 2 <> 0")
    return telemetry.merge_usage(telemetry.usage_rollup(old), telemetry.usage_rollup(new)).withColumn("hit_count", F.col("hit_count").cast("long"))


@query("SELECT user_id, CASE WHEN coalesce(k, 0) <= 0 THEN 1 ELSE k END AS hit_count FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE coalesce(event_type, '') <> ''")
def jsonl_usage(s, d):
    from tessera.sources.events import usage_of

    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = A.table(s, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("symbol_name"), F.col("user_id").cast("string").alias("symbol_path"), k.alias("hit_count"))).alias("value"))
    bad = s.range(3).select(F.concat(F.lit('{"symbol_name": '), F.col("id").cast("string")).alias("value"))
    return usage_of(rows.unionByName(bad)).select(F.col("symbol_path").cast("long").alias("user_id"), "hit_count")


EVENTS_SQL = "SELECT event_id AS seq, 'TestU' || CAST(user_id AS VARCHAR) || '_a' AS test, user_id, value, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'pass' WHEN 'view' THEN 'skip' WHEN 'purchase' THEN 'output' ELSE 'run' END AS action FROM events"
SESSIONS_SQL = f"SELECT *, sum(b) OVER (PARTITION BY test ORDER BY seq) AS session FROM (SELECT *, CASE WHEN action = 'run' OR coalesce(lag(action) OVER (PARTITION BY test ORDER BY seq) IN ('pass', 'fail', 'skip'), false) THEN 1 ELSE 0 END AS b FROM ({EVENTS_SQL}))"
RESULTS_SQL = f"SELECT test, max(CASE WHEN action IN ('pass', 'fail', 'skip') THEN action END) AS status, max(CASE WHEN action IN ('pass', 'fail', 'skip') THEN seq END) AS seq, 'U' || CAST(max(user_id) AS VARCHAR) AS target_symbol, CAST(floor(max(CASE WHEN action IN ('pass', 'fail', 'skip') THEN value END) * 1000) AS BIGINT) AS duration_ms, min(CASE WHEN action = 'output' THEN seq END) AS first_output FROM ({SESSIONS_SQL}) GROUP BY test, session HAVING max(CASE WHEN action IN ('pass', 'fail', 'skip') THEN action END) IS NOT NULL"


@query(f"SELECT test, status, seq, target_symbol, duration_ms, CASE WHEN first_output IS NULL THEN '' ELSE 'user: ' || CAST(first_output AS VARCHAR) END AS error_message FROM ({RESULTS_SQL})")
def test_event_state(s, d):
    return telemetry.test_results(A.test_events(s, d)).select("test", "status", "seq", "target_symbol", "duration_ms", "error_message")


def stream_root(s) -> str:
    stateful.stored_state(s)
    return f"{graph.shared_folder(s)}/stream-{uuid.uuid4().hex}"


@query(f"SELECT test, status, seq, target_symbol, duration_ms, CASE WHEN first_output IS NULL THEN '' ELSE 'user: ' || CAST(first_output AS VARCHAR) END AS error_message FROM ({RESULTS_SQL})")
def test_event_stream(s, d):
    """The same from a stream in three batches, whose state holds what a test has said so far."""
    rows = A.test_events(s, d)
    return jobs.run_in_batches(rows, "seq", 3, stream_root(s), lambda r: stateful.test_results(r, forget_ms=60 * 86_400_000)).select("test", "status", "seq", "target_symbol", "duration_ms", "error_message")


@query(f"SELECT test, status, seq FROM ({RESULTS_SQL}) WHERE status = 'fail' ORDER BY seq DESC LIMIT 50")
def health_report(s, d):
    return telemetry.health_report(telemetry.test_results(A.test_events(s, d)), fails=True).select("test", "status", "seq")


@query(f"SELECT target_symbol, count(*) AS fragility FROM ({RESULTS_SQL}) WHERE status = 'fail' GROUP BY 1")
def fragility(s, d):
    return telemetry.fragility(telemetry.test_results(A.test_events(s, d)))


@query("SELECT conv_id AS ledger, turn, CAST(used AS BIGINT) AS tokens_used, used <= 300 AND r <= 4 AS inside FROM (SELECT conv_id, turn, sum(CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)")
def budget(s, d):
    rows = A.table(s, d, "conversations").select(F.col("conv_id").alias("ledger"), "turn", "text")
    return telemetry.budget(rows, 300, 4).select("ledger", "turn", "tokens_used", "inside")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def session_ring(s, d):
    """A stream of turns in three batches; each session's newest are all that its state holds."""
    rows = A.table(s, d, "conversations").select("conv_id", "turn", "role")
    rings = jobs.run_in_batches(rows, "turn", 3, stream_root(s), lambda r: stateful.ring(r, ["conv_id"], "turn", 2))
    return stateful.last_round(rings, ["conv_id"]).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def newest_rows(s, d):
    return telemetry.newest(A.table(s, d, "conversations"), ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn", "role")


# ---- relational store ---------------------------------------------------------------------------


@query(f"SELECT id, name, path FROM ({SYMBOLS_SQL}) WHERE path ILIKE '/PKG1/%'")
def path_prefix(s, d):
    return store.symbols_of(A.symbols(s, d), path_prefix="/PKG1/").select("id", "name", "path")


@query(f"SELECT id, name FROM ({SYMBOLS_SQL}) WHERE type = 'method'")
def symbol_type_eq(s, d):
    return store.symbols_of(A.symbols(s, d), "method").select("id", "name")


@query(f"SELECT id, name FROM ({SYMBOLS_SQL}) WHERE path = '/pkg3/f3.go' AND NOT (start_line > 30 OR end_line < 10)")
def range_overlap(s, d):
    return store.overlapping(A.symbols(s, d), "/pkg3/f3.go", 10, 30).select("id", "name")


@query(f"SELECT id, name, path FROM ({SYMBOLS_SQL}) WHERE name = 'Sym{SEED}' AND path = '/pkg3/f3.go'")
def name_in_file(s, d):
    return store.name_in_file(A.symbols(s, d), f"Sym{SEED}", "/pkg3/f3.go").select("id", "name", "path")


@query(f"SELECT * FROM ({EDGES_SQL}) WHERE callee = 'Sym{SEED}'")
def callers(s, d):
    return graph.callers(A.edges(s, d), f"Sym{SEED}", None)


@query(f"SELECT * FROM ({EDGES_SQL}) WHERE caller = 'Sym{SEED}' ORDER BY callee, path, line, link_type LIMIT 10")
def callees(s, d):
    return graph.callees(A.edges(s, d), f"Sym{SEED}", 10)


@query(f"SELECT id, name, path FROM ({SYMBOLS_SQL}) s WHERE NOT EXISTS (SELECT 1 FROM ({EDGES_SQL}) e WHERE e.callee = s.name) AND path NOT ILIKE '%_test.go' AND name GLOB '[a-z]*' AND name NOT IN ('main', 'init')")
def unused_symbols(s, d):
    return store.unused(A.symbols(s, d), A.edges(s, d), limit=None).select("id", "name", "path")


@query(f"SELECT (SELECT count(DISTINCT path) FROM ({SYMBOLS_SQL})) AS files, (SELECT count(*) FROM part) AS symbols")
def stats(s, d):
    return store.stats(A.symbols(s, d).select("path").distinct(), A.symbols(s, d))


@query(f"SELECT path, string_agg(type || ' ' || name || ' [' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ']', chr(10) ORDER BY start_line, name) AS skeleton FROM ({SYMBOLS_SQL}) GROUP BY path")
def map_by_file(s, d):
    return store.map_by_file(A.symbols(s, d))


OLD, NEW = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0", "SELECT c_custkey, c_name || '!' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0"


def customers(s, d):
    c = A.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))


MERGED = f"SELECT * FROM ({NEW}) UNION ALL SELECT * FROM ({OLD}) WHERE c_custkey NOT IN (SELECT c_custkey FROM ({NEW}))"


@query(MERGED)
def upsert(s, d):
    return store.upsert(*customers(s, d), ["c_custkey"])


@query(MERGED)
def replace_files(s, d):
    old, new = customers(s, d)
    return store.replace_files(old, new, "c_custkey")


@query(f"SELECT o.c_custkey, o.c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM ({OLD}) o LEFT JOIN ({NEW}) n USING (c_custkey)")
def bulk_update(s, d):
    old, new = customers(s, d)
    return store.bulk_update(old, new.select("c_custkey", F.col("c_acctbal").alias("value")), ["c_custkey"], "c_acctbal")


@query(f"SELECT DISTINCT c_custkey FROM ({OLD}) WHERE c_custkey NOT IN (SELECT c_custkey FROM ({NEW}))")
def orphans(s, d):
    old, new = (x.withColumnRenamed("c_custkey", "path") for x in customers(s, d))
    return store.orphans(old, new).withColumnRenamed("path", "c_custkey")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def insert_ignore(s, d):
    return store.insert_ignore(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT id, path FROM ({SYMBOLS_SQL}) WHERE path NOT IN ('/pkg1/f1.go', '/pkg2/f2.go')")
def cascade_delete(s, d):
    gone = s.createDataFrame([("/pkg1/f1.go",), ("/pkg2/f2.go",)], "path string")
    return store.cascade_delete({"symbols": A.symbols(s, d)}, gone)["symbols"].select("id", "path")


VERSIONS = "SELECT sha256(text) AS h, min(length(text) % 5) AS v FROM documents WHERE source {} 'src4' GROUP BY 1"


@query(f"SELECT coalesce(a.h, b.h) AS name, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'added' WHEN a.v <> b.v THEN 'mangled' ELSE 'unchanged' END AS state FROM ({VERSIONS.format('<=')}) a FULL JOIN ({VERSIONS.format('>=')}) b USING (h)")
def snapshot_diff(s, d):
    docs = A.table(s, d, "documents").select(F.sha2("text", 256).alias("name"), (F.length("text") % 5).alias("v"), "source")
    version = lambda c: docs.where(c).groupBy("name").agg(F.min("v").cast("string").alias("structural_hash")).withColumn("logic_hash", F.lit(""))
    return store.snapshot_diff(version("source <= 'src4'"), version("source >= 'src4'"))


@query(f"SELECT id, runtime_hits FROM ({SYMBOLS_SQL}) ORDER BY runtime_hits DESC, id LIMIT 20 OFFSET 10")
def frecency(s, d):
    return search.frecency(A.symbols(s, d), A.symbols(s, d).select("id"), 20, 10).select("id", "runtime_hits")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 60")
def cursor_page(s, d):
    return store.page(A.table(s, d, "customer").select("c_custkey", "c_name"), store.encode_cursor(60, 30), ["c_custkey"])[0]


# ---- graph --------------------------------------------------------------------------------------


@query(f"SELECT callee, count(*) AS indegree FROM ({EDGES_SQL}) GROUP BY 1")
def indegree(s, d):
    return graph.indegree(A.edges(s, d))


@query(f"SELECT id, coalesce(n, 0) AS centrality FROM ({SYMBOLS_SQL}) LEFT JOIN (SELECT callee, count(*) AS n FROM ({EDGES_SQL}) GROUP BY 1) ON callee = name")
def centrality(s, d):
    return graph.centrality(A.symbols(s, d), A.edges(s, d)).select("id", "centrality")


FAILED = f"SELECT {A.name_sql('(user_id % 500 + 1)')} AS target_symbol FROM events WHERE event_type = 'error'"


@query(
    with_(s=SYMBOLS_SQL, e=EDGES_SQL, f=FAILED)
    + "SELECT id, coalesce(nullif(x.n, 0), t.n, 0) AS centrality, coalesce(g.n, 0) AS fragility FROM s LEFT JOIN (SELECT callee, callee_path, count(*) AS n FROM e GROUP BY 1, 2) x ON x.callee = name AND x.callee_path = path"
    " LEFT JOIN (SELECT callee, count(*) AS n FROM e GROUP BY 1) t ON t.callee = name LEFT JOIN (SELECT target_symbol, count(*) AS n FROM f GROUP BY 1) g ON g.target_symbol = name ORDER BY centrality DESC, fragility DESC, name, path LIMIT 20"
)
def critical(s, d):
    failed = A.table(s, d, "events").where("event_type = 'error'").select(A.symbol_name(F.col("user_id") % 500 + 1).alias("target_symbol"))
    return graph.critical(A.symbols(s, d), A.edges(s, d), failed).select("id", "centrality", "fragility")


SIMPLE = "NOT (e.caller = {0}.caller AND e.path = {0}.path)"


@query(
    with_(
        e=EDGES_SQL,
        one=f"SELECT DISTINCT caller, path, link_type FROM e WHERE callee = 'Sym{SEED}' AND callee_path IN ('/pkg3/f3.go', '')",
        two=f"SELECT DISTINCT one.caller AS c1, one.path AS p1, e.caller, e.path, e.link_type FROM one JOIN e ON e.callee = one.caller AND (e.callee_path = one.path OR e.callee_path = '') WHERE {SIMPLE.format('one')}",
        three=f"SELECT DISTINCT e.caller, e.path, e.link_type FROM two JOIN e ON e.callee = two.caller AND (e.callee_path = two.path OR e.callee_path = '') WHERE {SIMPLE.format('two')} AND NOT (e.caller = c1 AND e.path = p1)",
    )
    + "SELECT caller, path, 1 AS distance, link_type FROM one UNION SELECT caller, path, 2, link_type FROM two UNION SELECT caller, path, 3, link_type FROM three"
)
def blast_radius(s, d):
    return graph.blast_radius(A.edges(s, d), [f"Sym{SEED}"], "/pkg3/f3.go")


@query(
    "WITH RECURSIVE s AS (" + SYMBOLS_SQL + "), e AS (" + EDGES_SQL + f"), a AS (SELECT name, path, 0 AS k FROM s WHERE name = 'Sym{SEED}' AND path = '/pkg3/f3.go' UNION SELECT e.caller, e.path, a.k + 1 FROM e JOIN a ON e.callee = a.name AND (e.callee_path = a.path OR e.callee_path = '') WHERE a.k < 10)"
    " SELECT DISTINCT id, name, path FROM s JOIN (SELECT DISTINCT name, path FROM a) USING (name, path) WHERE path ILIKE '%_test.go' OR (name ILIKE 'Test%' AND type IN ('function', 'method'))"
)
def affected_tests(s, d):
    return graph.affected_tests(A.symbols(s, d), A.edges(s, d), f"Sym{SEED}", "/pkg3/f3.go").select("id", "name", "path")


RIPPLE_SQL = (
    "WITH RECURSIVE e AS (" + EDGES_SQL + "), p AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT callee AS src, caller AS dst FROM e UNION ALL SELECT caller, callee FROM e WHERE link_type IN ('satisfies', 'implements', 'embeds'))),"
    # all nodes are carried from step to step, until a step finds none
    f" r AS (SELECT 'Sym{SEED}' AS node, 0 AS k, 0 AS step, 0 AS latest UNION ALL SELECT node, k, step, max(k) OVER () FROM (SELECT node, min(k) AS k, step FROM (SELECT node, k, step + 1 AS step FROM r WHERE latest = step"
    " UNION ALL SELECT dst, k + 1, step + 1 FROM p JOIN r ON src = node WHERE latest = step AND k = step) GROUP BY node, step)), m AS (SELECT node, min(k) AS k FROM r GROUP BY 1)"
    " SELECT caller, callee, path, line, callee_path, link_type, CAST(min(k) + 1 AS INTEGER) AS depth FROM (SELECT e.*, k FROM e JOIN m ON callee = node UNION ALL SELECT e.*, k FROM e JOIN m ON caller = node WHERE link_type IN ('satisfies', 'implements', 'embeds')) GROUP BY ALL"
)


@query(RIPPLE_SQL.replace("GROUP BY ALL", "GROUP BY caller, callee, path, line, callee_path, link_type"))
def ripple(s, d):
    return graph.ripple(A.edges(s, d), f"Sym{SEED}")


@query(
    with_(c=COMMITS_SQL, n="SELECT commit FROM c GROUP BY commit ORDER BY max(ts) DESC, commit LIMIT 500", f="SELECT DISTINCT commit, path FROM c WHERE commit IN (SELECT commit FROM n)", k="SELECT path, count(*) AS commits FROM f GROUP BY 1", p="SELECT a.path AS a, b.path AS b, count(*) AS n FROM f a JOIN f b ON a.commit = b.commit AND a.path < b.path GROUP BY 1, 2", t="SELECT path, max(n) AS m FROM (SELECT a AS path, n FROM p UNION ALL SELECT b, n FROM p) GROUP BY 1")
    + "SELECT path, commits, coalesce(m, 0) AS most_together, round(0.5 * commits / (SELECT max(commits) FROM k) + 0.5 * coalesce(m, 0) / (SELECT max(commits) FROM k), 6) AS score FROM k LEFT JOIN t USING (path)"
)
def churn(s, d):
    return rounded(graph.churn(A.commits(s, d)))


WEIGHT = "CASE link_type WHEN 'implements' THEN 10.0 WHEN 'satisfies' THEN 5.0 ELSE 1.0 END"


PAGERANK_SQL = (
    f"WITH RECURSIVE nodes AS (SELECT DISTINCT name AS node FROM ({SYMBOLS_SQL})), size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), raw AS (SELECT caller AS src, callee AS dst, arg_min({WEIGHT}, (line, link_type)) AS w FROM ({EDGES_SQL}) GROUP BY 1, 2),"
    " parts AS MATERIALIZED (SELECT src, dst, CAST(w / sum(w) OVER (PARTITION BY src) AS DOUBLE) AS part FROM raw), ends AS (SELECT DISTINCT src FROM parts),"
    " r AS (SELECT 0 AS k, node, 1.0 / n AS rank, CAST(1 AS DOUBLE) AS change FROM nodes, size UNION ALL SELECT k + 1, node, new, max(abs(new - rank)) OVER () FROM (SELECT r.k, r.node, r.rank, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) AS new FROM r"
    " LEFT JOIN (SELECT dst, sum(rank * part) AS got FROM r JOIN parts ON src = node GROUP BY 1) g ON g.dst = r.node CROSS JOIN (SELECT coalesce(sum(CASE WHEN node NOT IN (SELECT src FROM ends) THEN rank END), 0) AS loose FROM r) CROSS JOIN size WHERE r.change >= 1e-6 AND r.k < 100))"
    " SELECT node, round(rank, 6) AS rank FROM r WHERE k = (SELECT max(k) FROM r)"
)


@query(PAGERANK_SQL)
def pagerank(s, d):
    # a key has one name and a name one key, so keys move and the result alone has names
    links = A.calls(s, d).select(F.col("k1").alias("src"), F.col("k2").alias("dst"), "line", "link_type")
    ranks = graph.pagerank(A.symbols(s, d).select(F.col("id").alias("node")), links)
    return rounded(ranks.select(A.symbol_name(F.col("node")).alias("node"), "rank"))


METHODS_SQL = "SELECT DISTINCT l_suppkey AS t, l_returnflag || CAST(l_linenumber AS VARCHAR) || CAST(quarter(l_shipdate) AS VARCHAR) AS m FROM lineitem"
IFACE_SQL = "SELECT DISTINCT o_orderpriority AS i, l_returnflag || CAST(l_linenumber AS VARCHAR) || CAST(quarter(l_shipdate) AS VARCHAR) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query(f"SELECT t AS type, i AS interface FROM (SELECT i, t, count(*) AS n FROM ({IFACE_SQL}) JOIN ({METHODS_SQL}) USING (m) GROUP BY 1, 2) JOIN (SELECT i, count(*) AS z FROM ({IFACE_SQL}) GROUP BY 1) USING (i) WHERE n = z")
def resolve_interfaces(s, d):
    method = F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.quarter("l_shipdate").cast("string")).alias("method")
    items = A.table(s, d, "lineitem")
    types = items.select(F.col("l_suppkey").alias("name"), method).distinct()
    faces = items.join(A.table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("name"), method).distinct()
    return graph.resolve_interfaces(faces, types)


@query(f"SELECT 'EXP' AS kind, type AS a, name AS b FROM ({SYMBOLS_SQL}) WHERE path = '/pkg3/f3.go' AND name GLOB '[A-Z]*' UNION SELECT 'CALL', caller, callee FROM ({EDGES_SQL}) WHERE path = '/pkg3/f3.go'")
def neighborhood(s, d):
    return graph.neighborhood(A.symbols(s, d), A.edges(s, d), s.createDataFrame([], "path string, import string"), "/pkg3/f3.go")


@query(f"SELECT DISTINCT '  \"' || caller || '\" --> \"' || callee || '\"' AS line FROM ({EDGES_SQL}) WHERE path = '/pkg3/f3.go'")
def call_graph_mermaid(s, d):
    return encode.mermaid_edges(A.edges(s, d).where("path = '/pkg3/f3.go'"))


# ---- scores -------------------------------------------------------------------------------------

RISK = "0.20 * least(1.0, ln(1 + blast) / ln(501.0)) + 0.35 * least(1.0, (id % 60) / 100.0) + 0.15 * churn_score + 0.15 * gap + 0.05 * least(1.0, (end_line - start_line + 1) / 500.0) + 0.10 * pagerank"


@query(
    with_(s=SYMBOLS_SQL, b=f"SELECT callee, count(*) AS n FROM ({EDGES_SQL}) GROUP BY 1", x="SELECT s.*, coalesce(n, 0) AS blast, CASE WHEN replace(path, '.go', '_test.go') IN (SELECT path FROM s) THEN 0.0 ELSE 1.0 END AS gap FROM s LEFT JOIN b ON callee = name", y=f"SELECT id, least(1.0, ({RISK}) * (1 + 0.2 * (id % 3))) AS r FROM x")
    + "SELECT id, round(CAST(r AS DOUBLE), 6) AS risk, CASE WHEN r >= 0.8 THEN 'Critical' WHEN r >= 0.5 THEN 'High' WHEN r >= 0.2 THEN 'Medium' ELSE 'Low' END AS level FROM y"
)
def risk_score(s, d):
    rows = graph.centrality(A.symbols(s, d), A.edges(s, d))
    rows = risk.test_gap(rows, A.symbols(s, d).select("path"))
    value = risk.score(F.col("centrality"), F.col("id") % 60, F.col("churn_score"), F.col("test_gap"), F.col("end_line") - F.col("start_line") + 1, F.col("pagerank"), F.col("id") % 3)
    return rows.select("id", F.round(value, 6).alias("risk"), risk.level(value).alias("level"))


@query("SELECT p_partkey AS id, CAST(4 * p_size + 250 * (p_partkey % 7) AS BIGINT) AS tokens, CASE WHEN p_partkey % 7 >= 5 OR p_partkey % 13 >= 10 OR (p_partkey % 10) / 10.0 >= 0.7 THEN 'high' WHEN p_partkey % 7 >= 2 OR p_partkey % 13 >= 4 OR (p_partkey % 10) / 10.0 >= 0.3 THEN 'medium' ELSE 'low' END AS risk FROM part")
def edit_cost(s, d):
    k = F.col("p_partkey")
    cost = risk.edit_cost(F.col("p_size"), k % 7, k % 13, (k % 10) / 10.0)
    return A.table(s, d, "part").select(k.alias("id"), cost["tokens"].alias("tokens"), cost["risk"].alias("risk"))


LINKS = f"SELECT DISTINCT callee_path AS src, path AS dst FROM ({EDGES_SQL}) WHERE callee_path <> '' AND callee_path <> path"


@query(
    "WITH RECURSIVE k AS (" + LINKS + "), s AS (" + SYMBOLS_SQL + "), t AS (SELECT src AS root, dst AS node, 1 AS depth FROM k UNION SELECT root, dst, depth + 1 FROM t JOIN k ON node = src WHERE depth < 3 AND dst <> root), u AS (SELECT DISTINCT root, node FROM t)"
    " SELECT f.path, f.symbols, f.churn, coalesce(a.n, 0) AS direct, coalesce(b.n, 0) AS transitive FROM (SELECT path, count(*) AS symbols, round(CAST(max(churn_score) AS DOUBLE), 6) AS churn FROM s GROUP BY 1) f LEFT JOIN (SELECT src AS path, count(*) AS n FROM k GROUP BY 1) a USING (path) LEFT JOIN (SELECT root AS path, count(*) AS n FROM u GROUP BY 1) b USING (path)"
)
def file_context(s, d):
    symbols = A.symbols(s, d)
    files = symbols.groupBy("path").agg(F.max("end_line").alias("loc"))
    found = risk.file_context(files, symbols, A.edges(s, d))
    return found.select("path", "symbols", F.round("churn", 6).alias("churn"), F.size("direct_dependents").cast("long").alias("direct"), "transitive")


def diff_lines(s, d):
    """A hunk for each part, files by its path."""
    k = F.col("p_partkey")
    file = F.concat(F.lit("+++ b"), A.symbol_path(k))
    hunk = F.format_string("@@ -1,2 +%d,%d @@ x", F.col("p_size"), k % 5 + 1)
    rows = A.table(s, d, "part").select(k.alias("doc_id"), F.posexplode(F.array(F.lit("diff --git"), file, hunk, F.lit("+x"), F.lit("@@ -3 +90 @@"))).alias("line_no", "line"))
    return rows


RANGES_SQL = f"SELECT substr({A.path_sql('p_partkey')}, 2) AS path, CAST(p_size AS INTEGER) AS start, CAST(p_size + p_partkey % 5 AS INTEGER) AS \"end\" FROM part UNION ALL SELECT substr({A.path_sql('p_partkey')}, 2), 90, 90 FROM part"
TOUCHED = f"SELECT DISTINCT s.id, s.name, s.path FROM ({SYMBOLS_SQL}) s JOIN ({RANGES_SQL}) r ON '/' || r.path = s.path AND s.start_line <= r.\"end\" AND s.end_line >= r.start"


@query(RANGES_SQL)
def git_diff_parse(s, d):
    from tessera.sources.diffs import changed_ranges

    return changed_ranges(diff_lines(s, d))


@query(f"SELECT id FROM ({TOUCHED})")
def diff_symbols(s, d):
    from tessera.sources.diffs import changed_ranges

    ranges = changed_ranges(diff_lines(s, d)).withColumn("path", F.concat(F.lit("/"), "path"))
    return store.in_ranges(A.symbols(s, d), ranges).select("id")


@query(
    "WITH RECURSIVE s AS (" + SYMBOLS_SQL + "), e AS (" + EDGES_SQL + f"), t AS ({TOUCHED}), a AS (SELECT name, path, 0 AS k FROM t UNION SELECT e.caller, e.path, a.k + 1 FROM e JOIN a ON e.callee = a.name AND (e.callee_path = a.path OR e.callee_path = '') WHERE a.k < 10)"
    " SELECT DISTINCT name, path FROM s JOIN (SELECT DISTINCT name, path FROM a) USING (name, path) WHERE path ILIKE '%_test.go' OR (name ILIKE 'Test%' AND type IN ('function', 'method'))"
)
def predict_tests(s, d):
    diff = diff_lines(s, d).withColumn("line", F.regexp_replace("line", "^\\+\\+\\+ b/pkg", "+++ b//pkg"))
    return risk.predict_tests(diff, A.symbols(s, d), A.edges(s, d)).select("name", "path")


# ---- search -------------------------------------------------------------------------------------

TOKENS_SQL = "SELECT id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS token FROM (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS a FROM documents)"
PHRASE_SQL = f"SELECT a.id, a.pos FROM ({TOKENS_SQL}) a JOIN ({TOKENS_SQL}) b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND starts_with(b.token, 'the')"


INDEXES: dict[tuple[str, str], segments.Segments] = {}


def texts(s, d):
    return A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def changed_index(s, d) -> segments.Segments:
    """The documents' index after a change: of every eleventh an earlier version was there first, and of some a document that is gone."""
    now = texts(s, d)
    stale = now.where("id % 11 = 3").select("id", F.reverse("text").alias("text"))
    gone = now.where("id % 11 = 5").select((-F.col("id") - 1).alias("id"), "text")
    before = now.where("id % 11 <> 3").unionByName(stale).unionByName(gone)
    first = segments.Segments(f"{graph.shared_folder(s)}/index-{uuid.uuid4().hex}", ("text",)).changed(before)
    return first.changed(now.where("id % 11 = 3"), stale.unionByName(gone))


def index(s, d) -> search.Stored:
    """Kept for the session: of a folder's tables, which do not change while it is open."""
    key = (s.sparkContext.applicationId, d)
    if key not in INDEXES:
        INDEXES[key] = changed_index(s, d)
    return INDEXES[key].stored(s)


@query(f"SELECT (SELECT count(*) FROM documents) AS n, count(*) AS tokens, count(DISTINCT token) AS words FROM ({TOKENS_SQL})")
def index_build(s, d):
    """Build the segments and change them: the facts that follow from what is live; always built anew, so that its time is that of a build."""
    built = changed_index(s, d)
    INDEXES[(s.sparkContext.applicationId, d)] = built
    words = built.stored(s).postings.agg(F.countDistinct("token").alias("words"))
    return words.select(F.lit(built.rows).cast("long").alias("n"), F.lit(built.tokens).cast("long").alias("tokens"), "words")


BEST_SQL = with_(t=TOKENS_SQL, tf="SELECT id, CAST(count(*) AS DOUBLE) AS tf FROM t WHERE token = 'thre' GROUP BY 1", ln="SELECT id, count(*) AS len FROM t GROUP BY 1", g="SELECT (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM t) AS tokens, (SELECT CAST(count(*) AS DOUBLE) FROM tf) AS df", r="SELECT id, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * n / tokens)) AS relevance FROM tf JOIN ln USING (id), g") + "SELECT id, round(relevance, 6) AS relevance FROM r ORDER BY r.relevance, id LIMIT 15"


@query(BEST_SQL)
def best_of_word(s, d):
    """The best rows of a word from its ranked classes, without those that cannot hold one."""
    index(s, d)
    return rounded(INDEXES[(s.sparkContext.applicationId, d)].best(s, "thre", 15)[0])


@query(f"SELECT id, CAST(pos AS INTEGER) AS pos FROM ({PHRASE_SQL})")
def fts_match(s, d):
    return search.phrase_match(index(s, d), "of the*").select("id", F.col("pos").cast("int").alias("pos"))


BM25_SQL = with_(t=TOKENS_SQL, tf=f"SELECT id, CAST(count(*) AS DOUBLE) AS tf FROM ({PHRASE_SQL}) GROUP BY 1", ln="SELECT id, count(*) AS len FROM t GROUP BY 1", g="SELECT (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM t) AS tokens, (SELECT CAST(count(*) AS DOUBLE) FROM tf) AS df") + "SELECT id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * n / tokens)), 6) AS relevance FROM tf JOIN ln USING (id), g"


@query(BM25_SQL)
def bm25(s, d):
    return rounded(search.bm25(index(s, d), texts(s, d).select("id"), "of the*"))


def vectors(s, d):
    return A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def probe(s, d) -> list[float]:
    return list(A.table(s, d, "embeddings").where("vec_id = 0").first()["embedding"])


KNN_SQL = "SELECT vec_id AS id, sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2))) AS distance FROM embeddings ORDER BY distance, id LIMIT 25"


@query(f"SELECT id, round(distance, 6) AS distance FROM ({KNN_SQL})")
def knn(s, d):
    """From a pivot table, built here: the rings that can hold one of the nearest are read."""
    table = nearest.build(vectors(s, d), f"{graph.shared_folder(s)}/vectors-{uuid.uuid4().hex}")
    return rounded(table.knn(probe(s, d), 25)[0])


def fused_sql() -> str:
    text = BM25_SQL.replace("round(-greatest", "(-greatest").replace("tokens)), 6) AS", "tokens))) AS")
    return f"SELECT id, round(coalesce(1.0 / (60 + a.rn), 0) + coalesce(1.0 / (60 + b.rn), 0), 6) AS rrf_score FROM (SELECT id, row_number() OVER (ORDER BY relevance, id) AS rn FROM ({text}) ORDER BY relevance, id LIMIT 100) a FULL JOIN (SELECT id, row_number() OVER (ORDER BY distance, id) AS rn FROM ({KNN_SQL.replace('LIMIT 25', 'LIMIT 100')})) b USING (id) ORDER BY coalesce(1.0 / (60 + a.rn), 0) + coalesce(1.0 / (60 + b.rn), 0) DESC, id LIMIT 20"


@query(fused_sql())
def hybrid_rrf(s, d):
    return rounded(search.hybrid(index(s, d), texts(s, d).select("id"), vectors(s, d), "of the*", probe(s, d)))


@query(f"SELECT id, project FROM ({OBSERVATIONS_SQL}) WHERE contains(lower(content), 'and th') ORDER BY created_at DESC, id DESC LIMIT 15")
def insight_search(s, d):
    return search.insight_search(A.observations(s, d), "And TH", 15).select("id", "project")


NAMES = ["the", "and", "Of", "erea"]


@query(f"SELECT n.symbol_id, o.id AS insight_id FROM (VALUES (0, 'the'), (1, 'and'), (2, 'of'), (3, 'erea')) AS n(symbol_id, w) JOIN ({OBSERVATIONS_SQL}) o ON regexp_matches(o.content, '(?i)\\b' || n.w || '\\b')")
def insight_link(s, d):
    names = s.createDataFrame(list(enumerate(NAMES)), "id int, name string")
    notes = A.observations(s, d).select("id", F.col("content").alias("title"), F.lit("").alias("why"), F.lit("").alias("learned"))
    return search.insight_links(names, notes)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS twin, n FROM (SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1")
def twins(s, d):
    return search.all_twins(A.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query(f"SELECT DISTINCT content FROM ({OBSERVATIONS_SQL}) WHERE project = 'user' AND content NOT IN (SELECT content FROM ({OBSERVATIONS_SQL}) WHERE project <> 'user')")
def passive_distill(s, d):
    notes = A.observations(s, d)
    return search.fresh_memories(notes.where("project = 'user'"), notes.where("project <> 'user'")).select("content").distinct()


# ---- encodings ----------------------------------------------------------------------------------


@query("SELECT r_regionkey + 1 AS pos, CAST(r_regionkey AS VARCHAR) || ' | ' || r_name AS line FROM region UNION ALL SELECT 0, '@(5)[r_regionkey | r_name]'")
def zon(s, d):
    return encode.zon(A.table(s, d, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])


IDS_SQL = f"SELECT path, row_number() OVER (ORDER BY first, path) AS path_id FROM (SELECT path, min(id) AS first FROM ({SYMBOLS_SQL}) GROUP BY 1)"


@query(f"SELECT CAST(path_id AS INTEGER) AS path_id, concat_ws('|', 'S', path_id, name, type, start_line, start_col, signature, doc) AS line FROM ({SYMBOLS_SQL}) JOIN ({IDS_SQL}) USING (path)")
def hakai(s, d):
    symbols = A.symbols(s, d)
    return encode.hakai_symbols(symbols, encode.path_ids(symbols, "id"))


@query("SELECT conv_id, turn, CAST(sum(t) OVER w AS BIGINT) AS tokens_so_far, CASE WHEN sum(t) OVER w > 2000 THEN 'COLD' WHEN sum(t) OVER w > 500 THEN 'WARM' ELSE 'HOT' END AS state FROM (SELECT conv_id, turn, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS t FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def context_state(s, d):
    return encode.context_state(A.table(s, d, "conversations"), "conv_id", "turn", S.estimate_tokens(F.col("text"))).select("conv_id", "turn", "tokens_so_far", "state")


def part_sql(c: str) -> str:
    return f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)"


@query(f"SELECT path, sha256(string_agg(x, '' ORDER BY x)) AS digest FROM (SELECT path, {' || '.join(map(part_sql, ['path', 'name', 'type', 'start_line']))} AS x FROM ({SYMBOLS_SQL})) GROUP BY 1")
def symbol_digest(s, d):
    return encode.symbol_digest(A.symbols(s, d), "path")


@query(f"SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(h, '' ORDER BY h)) AS hash FROM (SELECT DISTINCT path, sha256(path) AS h FROM ({SYMBOLS_SQL})) GROUP BY 1")
def dir_hash(s, d):
    files = A.symbols(s, d).select("path").distinct().select("path", F.sha2("path", 256).alias("hash"))
    return store.directory_hashes(files).where("path <> ''")


@query(f"SELECT day, commands, input_tokens, output_tokens, saved_tokens, printf('%.1f', avg_savings) AS savings_pct FROM (SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS commands, {SUMS} FROM ({COMMANDS_SQL}) GROUP BY 1)")
def csv_export(s, d):
    from tessera.sources.sinks import gain_csv

    return gain_csv(telemetry.daily(A.commands(s, d)))


@query(f"SELECT path, CAST(count(*) AS BIGINT) AS n FROM ({SYMBOLS_SQL}) GROUP BY 1")
def export_delta(s, d):
    from tessera.sources.sinks import delta

    return delta(A.symbols(s, d), A.edges(s, d)).where("symbols is not null").select("path", F.size("symbols").cast("long").alias("n"))


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL OR a.h <> b.h THEN 'parse' WHEN a.m <> b.m THEN 'touch' ELSE 'skip' END AS action FROM (SELECT c_custkey AS path, c_custkey % 5 AS h, c_nationkey AS m FROM customer WHERE c_custkey % 4 <> 0) a RIGHT JOIN (SELECT c_custkey AS path, c_custkey % 5 + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS h, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS m FROM customer) b ON a.path = b.path")
def incremental_index(s, d):
    c = A.table(s, d, "customer")
    k = F.col("c_custkey")
    known = c.where(k % 4 != 0).select(k.alias("path"), (k % 5).alias("hash"), F.col("c_nationkey").alias("mtime"))
    present = c.select(k.alias("path"), (k % 5 + F.when(k % 6 == 0, 1).otherwise(0)).alias("hash"), (F.col("c_nationkey") + F.when(k % 7 == 0, 1).otherwise(0)).alias("mtime"))
    return jobs.incremental(known, present).select("path", "action")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_rollup(s, d):
    """A stream of events in three batches, in order of time; the last rows are of a day after all others and close their windows."""
    rows = A.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    end = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    out = jobs.run_in_batches(rows.unionByName(end), "ts", 3, stream_root(s), lambda r: jobs.windowed_usage(r, "ts", ["event_type"], "value"))
    return out.where("event_type is not null").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


WORDS_SQL = "SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents"


@query(
    f"WITH s AS (SELECT doc_id, list_transform(w, lambda x: CAST('0x' || left(md5(x), 8) AS BIGINT) % 16) AS a FROM ({WORDS_SQL})), c AS (SELECT doc_id, list_transform(range(16), lambda i: CAST(len(list_filter(a, lambda y: y = i)) AS DOUBLE)) AS c FROM s)"
    " SELECT doc_id, CAST(i AS INTEGER) AS slot, round(CASE WHEN n = 0 THEN 0 ELSE c[i + 1] / n END, 3) AS weight FROM (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n, unnest(range(16)) AS i FROM c)"
)
def embed(s, d):
    rows = A.table(s, d, "documents").select("doc_id", V.hash_embedder(16)(F.col("text")).alias("embedding"))
    return rows.select("doc_id", F.posexplode("embedding").alias("slot", "weight")).withColumn("weight", F.round(F.col("weight").cast("double"), 3))


from tessera.plans import more_queries, outside_queries, source_queries, spec_queries  # noqa: E402, F401  adds their queries
