"""The driver's tables as the engine's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lines as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> L.Stream:
    return L.of_texts(table(spark, sf_dir, "documents"))


def split_sql(source: str, key: str, text: str, as_key: str = "doc_id") -> str:
    body = f"regexp_replace(coalesce({text}, ''), '\\n\\z', '')"
    return f"SELECT {as_key}, CAST(unnest(range(len(a))) AS DOUBLE) AS line_no, unnest(a) AS line FROM (SELECT {key} AS {as_key}, string_split({body}, chr(10)) AS a FROM {source})"


LINES_SQL = split_sql("documents", "doc_id", "text")


def symbol_name(k: Column) -> Column:
    return F.concat(F.when(k % 3 == 0, "Sym").otherwise("sym"), k.cast("string"))


def symbol_path(k: Column) -> Column:
    return F.concat(F.lit("/pkg"), (k % 7).cast("string"), F.lit("/f"), (k % 50).cast("string"), F.when(k % 10 == 0, "_test.go").otherwise(".go"))


def name_sql(k: str) -> str:
    return f"(CASE WHEN {k} % 3 = 0 THEN 'Sym' ELSE 'sym' END || CAST({k} AS VARCHAR))"


def path_sql(k: str) -> str:
    return f"('/pkg' || CAST({k} % 7 AS VARCHAR) || '/f' || CAST({k} % 50 AS VARCHAR) || CASE WHEN {k} % 10 = 0 THEN '_test.go' ELSE '.go' END)"


TYPES = ["function", "method", "class", "interface"]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each part."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), symbol_name(k).alias("name"), kind.alias("type"), F.lit("").alias("package_path"), symbol_path(k).alias("path"),
        F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + k % 40).cast("int").alias("end_line"), F.lit(0).alias("start_col"),
        F.col("p_brand").alias("signature"), F.col("p_name").alias("doc"), F.col("p_type").alias("structural_hash"), F.lit("").alias("logic_hash"),
        (k % 11).cast("long").alias("runtime_hits"), ((k % 10) / 10.0).alias("churn_score"), ((k % 100) / 1000.0).alias("pagerank"),
        F.format_string('{"cyclomatic": 1, "cognitive": %d}', k % 60).alias("metrics_json"), (k * 10).cast("long").alias("start_byte"), (k * 10 + 7).cast("long").alias("end_byte"), (k % 30 * 1.0).alias("relevance"),
    )


SYMBOLS_SQL = f"""SELECT p_partkey AS id, {name_sql("p_partkey")} AS name,
 CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'interface' END AS type, '' AS package_path,
 {path_sql("p_partkey")} AS path, CAST(p_size AS INTEGER) AS start_line, CAST(p_size + p_partkey % 40 AS INTEGER) AS end_line, 0 AS start_col,
 p_brand AS signature, p_name AS doc, p_type AS structural_hash, '' AS logic_hash, CAST(p_partkey % 11 AS BIGINT) AS runtime_hits,
 (p_partkey % 10) / 10.0 AS churn_score, (p_partkey % 100) / 1000.0 AS pagerank FROM part"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k1, k2, line, link_type): a call of parts' keys for each pair of consecutive line items of an order."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k1"), "l_returnflag")
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("k2"))
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "implements").otherwise("satisfies")
    return a.join(b, ["l_orderkey", "n"]).select("k1", "k2", F.col("n").cast("int").alias("line"), kind.alias("link_type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call of symbols for each one of parts, once."""
    pairs = calls(spark, sf_dir).distinct()
    callee_path = F.when(F.col("link_type") == "satisfies", "").otherwise(symbol_path(F.col("k2")))
    return pairs.select(symbol_name(F.col("k1")).alias("caller"), symbol_name(F.col("k2")).alias("callee"), symbol_path(F.col("k1")).alias("path"), "line", callee_path.alias("callee_path"), "link_type")


EDGES_SQL = f"""SELECT {name_sql("k1")} AS caller, {name_sql("k2")} AS callee, {path_sql("k1")} AS path, line,
 CASE WHEN link_type = 'satisfies' THEN '' ELSE {path_sql("k2")} END AS callee_path, link_type FROM (
 SELECT DISTINCT a.l_partkey AS k1, b.l_partkey AS k2, CAST(a.l_linenumber AS INTEGER) AS line,
 CASE a.l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'implements' ELSE 'satisfies' END AS link_type
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.floor(F.abs(F.col("value")) * 100).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("original_cmd"), tokens.alias("input_tokens"), F.floor(tokens / 2).cast("long").alias("output_tokens"), (F.col("event_id") % 1000).cast("long").alias("exec_time_ms"))
    return rows.withColumn("saved_tokens", F.col("input_tokens") - F.col("output_tokens"))


COMMANDS_SQL = """SELECT event_id AS id, ts AS timestamp, event_type AS original_cmd, CAST(floor(abs(value) * 100) AS BIGINT) AS input_tokens,
 CAST(floor(abs(value) * 100) AS BIGINT) // 2 AS output_tokens, CAST(event_id % 1000 AS BIGINT) AS exec_time_ms,
 CAST(floor(abs(value) * 100) AS BIGINT) - CAST(floor(abs(value) * 100) AS BIGINT) // 2 AS saved_tokens FROM events"""

STATUS = {"error": "fail", "click": "pass", "view": "skip", "purchase": "output", "signup": "run"}


def test_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event of a user's test for each row."""
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    output = F.concat(F.lit("--- FAIL: x\nuser: "), F.col("event_id").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("pkg").alias("package"), F.concat(F.lit("TestU"), F.col("user_id").cast("string"), F.lit("_a")).alias("test"), action.alias("action"), F.when(action == "output", output).otherwise("").alias("output"), F.col("value").alias("elapsed"), F.col("ts").cast("timestamp").alias("time"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), F.col("event_type").alias("environment"), hits.alias("hit_count"), F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("last_used"))


USAGE_SQL = "SELECT user_id AS symbol_id, event_type AS environment, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS hit_count, CAST(floor(epoch(ts)) AS BIGINT) AS last_used FROM events"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("project"), F.col("text").alias("content"), F.col("turn").alias("created_at"))


OBSERVATIONS_SQL = "SELECT conv_id * 1000 + turn AS id, role AS project, text AS content, turn AS created_at FROM conversations"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, suppliers as files."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    return items.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts")), "commit")


COMMITS_SQL = "SELECT DISTINCT l_orderkey AS commit, o_orderdate AS ts, 's' || CAST(l_suppkey AS VARCHAR) AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
