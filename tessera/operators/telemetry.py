"""Command telemetry: totals, calendar roll-ups, usage counts and test results."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.strings import estimate_tokens, map_test_to_symbol, redact_secrets, savings_pct, trim, week_of_year

RETENTION_DAYS = 90
BLOCKS = "▁▂▃▄▅▆▇█"


def prepare(commands: DataFrame) -> DataFrame:
    """Redacted commands with saved tokens and their percentage."""
    saved = F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0))
    return commands.withColumn("original_cmd", redact_secrets(F.col("original_cmd"))).withColumn("saved_tokens", saved).withColumn("savings_pct", savings_pct(F.col("saved_tokens"), F.col("input_tokens")))


def retain(commands: DataFrame, now: datetime.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    return commands.where(F.col("timestamp") >= moment(commands, now - datetime.timedelta(days=days)))


def moment(commands: DataFrame, at: datetime.datetime) -> Column:
    """A wall-clock time in the type, and so the zone, of the commands' times."""
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(commands.schema["timestamp"].dataType)


def summary(commands: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return commands.agg(
        F.count("*").alias("total_commands"),
        zero("saved_tokens").alias("total_saved"),
        savings_pct(zero("saved_tokens"), zero("input_tokens")).alias("avg_savings"),
        zero("exec_time_ms").alias("total_time_ms"),
    )


def sums() -> list[Column]:
    return [
        F.count("*").alias("commands"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum("saved_tokens").cast("long").alias("saved_tokens"),
        savings_pct(F.sum("saved_tokens"), F.sum("input_tokens")).alias("avg_savings"),
    ]


def rollup(commands: DataFrame, period: Column, name: str, now: datetime.datetime | None, days: int | None) -> DataFrame:
    if now is not None and days is not None:
        commands = retain(commands, now, days)
    return commands.groupBy(period.alias(name)).agg(*sums()).orderBy(F.desc(name))


def daily(commands: DataFrame, now: datetime.datetime | None = None, days: int = 30) -> DataFrame:
    return rollup(commands, F.date_format("timestamp", "yyyy-MM-dd"), "day", now, days)


def weekly(commands: DataFrame, now: datetime.datetime | None = None, weeks: int = 12) -> DataFrame:
    return rollup(commands, week_of_year(F.col("timestamp")), "period", now, 7 * weeks)


def monthly(commands: DataFrame, now: datetime.datetime | None = None, months: int = 12) -> DataFrame:
    return rollup(commands, F.date_format("timestamp", "yyyy-MM"), "period", now, 30 * months)


def by_command(commands: DataFrame, limit: int = 10) -> DataFrame:
    return commands.groupBy("original_cmd").agg(*sums()).withColumnRenamed("commands", "count").orderBy(F.desc("saved_tokens"), "original_cmd").limit(limit)


def recent(commands: DataFrame, limit: int = 10) -> DataFrame:
    return commands.orderBy(F.desc("id")).limit(limit)


def sparkline(days: DataFrame, value: str = "saved_tokens", last: int = 14) -> DataFrame:
    """The last days with a block as high as their part of the largest."""
    kept = days.orderBy(F.desc("day")).limit(last)  # ``last`` rows
    most = F.max(value).over(Window.partitionBy())
    level = F.when(most > 0, F.floor(F.col(value) / most * 7)).otherwise(0).cast("int")
    return kept.withColumn("level", level).withColumn("block", F.element_at(F.array(*[F.lit(b) for b in BLOCKS]), F.col("level") + 1))


def density(avg_savings: Column) -> Column:
    """How many times more fits into the same room; 99.9 at most."""
    return F.when(avg_savings >= 100, 99.9).otherwise(F.least(100.0 / (100.0 - avg_savings), F.lit(99.9)))


def tier(pct: Column) -> Column:
    return F.when(pct >= 90, "Elite").when(pct >= 75, "Great").when(pct >= 50, "Good").when(pct >= 25, "Fair").otherwise("Low")


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Hits added up and the last use for each symbol and environment; counts of zero or less are one hit."""
    hits = F.when(F.coalesce("hit_count", F.lit(0)) <= 0, 1).otherwise(F.col("hit_count"))
    return usage.groupBy("symbol_id", "environment").agg(F.sum(hits).cast("long").alias("hit_count"), F.max("last_used").alias("last_used"))


def resolve_usage(usage: DataFrame, symbols: DataFrame) -> DataFrame:
    """usage (symbol_name, symbol_path, ...) with the ids of the symbols meant.

    A name is a short or a full name; an empty path meets any. Two equi joins and no
    OR, so both stay hash joins.
    """
    full = F.when(F.coalesce("package_path", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "package_path", "name"))
    names = symbols.select(F.col("id").alias("symbol_id"), "path", F.explode(F.array_distinct(F.array(F.col("name"), full))).alias("symbol_name"))
    rows = usage.withColumn("_row", F.monotonically_increasing_id())
    exact = rows.where("symbol_path <> ''").join(names.withColumnRenamed("path", "symbol_path"), ["symbol_name", "symbol_path"])
    loose = rows.where("symbol_path = ''").join(names.drop("path"), "symbol_name")
    return exact.unionByName(loose).dropDuplicates(["_row", "symbol_id"]).drop("_row")


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive upsert: counts add up, the later use stays."""
    return old.unionByName(new).groupBy("symbol_id", "environment").agg(F.sum("hit_count").alias("hit_count"), F.max("last_used").alias("last_used"))


def test_results(events: DataFrame) -> DataFrame:
    """A row for each finished test of ordered events (seq, package, test, action, output, elapsed).

    The output counts from the last ``run`` or finish before; events without a test are left out.
    """
    known = events.where("test is not null and test <> ''")
    order = Window.partitionBy("package", "test").orderBy("seq")
    begins = F.col("action").isin("run") | F.lag("action").over(order).isin("pass", "fail", "skip")
    runs = known.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int")).withColumn("session", F.sum("begins").over(order))
    ends = F.col("action").isin("pass", "fail", "skip")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == "output", F.struct("seq", "output")))), lambda x: x["output"]), "")
    done = runs.groupBy("package", "test", "session").agg(F.max(F.when(ends, F.col("action"))).alias("status"), F.max(F.when(ends, F.col("seq"))).alias("seq"), F.max(F.when(ends, F.col("elapsed"))).alias("elapsed"), text.alias("output")).where("status is not null")
    return described(done)


def described(done: DataFrame) -> DataFrame:
    """Results of finished tests (package, test, seq, status, elapsed, output): their message, trace, time and symbol."""
    lines = F.split("output", "\n")
    fail = F.array_position(F.transform(lines, lambda x: x.contains("--- FAIL:")), F.lit(True))
    after = F.when(fail > 0, F.filter(F.slice(lines, fail.cast("int") + 1, F.size(lines)), lambda x: (trim(x) != "") & ~x.contains("--- FAIL:"))).otherwise(F.array().cast("array<string>"))
    return done.select(
        "package", "test", "seq", "status",
        F.coalesce(trim(F.get(F.filter(after, lambda x: x.contains(":")), F.lit(0))), F.lit("")).alias("error_message"),
        F.array_join(after, "\n").alias("stack_trace"),
        F.floor(F.coalesce("elapsed", F.lit(0.0)) * 1000).cast("long").alias("duration_ms"),
        map_test_to_symbol(F.col("test")).alias("target_symbol"),
    )


def health_report(results: DataFrame, symbol: str | None = None, fails: bool = False, limit: int = 50) -> DataFrame:
    """Newest test results, of one symbol or failures only if asked."""
    if symbol is not None:
        results = results.where(F.col("target_symbol") == symbol)
    if fails:
        results = results.where("status = 'fail'")
    return results.orderBy(F.desc("seq"), "package", "test").limit(limit)


def fragility(results: DataFrame) -> DataFrame:
    return results.where("status = 'fail'").groupBy("target_symbol").agg(F.count("*").alias("fragility"))


def budget(turns: DataFrame, limit: int = 100_000, most_turns: int = 10) -> DataFrame:
    """Turns (ledger, turn, text) with tokens so far, and whether each is still inside both limits."""
    so_far = Window.partitionBy("ledger").orderBy("turn")
    used = F.sum(estimate_tokens(F.col("text"))).over(so_far)
    return turns.withColumn("tokens_used", used).withColumn("inside", (used <= limit) & (F.row_number().over(so_far) <= most_turns))


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
