"""The relational store: schemas, replacement by file, merges and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.strings import fqn, path_starts

METRICS = "struct<cyclomatic:int,cognitive:int,has_loop:boolean,has_error:boolean,is_async:boolean>"
# fixed values: tables of the data model, with the defaults of added columns
SCHEMAS: dict[str, str] = {
    "file_index": "path string, hash string, mtime long, ast_json string",
    "directory_hashes": "path string, hash string",
    "symbols": "id long, name string, type string, package_path string, receiver_type string, signature string, doc string, path string, start_byte long, end_byte long, start_line int, start_col int, end_line int, structural_hash string, logic_hash string, relevance double, pagerank double, churn_score double, runtime_hits long, metrics_json string",
    "calls": "caller string, callee string, path string, line int, callee_path string, link_type string",
    "dependencies": "name string, version string, manifest string, direct boolean",
    "test_results": "test string, status string, error_message string, stack_trace string, duration_ms long, target_symbol string, project string",
    "violations": "rule_id string, severity string, message string, file_path string, line int, snippet string",
    "symbol_usage": "symbol_id long, environment string, last_used long, hit_count long",
    "flows": "source string, sink string, type string, path string, line int",
    "vec_symbols": "symbol_id long, embedding array<float>",
    "commands": "id long, timestamp timestamp, original_cmd string, output_cmd string, input_tokens long, output_tokens long, saved_tokens long, savings_pct double, exec_time_ms long",
    "observations": "id long, project string, content string, created_at timestamp",
}
DEFAULTS = {"link_type": "call", "relevance": 0.0, "pagerank": 0.0, "churn_score": 0.0, "runtime_hits": 0, "hit_count": 0}
PATH_COLUMN = {"file_index": "path", "symbols": "path", "calls": "path", "flows": "path", "violations": "file_path"}
EDGE_KEY = ["caller", "callee", "path", "line", "link_type"]
LINK_TYPES = ["call", "implements", "satisfies", "embeds", "dynamic", "reference", "ssa-call"]


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Columns of ``wanted`` in order and type; missing and null ones get their default if they have one."""

    def column(f: T.StructField) -> Column:
        have = F.col(f.name) if f.name in df.columns else F.lit(None)
        return F.coalesce(have.cast(f.dataType), F.lit(DEFAULTS.get(f.name)).cast(f.dataType)).alias(f.name)

    return df.select(*[column(f) for f in wanted])


def symbol_id(path: Column, name: Column, start: Column) -> Column:
    return F.xxhash64(path, name, start)


def parse_metrics(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("metrics", F.from_json("metrics_json", METRICS))


def clear_paths(table: DataFrame, paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows of other files than ``paths`` (path)."""
    return table.join(paths.select(F.col("path").alias("_p")), table[column] == F.col("_p"), "left_anti")


def replace_files(existing: DataFrame, new: DataFrame, column: str = "path", paths: DataFrame | None = None) -> DataFrame:
    """All rows of the new files in place of their old ones."""
    changed = paths if paths is not None else new.select(F.col(column).alias("path")).distinct()
    return clear_paths(existing, changed, column).unionByName(new)


def save_batch(tables: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table after the files of ``batch["file_index"]`` were replaced in it."""
    paths = batch["file_index"].select("path").distinct()
    out = dict(tables)
    for name, column in PATH_COLUMN.items():
        if name in tables:
            fresh = batch.get(name, tables[name].limit(0))
            if name == "calls":
                fresh = insert_ignore(fresh)
            out[name] = replace_files(tables[name], fresh, column, paths)
    return out


def insert_ignore(edges: DataFrame, key: list[str] = EDGE_KEY) -> DataFrame:
    return edges.dropDuplicates(key)


def cascade_delete(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    return {k: clear_paths(v, paths, PATH_COLUMN[k]) if k in PATH_COLUMN else v for k, v in tables.items()}


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones with their key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "_new")


def bulk_update(table: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` from ``updates`` (keys, value) where there is one, else as it was."""
    value = updates.select(*keys, F.col("value").alias("_v"), F.lit(True).alias("_hit"))
    return table.join(value, keys, "left").withColumn(column, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))).select(*table.columns)


def split_key(updates: DataFrame, key: str = "key") -> DataFrame:
    """(name, path) of keys like name:path, cut at the first colon."""
    return updates.withColumn("name", F.substring_index(key, ":", 1)).withColumn("path", F.expr(f"substring({key}, locate(':', {key}) + 1)"))


def orphans(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that are stored but gone."""
    return stored.select("path").distinct().join(present.select("path"), "path", "left_anti")


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, state): missing, added, mangled or unchanged between two snapshots."""
    a = old.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    b = new.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "added").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("mangled")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def snapshot_diff(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """The same for symbols by structural hash, and logic hash where both have one."""
    a = old.select(name, F.col("structural_hash").alias("_s1"), F.coalesce("logic_hash", F.lit("")).alias("_l1"), F.lit(1).alias("_in_a"))
    b = new.select(name, F.col("structural_hash").alias("_s2"), F.coalesce("logic_hash", F.lit("")).alias("_l2"), F.lit(1).alias("_in_b"))
    changed = ~F.col("_s1").eqNullSafe(F.col("_s2")) | ((F.col("_l1") != "") & (F.col("_l2") != "") & (F.col("_l1") != F.col("_l2")))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "added").when(changed, "mangled").otherwise("unchanged")
    return a.join(b, name, "full_outer").select(name, state.alias("state"))


def snapshot_id(path: Column, at: Column) -> Column:
    """32 hex digits that name the snapshot of a file at a time, the same wherever they are computed."""
    return F.substring(F.sha2(F.concat_ws("-", path, at.cast("string")), 256), 1, 32)


def violations_of(violations: DataFrame, path: str) -> DataFrame:
    """Violations of one file, in order of their lines."""
    return violations.where(F.col("file_path") == path).orderBy("line", "rule_id")


def candidates(symbols: DataFrame, name: str) -> DataFrame:
    """(full, path) of the symbols that a short or full name can mean."""
    full = fqn(F.col("package_path"), F.col("name"))
    return symbols.where((F.col("name") == name) | (full == name)).select(full.alias("full"), "path").distinct()


def symbols_of(symbols: DataFrame, type: str | None = None, path_prefix: str = "") -> DataFrame:  # noqa: A002
    out = symbols.where(path_starts(F.col("path"), path_prefix))
    return out if type is None else out.where(F.col("type") == type)


def overlapping(symbols: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return symbols.where((F.col("path") == path) & ~((F.col("start_line") > end) | (F.col("end_line") < start)))


def in_ranges(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols that a range (path, start, end) touches, each once."""
    r = ranges.select(F.col("path").alias("_p"), "start", "end")
    meets = (symbols["path"] == r["_p"]) & (symbols["start_line"] <= r["end"]) & (symbols["end_line"] >= r["start"])
    return symbols.join(r, meets, "left_semi")


def name_in_file(symbols: DataFrame, name: str, path: str) -> DataFrame:
    return symbols.where((F.col("name") == name) & (F.col("path") == path))


def unused(symbols: DataFrame, edges: DataFrame, include_exported: bool = False, limit: int | None = 100) -> DataFrame:
    """Symbols that no edge calls by name, without entry points and test files."""
    called = edges.select(F.col("callee").alias("_c")).distinct()
    out = symbols.join(called, symbols["name"] == F.col("_c"), "left_anti")
    out = out.where(~F.col("name").isin("main", "init") & ~F.col("path").ilike("%_test.go") & ~F.col("path").ilike("%main.go"))
    if not include_exported:
        out = out.where(F.col("name").rlike("^[a-z]"))
    out = out.orderBy("path", "start_line", "name")
    return out if limit is None else out.limit(limit)


def resolve_name(symbols: DataFrame, name: str) -> tuple[str, str]:
    """The only (full name, path) of a short name; an error lists the candidates if there are more."""
    if "/" in name:
        return name, ""
    found = candidates(symbols, name).withColumnRenamed("full", "f").orderBy("f", "path").limit(21).collect()
    if len(found) != 1:
        listed = ", ".join(f"{r.f} ({r.path})" for r in found)
        raise LookupError(f"no symbol {name!r}" if not found else f"{name!r} is ambiguous: {listed}")
    return found[0].f, found[0].path


def page(df: DataFrame, cursor: str | None, order: list, default: int = 50, most: int = 100) -> tuple[DataFrame, str]:
    """The rows of a cursor and the cursor after them."""
    offset, limit = decode_cursor(cursor, default, most)
    return df.orderBy(*order).offset(offset).limit(limit), encode_cursor(offset + limit, limit)


def encode_cursor(offset: int, limit: int) -> str:
    import base64

    return base64.b64encode(f"{offset}|{limit}".encode()).decode()


def decode_cursor(cursor: str | None, default: int = 50, most: int = 100) -> tuple[int, int]:
    import base64

    if not cursor:
        return 0, default
    try:
        offset, limit = map(int, base64.b64decode(cursor, validate=True).decode().split("|"))
    except ValueError as e:
        raise ValueError("the cursor is not valid") from e
    return max(0, offset), min(max(1, limit), most)


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files")).crossJoin(symbols.agg(F.count("*").alias("symbols")))  # one row each


def map_by_file(symbols: DataFrame, path_prefix: str = "") -> DataFrame:
    """(path, skeleton): a line for each symbol of a file, in order."""
    line = F.concat_ws(" ", F.col("type"), F.col("name").cast("string"), F.concat(F.lit("["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]")))
    rows = symbols_of(symbols, path_prefix=path_prefix).select("path", F.struct("start_line", F.col("name").cast("string").alias("name"), line.alias("line")).alias("s"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("skeleton"))


def directory_hashes(files: DataFrame, levels: int = 32) -> DataFrame:
    """(path, hash) of folders, each from the sorted hashes of what it holds, deepest first."""
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    depth = F.size(F.split("path", "/"))
    rows = files.select("path", "hash").withColumn("depth", depth)
    deepest = min(levels, rows.agg(F.max("depth")).first()[0] or 0)
    from tessera.operators.graph import cut as graph_cut

    folders: list[DataFrame] = []
    for d in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == d)
        if folders:
            here = here.unionByName(folders[-1].withColumn("depth", depth).where(F.col("depth") == d))
        level = here.withColumn("parent", parent).groupBy("parent").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("hash"))
        level = graph_cut(level)  # read by the level above and by the result
        folders.append(level.select(F.col("parent").alias("path"), "hash"))
    return reduce(DataFrame.unionByName, folders) if folders else files.select("path", "hash").limit(0)
