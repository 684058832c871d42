"""Line-stream actions and the pipelines made of them.

A stream is (doc_id, line_no, line), each document a stream of its own; line_no
orders it and is never taken from scan order. Marker rows get places between lines,
so line_no is kept as a double inside and need not be whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.functions import templates
from tessera.operators import automata, graph

# fixed values: noise that the two levels drop
MODERATE_NOISE = ["^\\s*$", "^\\.+$", "^(\\s*)\\d+/\\d+\\s+.*$", "(?i)progress:?"]
AGGRESSIVE_NOISE = [*MODERATE_NOISE, "(?i)debug", "(?i)trace", "(?i)info"]
MARGIN = 5
DOCUMENTS_AT_ONCE = 1000


@dataclass
class Stream:
    """Lines with the counts that ``group_by`` and ``aggregate`` leave for templates."""

    lines: DataFrame
    groups: DataFrame | None = None  # doc_id, key, n
    stats: DataFrame | None = None  # doc_id, key, n


Action = Callable[..., Stream]
ACTIONS: dict[str, Action] = {}


def doc():
    return Window.partitionBy("doc_id")


def in_order():
    return doc().orderBy("line_no")


def action(f: Action) -> Action:
    ACTIONS[f.__name__.rstrip("_")] = f
    return f


def of_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> Stream:
    """One line for each line break; a last empty line does not count."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\n$", "")
    lines = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return Stream(lines.withColumn("line_no", F.col("line_no").cast("double")))


def java(pattern: str) -> str:
    """A pattern checked and put in the dialect of the JVM."""
    if not pattern:
        raise ValueError("missing 'pattern' parameter")
    named = pattern.replace("(?P<", "(?<")
    for name, to in {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct"}.items():
        named = named.replace(f"[:{name}:]", f"\\p{{{to}}}")
    if not valid(named):
        raise ValueError(f"the pattern {pattern!r} is not valid")
    return named


def valid(pattern: str) -> bool:
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "x", pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")))
    except re.error:
        return False
    return True


def mapped(s: Stream, line: Column) -> Stream:
    return Stream(s.lines.withColumn("line", line), s.groups, s.stats)


def filtered(s: Stream, keep: Column) -> Stream:
    return Stream(s.lines.where(keep), s.groups, s.stats)


@action
def keep_lines(s: Stream, pattern: str = "") -> Stream:
    return filtered(s, F.col("line").rlike(java(pattern)))


@action
def remove_lines(s: Stream, pattern: str = "") -> Stream:
    return filtered(s, ~F.col("line").rlike(java(pattern)))


@action
def truncate_lines(s: Stream, max: int = 80, ellipsis: str = "...") -> Stream:  # noqa: A002
    return mapped(s, S.truncate_line(F.col("line"), max, ellipsis or "..."))


@action
def strip_ansi(s: Stream) -> Stream:
    return mapped(s, S.strip_ansi(F.col("line")))


@action
def compact_path(s: Stream) -> Stream:
    return mapped(s, S.compact_path(F.col("line")))


@action
def noise_filter(s: Stream, level: str = "moderate") -> Stream:
    return filtered(s, ~S.any_match(F.col("line"), AGGRESSIVE_NOISE if level == "aggressive" else MODERATE_NOISE))


@action
def head(s: Stream, n: int = 10, overflow_msg: str = "") -> Stream:
    ranked = s.lines.withColumn("r", F.row_number().over(in_order())).withColumn("total", F.count("*").over(doc()))
    message = F.lit(overflow_msg) if overflow_msg else F.format_string("+%d more lines", F.col("total") - n)
    # the message stands where the first line too many was
    line = F.when(F.col("r") == n + 1, message).otherwise(F.col("line"))
    return Stream(ranked.where(F.col("r") <= n + 1).select("doc_id", "line_no", line.alias("line")), s.groups, s.stats)


@action
def tail(s: Stream, n: int = 10) -> Stream:
    last = doc().orderBy(F.col("line_no").desc())
    return Stream(s.lines.withColumn("r", F.row_number().over(last)).where(F.col("r") <= n).drop("r"), s.groups, s.stats)


@action
def head_tail(s: Stream, head: int = 10, tail: int = 10, params: dict | None = None) -> Stream:
    """Both ends of long documents with a marker between. ``params`` may hold the sizes too."""
    head, tail = (params or {}).get("head", head), (params or {}).get("tail", tail)
    ranked = s.lines.withColumn("r", F.row_number().over(in_order())).withColumn("total", F.count("*").over(doc()))
    long = F.col("total") > head + tail + MARGIN
    kept = ranked.where(~long | (F.col("r") <= head + 1) | (F.col("r") > F.col("total") - tail))
    # the marker stands where the first line cut was
    marker = F.format_string("... [truncated %d lines of noise] ...", F.col("total") - (head + tail))
    line = F.when(long & (F.col("r") == head + 1), marker).otherwise(F.col("line"))
    return Stream(kept.select("doc_id", "line_no", line.alias("line")), s.groups, s.stats)


@action
def snr_dedup(s: Stream) -> Stream:
    """Runs of equal trimmed lines become one with its count; blank lines go."""
    rows = s.lines.withColumn("line", S.trim(F.col("line"))).where("line <> ''")
    fresh = F.when(F.lag("line").over(in_order()).eqNullSafe(F.col("line")), 0).otherwise(1)
    islands = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(in_order()))
    runs = islands.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), F.first("line").alias("line"), F.count("*").alias("n"))
    text = F.when(F.col("n") > 1, F.format_string("%s [x%d]", "line", "n")).otherwise(F.col("line"))
    return Stream(runs.select("doc_id", "line_no", text.alias("line")), s.groups, s.stats)


@action
def pure_signal(s: Stream, level: str = "moderate", head: int = 25, tail: int = 25) -> Stream:
    return head_tail(noise_filter(snr_dedup(strip_ansi(s)), level), head, tail)


def ranked(counts: DataFrame, top: int) -> DataFrame:
    """Rows of (doc_id, key, n, first) by count, then first line; line_no is their rank."""
    by = doc().orderBy(F.col("n").desc(), F.col("first"))
    out = counts.withColumn("line_no", F.row_number().over(by).cast("double"))
    return out.where(F.col("line_no") <= top) if top > 0 else out


def filled(template: str, **columns: Column) -> Column:
    """A template of plain ``{{.Name}}`` marks as a column."""
    parts, at = [], 0
    for m in templates.TAG.finditer(template):
        name = m[1].lstrip(".").strip()
        if not m[1].startswith(".") or name not in columns:
            raise ValueError(f"unknown mark {m[0]!r}")
        parts += [F.lit(template[at : m.start()]), columns[name].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


@action
def group_by(s: Stream, pattern: str = "", top: int = 0, format: str = "") -> Stream:  # noqa: A002
    """Counts of the first capture group, largest first, earliest first line at a tie."""
    found = s.lines.where(F.col("line").rlike(java(pattern))).withColumn("key", F.regexp_extract("line", java(pattern), 1))
    counts = found.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    line = filled(format or "{{.Key}}: {{.Count}}", Key=F.col("key"), Count=F.col("n"))
    return Stream(ranked(counts, top).select("doc_id", "line_no", line.alias("line")), counts.select("doc_id", "key", "n"), s.stats)


@action
def dedup(s: Stream, normalize: list[str] | None = None, top: int = 0) -> Stream:
    """Counts of normalised lines; patterns that are not valid are passed over."""
    norm = F.col("line")
    for p in normalize or []:
        if valid(p):
            norm = F.regexp_replace(norm, java(p), "")
    counts = s.lines.withColumn("key", S.trim(norm)).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    line = F.when(F.col("n") > 1, F.format_string("%s (x%d)", "key", "n")).otherwise(F.col("key"))
    return Stream(ranked(counts, top).select("doc_id", "line_no", line.alias("line")), s.groups, s.stats)


@action
def aggregate(s: Stream, patterns: dict[str, str] | None = None, format: str = "") -> Stream:  # noqa: A002
    """Matches of each pattern, by name; a line may count for several."""
    if patterns is None:
        raise ValueError("missing 'patterns' parameter")
    used = {k: java(p) for k, p in sorted(patterns.items()) if p and valid(p)}
    sums = s.lines.groupBy("doc_id").agg(*[F.sum(F.col("line").rlike(p).cast("int")).alias(f"c{i}") for i, p in enumerate(used.values())], F.count("*").alias("total"))
    pairs = F.array(*[F.struct(F.lit(float(i)).alias("line_no"), F.lit(k).alias("key"), F.col(f"c{i}").alias("n")) for i, k in enumerate(used)])
    stats = sums.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")
    if not format:
        return Stream(stats.select("doc_id", "line_no", F.format_string("%s: %d", "key", "n").alias("line")), s.groups, stats.drop("line_no"))
    out = by_template(sums.select("doc_id", F.map_from_arrays(F.array(*[F.lit(k) for k in used]), F.array(*[F.col(f"c{i}") for i in range(len(used))])).alias("stats")), format, lambda row: dict(row["stats"]))
    return Stream(out, s.groups, stats.drop("line_no"))


def documents(ids: pa.Array, found: list[list[str]]) -> pa.RecordBatch:
    """(doc_id, line_no, line) of the lines of each document."""
    repeated = ids.take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int64()))
    at = [float(i) for x in found for i in range(len(x))]
    return pa.RecordBatch.from_arrays([repeated, pa.array(at, pa.float64()), pa.array([line for x in found for line in x], pa.string())], ["doc_id", "line_no", "line"])


def by_template(rows: DataFrame, template: str, data: Callable[[dict], Any], strip: bool = False) -> DataFrame:
    """A small row for each document, rendered and split into lines."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                part = batch.slice(at, DOCUMENTS_AT_ONCE)
                found = [templates.render(template, data(row)) for row in part.to_pylist()]
                found = [(text.rstrip("\n") if strip else text).split("\n") for text in found]
                yield documents(part["doc_id"], found)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line_no double, line string")


@action
def format_template(s: Stream, template: str = "") -> Stream:
    """The whole document as one text: its lines, their count, and the counts so far."""
    if not template:
        raise ValueError("missing 'template' parameter")
    texts = s.lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("count"))
    for name, side in (("groups", s.groups), ("stats", s.stats)):
        if side is None or not templates.mentions(template, name):
            texts = texts.withColumn(name, F.lit(None).cast("map<string,bigint>"))
        else:
            texts = texts.join(side.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias(name)), "doc_id", "left")
    clean = lambda m: None if m is None else {k: int(v) for k, v in dict(m).items()}
    data = lambda r: {"lines": r["lines"], "count": int(r["count"]), "groups": clean(r["groups"]), "stats": clean(r["stats"])}
    return Stream(by_template(texts, template, data, True), s.groups, s.stats)


@action
def regex_extract(s: Stream, pattern: str = "", format: str = "") -> Stream:  # noqa: A002
    """``$i`` marks filled in order, else the groups with spaces between, else the match."""
    p = java(pattern)
    n = re.compile(re.sub(r"\\p\{\w+\}", "x", p.replace("(?<", "(?P<"))).groups
    group = lambda i: F.regexp_extract("line", p, i)
    out = F.concat_ws(" ", *[group(i) for i in range(1, n + 1)]) if n else group(0)
    if format:
        out = F.lit(format)
        for i in range(n + 1):
            out = F.replace(out, F.lit(f"${i}"), group(i))
    return Stream(s.lines.where(F.col("line").rlike(p)).withColumn("line", out), s.groups, s.stats)


def whole_documents(s: Stream, f: Callable[[list[str]], list[str]]) -> Stream:
    """An action that must see a document's lines one after another.

    The lines of a document are gathered by Spark; a task runs ``f`` over batches of documents, as a
    call for each document would cost more than most documents do.
    """
    schema = f"doc_id {s.lines.schema['doc_id'].dataType.simpleString()}, line_no double, line string"
    texts = s.lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                part = batch.slice(at, DOCUMENTS_AT_ONCE)
                yield documents(part["doc_id"], [f(x) for x in part["lines"].to_pylist()])

    return Stream(texts.mapInArrow(run, schema), s.groups, s.stats)


@action
def state_machine(s: Stream, states: dict[str, dict] | None = None) -> Stream:
    """Lines kept by the state that earlier lines led to; a line that ends a state is dropped.

    Lines are dealt by range, so a document of any length is spread over tasks.
    """
    if not isinstance(states, dict):
        raise ValueError("'states' must be a map")
    table = {k: c for k, c in sorted(states.items()) if isinstance(c, dict)}
    if not table:
        return filtered(s, F.lit(False))
    # a state that is not stated ends the machine: the last number, which nothing leaves
    number = {k: i for i, k in enumerate(table)}
    hit = lambda c, key: F.col("line").rlike(java(c[key])) if c.get(key) and valid(c[key]) else None
    never = F.lit(False)
    until, keep = {k: hit(c, "until") for k, c in table.items()}, {k: hit(c, "keep") for k, c in table.items()}
    moves = [(never if until[k] is None else until[k], number.get(c.get("next") or k, len(table))) for k, c in table.items()]
    first = number.get("start", 0)
    met = automata.states(s.lines, [*moves, (never, len(table))], first, graph.cut)
    kept = F.lit(False)
    for k, i in number.items():
        stays = F.lit(True) if keep[k] is None else keep[k]
        kept = F.when(F.col("state") == i, stays if until[k] is None else stays & ~until[k]).otherwise(kept)
    return Stream(met.where(kept).drop("state"), s.groups, s.stats)


def sections(s: Stream, until: str, keep: str = "") -> DataFrame:
    """The common two-state machine with windows only: lines after the first ``until`` line that match ``keep``."""
    passed = F.max(F.col("line").rlike(java(until)).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    out = s.lines.withColumn("in_section", passed == 1).where("in_section").drop("in_section")
    return out.where(F.col("line").rlike(java(keep))) if keep else out


def parsed(line: str) -> dict | None:
    try:
        value = json.loads(line, parse_int=float)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@action
def ndjson_stream(s: Stream, group_by: str = "", format: str = "") -> Stream:  # noqa: A002
    """Objects counted by one field, in order of first sight; lines that are none are passed over."""
    if not format or not re.search(r"\.Events", format):
        ok = F.try_parse_json("line").isNotNull() & S.trim(F.col("line")).startswith("{")
        key = F.coalesce(F.get_json_object("line", "$." + group_by), F.lit("")) if group_by else F.lit("")
        counts = s.lines.where(ok).withColumn("key", key).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
        line = filled(format, Key=F.col("key"), Count=F.col("n")) if format else F.format_string("%s: %d events", "key", "n")
        return Stream(counts.select("doc_id", "line_no", line.alias("line")), s.groups, s.stats)

    def run(lines: list[str]) -> list[str]:
        groups: dict[str, list[dict]] = {}
        for line in lines:
            if line.strip() and (obj := parsed(line)) is not None:
                groups.setdefault(templates.go_text(obj[group_by]) if group_by in obj else "", []).append(obj)
        return [templates.render(format, {"Key": k, "Count": len(v), "Events": v}) for k, v in groups.items()]

    return whole_documents(s, run)


@action
def json_extract(s: Stream, fields: list[str] | None = None, format: str = "") -> Stream:  # noqa: A002
    """Fields of the document's object as ``name: value``; absent ones are passed over."""
    if fields is None:
        raise ValueError("missing 'fields' parameter")

    def run(lines: list[str]) -> list[str]:
        data = parsed("\n".join(lines))
        if data is None:
            raise ValueError("json_extract: the text is not a JSON object")
        if format:
            return templates.render(format, {f: data.get(f) for f in fields}).split("\n")
        return [f"{f}: {'<nil>' if data[f] is None else templates.go_text(data[f])}" for f in fields if f in data]

    return whole_documents(s, run)


def shape(v: Any, depth: int, most: int) -> str:
    if depth >= most:
        return "..."
    pad = "  " * depth
    if isinstance(v, dict):
        rows = sorted(f"{pad}  {k}: {shape(x, depth + 1, most)}" for k, x in v.items())
        return "{\n" + "\n".join(rows) + f"\n{pad}}}" if rows else "{}"
    if isinstance(v, list):
        return f"[{shape(v[0], depth, most)}]" if v else "[]"
    return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string"


@action
def json_schema(s: Stream, max_depth: int = 3) -> Stream:
    return whole_documents(s, lambda lines: shape(json.loads("\n".join(lines)), 0, max_depth).split("\n"))


@action
def semantic_purify(s: Stream, source: DataFrame | None = None, around: int = 2) -> Stream:
    """Failure lines followed by the source around the place they name.

    ``source``: (path, line_no, line). Without it the stream is unchanged.
    """
    if source is None:
        return s
    ref = S.go_failure(F.col("line"))
    refs = s.lines.withColumn("ref", ref).where("ref is not null").select("doc_id", "line_no", "ref.file", F.col("ref.line").alias("at"))
    near = refs.join(source.select(F.col("path").alias("file"), F.col("line_no").alias("n"), F.col("line").alias("code")), "file").where((F.col("n") >= F.col("at") - around) & (F.col("n") <= F.col("at") + around))
    mark = F.concat(F.when(F.col("n") == F.col("at"), "> ").otherwise("  "), F.col("code"))
    body = near.groupBy("doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", mark.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    added = body.select("doc_id", F.posexplode(F.array(F.lit("\n--- SOURCE CONTEXT ---"), F.col("body"), F.lit("--- END CONTEXT ---\n"))).alias("k", "line"), F.col("line_no").alias("base"))
    return Stream(s.lines.unionByName(added.select("doc_id", (F.col("base") + (F.col("k") + 1) / F.lit(8.0)).alias("line_no"), "line")), s.groups, s.stats)


@dataclass(frozen=True)
class Spec:
    """A named pipeline and the commands that it serves."""

    name: str
    pipeline: list[dict]
    command: str = ""
    subcommand: str = ""
    exclude_flags: tuple[str, ...] = ()
    require_flags: tuple[str, ...] = ()
    inject: dict = field(default_factory=dict)
    on_error: str = "passthrough"

    def apply(self, s: Stream) -> Stream:
        for step in self.pipeline:
            params = {k: v for k, v in step.items() if k != "action"}
            s = ACTIONS[step["action"]](s, **params)
        return s

    def run(self, s: Stream) -> Stream:
        """As apply; a parameter that an action refuses leaves the input as it is."""
        try:
            return self.apply(s)
        except (ValueError, KeyError, TypeError):
            if self.on_error != "passthrough":
                raise
            return s


def find_spec(specs: list[Spec], command: str, args: list[str]) -> Spec | None:
    """The spec for a command line: command with subcommand, command alone, then any."""
    subcommand = args[0] if args else ""
    flags = [a for a in args if a.startswith("-")]
    fits = lambda s: not any(f.startswith(x) for f in flags for x in s.exclude_flags) and all(any(f.startswith(x) for f in flags) for x in s.require_flags)
    for want in ((command, subcommand), (command, ""), ("*", "")):
        for s in specs:
            if (s.command, s.subcommand) == want and fits(s):
                return s
    return None


def inject_args(spec: Spec, args: list[str]) -> list[str]:
    """Arguments with those that the spec adds, before any ``--``."""
    rule = spec.inject
    if any(a.startswith(x) for a in args for x in rule.get("skip_if_present", [])):
        return list(args)
    added = list(rule.get("args", []))
    for flag, value in rule.get("defaults", {}).items():
        if not any(a == flag or a.startswith(flag) for a in args):
            added += [flag, value]
    at = args.index("--") if "--" in args else len(args)
    return [*args[:at], *added, *args[at:]]
