"""Source trees as tables."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what a scan takes and passes over
EXTENSIONS = [".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs"]
BLOCKED = [".git", "node_modules", "vendor", "dist", "build"]
MANIFESTS = ["go.mod", "package.json"]
MOST_BYTES = 64 << 10
MOST_FRAGMENT = 100 << 10


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, manifests: bool = False) -> DataFrame:
    """(path, mtime, hash, content) of the source files under ``root``, paths relative to it.

    Without ``ignore`` the patterns of the tree's own ignore files hold.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    rows = scanned(files.withColumn("path", relative), ignore_patterns(spark, root) if ignore is None else ignore, manifests)
    return rows.select("path", F.unix_micros("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def listed(spark: SparkSession, root: str, ignore: list[str] | None = None, manifests: bool = False) -> DataFrame:
    """(path, mtime, length) of what ``scan`` takes; no content is read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    rows = scanned(files.withColumn("path", relative), ignore_patterns(spark, root) if ignore is None else ignore, manifests)
    return rows.select("path", F.unix_micros("modificationTime").alias("mtime"), "length")


#: Paths up to which files are named one by one; more are found by the time of the oldest.
MOST_NAMED = 1000


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, mtime, hash, content) of the listed files ``wanted`` (path, mtime).

    Few are opened by name. Of many, the scan passes over files older than the oldest of them
    without opening these.
    """
    base = root.rstrip("/") + "/"
    some = wanted.select("path", "mtime")
    names = [r.path for r in some.select("path").limit(MOST_NAMED + 1).collect()]
    if not names:
        return spark.createDataFrame([], "path string, mtime long, hash string, content string")
    reader = spark.read.format("binaryFile")
    if len(names) <= MOST_NAMED:
        files = reader.load([base + n for n in names])
    else:
        oldest = some.agg(F.timestamp_micros(F.min("mtime"))).first()[0]
        files = reader.option("recursiveFileLookup", True).load(root).where(F.col("modificationTime") >= F.lit(oldest))
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    found = files.select(relative.alias("path"), F.unix_micros("modificationTime").alias("mtime"), "content").join(some.select("path"), "path", "left_semi")
    return found.select("path", "mtime", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def scanned(files: DataFrame, ignore: list[str] | None = None, manifests: bool = False) -> DataFrame:
    """Of files (path, length, ...) those that a scan takes."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.col("path").rlike("(" + "|".join(map(re.escape, EXTENSIONS)) + ")$")
    if manifests:
        wanted = wanted | name.isin(MANIFESTS)
    rows = files.where((F.col("length") <= MOST_BYTES) & wanted).where(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, BLOCKED)) + ")/"))
    return rows.where(~ignored(F.col("path"), ignore)) if ignore else rows


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """Lines of the ignore files of a tree, the repository's own last."""
    out: list[str] = []
    for name in (".gitignore", ".git/info/exclude"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            stream = system.open(path)
            try:
                out += bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
            finally:
                stream.close()
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns of the root meet a path; a later pattern wins, ``!`` takes back."""
    out = F.lit(False)
    for line in patterns:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        keep = p.startswith("!")
        p = p.removeprefix("!")
        folder = p.endswith("/")
        body = re.sub(r"\(\?s:(.*)\)\\[zZ]", r"\1", fnmatch.translate(p.strip("/"))).replace(".*", "[^/]*")
        start = "^" if "/" in p.rstrip("/") else "(^|/)"
        out = F.when(path.rlike(f"{start}{body}{'/' if folder else '(/|$)'}"), not keep).otherwise(out)
    return out


def inside(path: Column, root: str) -> Column:
    """``path`` made absolute under ``root``, steps up resolved; null if it leads out of it."""
    base = [x for x in root.split("/") if x]
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/" + "/".join(base) + "/"), path))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    clean = F.aggregate(steps, F.array().cast("array<string>"), up)
    kept = F.array_join(F.slice(clean, F.lit(1), F.lit(len(base))), "/") == "/".join(base)
    return F.when((path != "") & kept, F.concat(F.lit("/"), F.array_join(clean, "/")))


def fragment(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """(path, fragment) of bytes start to end; over the size limit or not UTF-8 is null."""
    data = F.col("content").cast("binary")
    part = F.expr(f"substring(cast(content as binary), {start + 1}, {end - start})")
    fits = (F.octet_length(data) >= end) & F.lit(0 <= start <= end and end - start <= MOST_FRAGMENT)
    return files.where(F.col("path") == path).select("path", F.when(fits & F.is_valid_utf8(part), part.cast("string")).alias("fragment"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), counted from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def extract_lines(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """(path, text) of lines start to end, both included."""
    text = F.array_join(F.slice(F.split("content", "\n"), max(1, start), max(0, end - max(1, start) + 1)), "\n")
    return files.where(F.col("path") == path).select("path", text.alias("text"))


def context_window(files: DataFrame, places: DataFrame, around: int = 2) -> DataFrame:
    """(path, at, text): lines around each place (path, at), that line marked."""
    joined = places.join(lines(files), "path").where((F.col("line_no") >= F.col("at") - around) & (F.col("line_no") <= F.col("at") + around))
    mark = F.concat(F.when(F.col("line_no") == F.col("at"), "> ").otherwise("  "), F.col("line"))
    return joined.groupBy("path", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", mark.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def resolve_pointer(files: DataFrame, symbols: DataFrame, pointer: str) -> DataFrame:
    """(path, start, end) in bytes of a fragment pointer: a JSON range, a file's hash, or a symbol's name."""
    import json

    if pointer.strip().startswith("{"):
        p = json.loads(pointer)
        return files.where(F.col("path") == p["path"]).select("path", F.lit(int(p["start"])).cast("long").alias("start"), F.lit(int(p["end"])).cast("long").alias("end"))
    if re.fullmatch("[0-9a-f]{64}", pointer):
        return files.where(F.col("hash") == pointer).select("path", F.lit(0).cast("long").alias("start"), F.octet_length("content").cast("long").alias("end"))
    return symbols.where(F.col("name") == pointer).select("path", F.col("start_byte").cast("long").alias("start"), F.col("end_byte").cast("long").alias("end"))


def gomod(files: DataFrame) -> DataFrame:
    """(manifest, name, version, direct) of the requirements in go.mod files."""
    rows = lines(files.where(F.col("path").rlike("(^|/)go\\.mod$")))
    pattern = "^\\s*(?:require\\s+)?([\\w./~-]+\\.[\\w./~-]+)\\s+(v[^\\s]+)(.*)$"
    return rows.where(F.col("line").rlike(pattern)).select(F.col("path").alias("manifest"), F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"), (~F.regexp_extract("line", pattern, 3).contains("// indirect")).alias("direct"))


def npm(files: DataFrame) -> DataFrame:
    """The same of package.json files; all are direct."""
    parsed = files.where(F.col("path").rlike("(^|/)package\\.json$")).select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = F.map_concat(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("j.devDependencies", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), k)))
    return parsed.select(F.col("path").alias("manifest"), F.explode(both).alias("name", "version")).withColumn("direct", F.lit(True))
