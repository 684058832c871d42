"""Call-graph operators over an edge table.

Edges are (caller, callee, path, line, callee_path, link_type); symbols have name,
type, package_path, path and line ranges. Traversals run level by level with a
visited set, so a level costs a join and no path is enumerated.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.strings import fqn
from tessera.operators import paths

HIERARCHY = ["satisfies", "implements", "embeds"]
ENTRY_POINTS = ["main", "init"]
WEIGHTS = {"implements": 10, "satisfies": 5, "embeds": 3, "dynamic": 2}
DAMPING = 0.85
#: Levels between two cuts of the lineage.
CUT_EVERY = 5
#: Rows up to which nodes are sent to the edges, which then stay where they are; more are joined by a shuffle.
MOST_SENT = 100_000
#: Tasks for rows that a join has multiplied, at least.
TASKS_PER_CORE = 16


def shared_folder(session: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode only."""
    context = session.sparkContext
    where = session.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, where, True)
        where = f"file://{where}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sent(df: DataFrame) -> DataFrame:
    """``df``, to be sent whole to what it is joined with if it has few rows; it must be cheap to read twice."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def full_name() -> Column:
    return fqn(F.col("package_path"), F.col("name"))


def callers(edges: DataFrame, callee: str, limit: int | None = 500, offset: int = 0) -> DataFrame:
    found = edges.where(F.col("callee") == callee).orderBy("caller", "path", "line", "link_type").offset(offset)
    return found if limit is None else found.limit(limit)


def callees(edges: DataFrame, caller: str, limit: int | None = 500) -> DataFrame:
    found = edges.where(F.col("caller") == caller).orderBy("callee", "path", "line", "link_type")
    return found if limit is None else found.limit(limit)


def flows_to(flows: DataFrame, sink: str) -> DataFrame:
    return flows.where(F.col("sink") == sink)


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("callee").agg(F.count("*").alias("indegree"))


def centrality(symbols: DataFrame, edges: DataFrame, match_on: str = "name") -> DataFrame:
    """symbols with the number of calls of their name (or full name)."""
    key = F.col("name") if match_on == "name" else full_name()
    counts = indegree(edges).withColumnRenamed("callee", "_k")
    return symbols.join(counts, key == F.col("_k"), "left").withColumn("centrality", F.coalesce("indegree", F.lit(0))).drop("_k", "indegree")


def critical(symbols: DataFrame, edges: DataFrame, failed: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols by centrality, then failed tests; calls with the exact path count first, else all of the name."""
    exact = edges.groupBy(F.col("callee").alias("_c"), F.col("callee_path").alias("_p")).agg(F.count("*").alias("_exact"))
    total = exact.groupBy(F.col("_c").alias("_n")).agg(F.sum("_exact").alias("_total"))  # reuses the exchange of the counts above
    fragile = failed.groupBy(F.col("target_symbol").alias("_t")).agg(F.count("*").alias("fragility"))
    joined = symbols.join(exact, (symbols["name"] == F.col("_c")) & (symbols["path"] == F.col("_p")), "left").join(total, symbols["name"] == F.col("_n"), "left").join(fragile, symbols["name"] == F.col("_t"), "left")
    scored = joined.withColumn("centrality", F.coalesce(F.nullif("_exact", F.lit(0)), "_total", F.lit(0))).withColumn("fragility", F.coalesce("fragility", F.lit(0)))
    return scored.drop("_c", "_p", "_exact", "_n", "_total", "_t").orderBy(F.desc("centrality"), F.desc("fragility"), "name", "path").limit(limit)


def blast_radius(edges: DataFrame, names: list[str], path: str | None = None, max_depth: int = 3) -> DataFrame:
    """(caller, path, distance, link_type) of callers over simple paths up to ``max_depth``.

    ``names``: the symbol's name and full name. ``path`` limits the first step to
    calls of that file or of no known file; None takes any. A caller may come at
    several distances. Paths are not enumerated: each node keeps a representative family of
    those that reach it (see ``paths``), whose size depends on ``max_depth`` alone. Nodes
    on a path are told apart by 64-bit hashes.
    """
    max_depth = max(1, min(max_depth, 10))
    near = F.lit(True) if path is None else F.col("callee_path").isin(path, "")
    node = lambda c, p: F.xxhash64(F.col(c).cast("string"), F.col(p))
    met = edges.where(F.col("callee").isin(names) & near).select("caller", "path", "link_type", F.array().cast("array<bigint>").alias("before"))
    steps = edges.select(F.col("caller").alias("c2"), "callee", F.col("path").alias("p2"), "callee_path", F.col("link_type").alias("l2"))
    levels = []
    for depth in range(1, max_depth + 1):
        if depth > 1:
            level = paths.family(met, ["caller", "path"], depth - 1, max_depth - depth + 1)
            level = cut(level)  # read by two joins
            # calls of the caller's file and calls of no known file: two equi joins
            exact = level.join(steps, (steps["callee"] == level["caller"]) & (steps["callee_path"] == level["path"]))
            loose = level.join(steps.where("callee_path = ''"), (steps["callee"] == level["caller"]) & (level["path"] != ""))
            joined = exact.unionByName(loose).withColumns({"here": node("c2", "p2"), "passed": F.array_append("before", node("caller", "path"))})
            met = joined.where(~F.array_contains("passed", F.col("here"))).select(F.col("c2").alias("caller"), F.col("p2").alias("path"), F.col("l2").alias("link_type"), F.col("passed").alias("before"))
        if depth < max_depth:
            met = cut(met.distinct())  # read by the next level and by the result
        levels.append(met.select("caller", "path", F.lit(depth).alias("distance"), "link_type").distinct())
    return reduce(DataFrame.unionByName, levels)


def reach(start: DataFrame, steps: DataFrame, max_depth: int | None) -> DataFrame:
    """(node, depth) reachable from ``start`` (node) over ``steps`` (src, dst), with least depth; start has 0.

    ``max_depth`` None goes on until a level has no new node. Steps that several levels read
    are written out once. A level of few nodes is sent to them, so that the steps move for
    large levels only.
    """
    visited = start.distinct().withColumn("depth", F.lit(0))
    if max_depth is not None and max_depth < 1:
        return visited
    if max_depth != 1:
        steps = cut(steps.distinct())
    visited = cut(visited)
    frontier = visited
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        nxt = sent(frontier).join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(nxt.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % CUT_EVERY == 0:
            visited = cut(visited)
    return visited


def affected_tests(symbols: DataFrame, edges: DataFrame, name: str, path: str, max_depth: int = 10) -> DataFrame:
    """Test symbols that reach (name, path), by short or full name, without passing an entry point."""
    return tests_reaching(symbols, edges, symbols.where(((F.col("name") == name) | (full_name() == name)) & (F.col("path") == path)), max_depth)


def tests_reaching(symbols: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """Test symbols that reach any of ``targets`` (rows of ``symbols``), in one traversal.

    A test is a function or method named Test*, or any symbol of a file like %_test.go.
    """
    named = symbols.withColumn("full", full_name())
    start = targets.select(F.struct(full_name().alias("n"), F.col("path").alias("p")).alias("node"))
    passing = edges.where(~F.col("caller").isin(ENTRY_POINTS))
    exact = passing.where("callee_path <> ''").select(F.struct(F.col("callee").alias("n"), F.col("callee_path").alias("p")).alias("src"), F.struct(F.col("caller").alias("n"), F.col("path").alias("p")).alias("dst"))
    loose = passing.where("callee_path = ''").join(named.select(F.col("full").alias("_f"), F.col("path").alias("_fp")).union(edges.select("caller", "path")).distinct(), F.col("callee") == F.col("_f"))
    loose = loose.select(F.struct(F.col("callee").alias("n"), F.col("_fp").alias("p")).alias("src"), F.struct(F.col("caller").alias("n"), F.col("path").alias("p")).alias("dst"))
    found = reach(start, exact.union(loose), max_depth).select(F.col("node.n").alias("_n"), F.col("node.p").alias("_p"))
    tests = named.where((F.col("name").ilike("Test%") & F.col("type").isin("function", "method")) | F.col("path").ilike("%_test.go"))
    return tests.join(sent(found), (F.col("full") == F.col("_n")) & (F.col("path") == F.col("_p")), "left_semi").drop("full").dropDuplicates(["name", "path", "start_line"])


def ripple(edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """Edges by which a change of ``start`` spreads, with the least depth at which each is met.

    A change spreads to callers, and forward along hierarchy links. An edge met from a
    node at depth d has depth d + 1. A ``max_depth`` leaves out deeper edges; None takes all.
    """
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    back = F.array(way("callee", "caller"))
    ways = F.when(F.col("link_type").isin(HIERARCHY), F.concat(back, F.array(way("caller", "callee")))).otherwise(back)
    spread = edges.select("caller", "callee", "path", "line", "callee_path", "link_type", F.explode(ways).alias("way")).select("*", "way.*").drop("way")
    session = edges.sparkSession
    origin = session.range(1).select(F.lit(start).cast(edges.schema["caller"].dataType).alias("node"))
    nodes = reach(origin, spread.select("src", "dst"), None if max_depth is None else max_depth - 1)
    met = spread.join(sent(nodes), spread["src"] == nodes["node"])
    return met.groupBy("caller", "callee", "path", "line", "callee_path", "link_type").agg((F.min("depth") + 1).cast("int").alias("depth"))


def discover_tasks(symbols: DataFrame, edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(kind, symbol, impacted, path, line, depth): the definition of ``start``, then every symbol that its ripple reaches, once.

    Of the edges that reach a symbol the first counts, by depth, path, line and ends. A
    call reaches its caller; a hierarchy link reaches the end that is further away.
    """
    full = full_name()
    definition = symbols.where((full == start) | (F.col("name") == start)).select(F.lit("definition").alias("kind"), F.col("name").cast("string").alias("symbol"), full.cast("string").alias("impacted"), "path", F.col("start_line").cast("int").alias("line"), F.lit(0).alias("depth")).distinct()
    met = cut(ripple(edges, start, depth))  # read four times
    callers_ = met.select(F.lit("caller").alias("kind"), F.col("callee").alias("symbol"), F.col("caller").alias("impacted"), "path", "line", "depth", F.col("link_type").isin(HIERARCHY).alias("link"))
    callees_ = met.where(F.col("link_type").isin(HIERARCHY)).select(F.lit("hierarchy").alias("kind"), F.col("caller").alias("symbol"), F.col("callee").alias("impacted"), F.col("callee_path").alias("path"), "line", "depth", F.lit(True).alias("link"))
    known = met.select(F.col("caller").alias("n"), "depth").unionByName(met.where(F.col("link_type").isin(HIERARCHY)).select(F.col("callee").alias("n"), "depth")).groupBy(F.col("n").alias("impacted")).agg(F.min("depth").alias("least"))
    ways = callers_.unionByName(callees_).where(F.col("impacted") != start).join(known, "impacted").where(F.col("depth") == F.col("least"))
    first = ways.groupBy("impacted").agg(F.min(F.struct("path", "line", "symbol", "kind")).alias("w"), F.min("depth").alias("depth"))
    local = F.substring_index(F.col("w.symbol").cast("string"), ".", -1)
    rows = first.select("w.kind", local.alias("symbol"), F.col("impacted").cast("string").alias("impacted"), "w.path", F.col("w.line").cast("int").alias("line"), "depth")
    return definition.unionByName(rows)


def weighted_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w), once for each linked pair of distinct ``nodes`` (node), dealt and sorted by source.

    All links move twice: to their targets, which may be no nodes, and to their sources,
    where equal pairs meet too. Of a line and a link type only the order is carried, one
    number for lines of up to 32 bits, so that pairs are hashed and not sorted.
    """
    kinds = sorted(WEIGHTS)
    # 1 below the first kind, 2 at it, 3 between it and the next, ...; 0 for null
    place = F.coalesce(reduce(Column.__add__, [(F.col("link_type") >= k).cast("long") + (F.col("link_type") > k).cast("long") for k in kinds], F.lit(1)), F.lit(0))
    line = dict(edges.dtypes).get("line")
    if line in (None, "tinyint", "smallint", "int"):
        number = F.lit(0) if line is None else F.coalesce("line", F.lit(-(2**31) - 1))  # null comes first
        order = F.shiftleft(number.cast("long"), 4).bitwiseOR(place)
        first = F.min("order").bitwiseAND(15)
    else:
        order = F.struct("line", place.alias("place"))
        first = F.min("order")["place"]
    weight = F.lit(1.0)
    for i, k in enumerate(kinds):
        weight = F.when(F.col("first") == 2 * i + 2, float(WEIGHTS[k])).otherwise(weight)
    links = edges.select("src", "dst", order.alias("order"))
    inside = links.join(nodes.toDF("dst"), "dst", "left_semi").repartition("src").join(nodes.toDF("src"), "src", "left_semi")
    one = inside.groupBy("src", "dst").agg(first.alias("first"))
    return one.select("src", "dst", weight.alias("w")).sortWithinPartitions("src")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, epsilon: float | None = 1e-6, seeds: list[str] | None = None) -> DataFrame:
    """(node, rank): weighted PageRank of ``nodes`` (node) over ``edges`` (src, dst, link_type).

    Edges with an end outside ``nodes`` count for nothing, and a node that is named again
    counts once; of several links between two nodes the first in order of (line, link_type)
    gives the weight. ``epsilon`` None runs all iterations. With seeds the walk restarts, and
    dangling mass goes, to them. Nodes may be of any type; numbers take fewer bytes than names.
    """
    known = nodes.select("node").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    n = known.count()
    if not n:
        known.unpersist()
        return nodes.withColumn("rank", F.lit(0.0))
    # dealt by source once; ranks are dealt by node alike, so a step moves only what flows
    parts = weighted_links(known, edges).persist(StorageLevel.MEMORY_AND_DISK)
    is_seed = F.col("node").isin(seeds) if seeds else F.lit(True)
    m = known.where(is_seed).count() or n if seeds else n
    outs = parts.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("out"))
    marked = known.select("node", is_seed.alias("seed")).repartition("node").join(outs, "node", "left")
    ranks = marked.withColumn("rank", F.when(F.col("seed"), 1.0 / m).otherwise(0.0)).persist(StorageLevel.MEMORY_AND_DISK)
    dangling = F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))
    loose = ranks.agg(dangling).first()[0]  # one number, as below
    for _ in range(iterations):
        shares = ranks.where("out is not null").select("node", (F.col("rank") / F.col("out")).alias("share"))
        sums = shares.join(parts, shares["node"] == parts["src"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("w")).alias("got"))
        spread = F.when(F.col("seed"), F.lit((1 - DAMPING) / m + DAMPING * loose / m)).otherwise(0.0)
        joined = ranks.withColumnRenamed("rank", "old").join(sums, F.col("node") == F.col("dst"), "left")
        nxt = joined.select("node", "seed", "out", (spread + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"), "old")
        nxt = cut(nxt)  # ranks are read twice a step, so a plan of several steps would double with each
        loose, change = nxt.agg(dangling, F.max(F.abs(F.col("rank") - F.col("old")))).first()
        ranks.unpersist()
        ranks = nxt.drop("old")
        if epsilon is not None and change < epsilon:
            break
    out = cut(ranks.select("node", "rank"))
    for held in (known, parts, ranks):
        held.unpersist()
    return out


def churn(commits: DataFrame, newest: int | None = 500) -> DataFrame:
    """(path, commits, most_together, score) from (commit, ts, path).

    score = half the file's commits and half its most frequent companion's, over the
    most commits of any file. Pairs are those of the newest commits' files, so a commit
    of f files costs f squared; both sides of the join are exchanges, so a large commit
    is split over tasks, and pairs are counted before they move.
    """
    files = commits.select("commit", "ts", "path").distinct()
    if newest is not None:
        last = files.groupBy("commit").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "commit").limit(newest).select("commit")
        files = files.join(last, "commit", "left_semi")
    counts = files.groupBy("path").agg(F.count("*").alias("commits"))
    a, b = files.select("commit", F.col("path").alias("a")), files.select("commit", F.col("path").alias("b"))
    pairs = a.join(b, "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    together = pairs.select(F.explode(F.array("a", "b")).alias("path"), "n").groupBy("path").agg(F.max("n").alias("most_together"))
    most = counts.agg(F.max("commits").alias("most"))
    joined = counts.join(together, "path", "left").crossJoin(F.broadcast(most)).withColumn("most_together", F.coalesce("most_together", F.lit(0)))
    return joined.select("path", "commits", "most_together", (0.5 * F.col("commits") / F.col("most") + 0.5 * F.col("most_together") / F.col("most")).alias("score"))


def resolve_interfaces(interfaces: DataFrame, types: DataFrame) -> DataFrame:
    """(type, interface) where a type has every method of an interface.

    Inputs: (name, method), a row for each. Types are met through one method of the
    interface, that which the fewest types have, so no pair without a common method
    is looked at.
    """
    rare = interfaces.join(types.groupBy("method").agg(F.count("*").alias("n")), "method", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = rare.groupBy("name").agg(F.min_by("method", F.struct("n", "method")).alias("method"), F.countDistinct("method").alias("size"))
    candidates = key.join(types.withColumnRenamed("name", "type"), "method").select(F.col("name").alias("interface"), "type", "size")
    need = candidates.join(interfaces.withColumnRenamed("name", "interface"), "interface")
    have = need.join(types.withColumnRenamed("name", "type").distinct(), ["type", "method"])
    return have.groupBy("type", "interface", "size").agg(F.countDistinct("method").alias("n")).where("n = size").select("type", "interface")


def interface_edges(symbols: DataFrame, embeds: DataFrame) -> DataFrame:
    """Edges (caller, callee, path, line, callee_path, link_type) that follow from the method sets of a code base.

    ``symbols``: interfaces with their ``method_spec`` rows and classes with their
    methods, of names like Type.Method; ``embeds``: edges of link type embeds. A type
    implements an interface, and its methods satisfy those of it, if the type's methods,
    pointer receivers included and those of embedded types too, have all names and
    signatures of the interface and of the interfaces that this embeds.
    """
    kinds = symbols.select("package_path", F.col("name").cast("string").alias("name"), "type", "path", "signature")
    qualified = fqn(F.col("package_path"), F.col("name"))
    types = kinds.where(F.col("type").isin("interface", "class", "struct", "type")).select(qualified.alias("owner"), F.col("type") == "interface", "path").toDF("owner", "is_interface", "path").distinct()
    own = kinds.where(F.col("type").isin("method", "method_spec") & F.col("name").contains(".")).select(fqn(F.col("package_path"), F.substring_index("name", ".", 1)).alias("owner"), F.substring_index("name", ".", -1).alias("method"), "signature")
    links = embeds.where("link_type = 'embeds'").select(F.col("caller").alias("owner"), F.col("callee").alias("inner")).join(types.select("owner"), "owner", "left_semi").distinct()
    # an embedded type gives its methods to what embeds it, through any number of steps
    holds = types.select("owner", F.col("owner").alias("inner"))
    reached = holds
    while True:
        more = cut(reached.join(links.toDF("inner", "next"), "inner").select("owner", F.col("next").alias("inner")).distinct().join(holds, ["owner", "inner"], "left_anti"))
        if more.isEmpty():
            break
        holds, reached = holds.unionByName(more), more
    methods = holds.join(own.toDF("inner", "method", "signature"), "inner").select("owner", F.concat_ws(" ", "method", "signature").alias("method")).distinct()
    sets = methods.join(types, "owner")
    faces, concrete = sets.where("is_interface").select(F.col("owner").alias("name"), "method"), sets.where("not is_interface").select(F.col("owner").alias("name"), "method")
    pairs = cut(resolve_interfaces(faces, concrete))
    place = types.select("owner", "path")
    found = pairs.join(place.toDF("type", "path"), "type").join(place.toDF("interface", "callee_path"), "interface")
    out = found.select(F.col("type").alias("caller"), F.col("interface").alias("callee"), "path", F.lit(0).alias("line"), "callee_path", F.lit("implements").alias("link_type"))
    name = F.substring_index("method", " ", 1)
    per_method = found.join(faces.withColumnRenamed("name", "interface"), "interface")
    satisfied = per_method.select(F.concat_ws(".", "type", name).alias("caller"), F.concat_ws(".", "interface", name).alias("callee"), "path", F.lit(0).alias("line"), "callee_path", F.lit("satisfies").alias("link_type"))
    inner = links.join(faces.toDF("inner", "method"), "inner").join(types.where("is_interface").select("owner", "path"), "owner")
    passed = inner.select(F.concat_ws(".", "owner", name).alias("caller"), F.concat_ws(".", "inner", name).alias("callee"), "path", F.lit(0).alias("line"), F.lit("").alias("callee_path"), F.lit("embeds").alias("link_type"))
    return out.unionByName(satisfied).unionByName(passed).distinct()


def incoming_calls(edges: DataFrame, names: list[str], path: str) -> DataFrame:
    """(caller, path, line) of direct calls of a symbol of one file: those with its path, and those of its name without any."""
    found = edges.where(F.col("callee").isin(names) & F.col("callee_path").isin(path, "") & ~F.col("link_type").isin(HIERARCHY))
    return found.select("caller", "path", "line").distinct()


def located_implementations(interfaces: DataFrame, places: DataFrame) -> DataFrame:
    """Edges from places (id, path, line) that a language server named as implementations of ``interfaces`` (id, name, path, start_line)."""
    i = interfaces.select("id", F.col("name").alias("callee"), F.col("path").alias("callee_path"), "start_line")
    found = places.join(i, "id").where((F.col("path") != F.col("callee_path")) | (F.col("line") != F.col("start_line")))
    return found.select(F.lit("impl").alias("caller"), "callee", "path", "line", "callee_path", F.lit("implements").alias("link_type")).distinct()


def dynamic_edges(edges: DataFrame) -> DataFrame:
    """Edges from interface methods to the methods that satisfy them: where a call of the former can go."""
    found = edges.where("link_type = 'satisfies'")
    return found.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), F.col("callee_path").alias("path"), "line", F.col("path").alias("callee_path"), F.lit("dynamic").alias("link_type")).distinct()


def class_hierarchy_calls(edges: DataFrame) -> DataFrame:
    """Every call that types allow, of link type ssa-call: calls as written, and calls of an interface's method to all that satisfy it."""
    calls = edges.where("link_type = 'call'").select("caller", "callee", "path", "line", "callee_path")
    targets = dynamic_edges(edges).select(F.col("caller").alias("callee"), F.col("callee").alias("target"), F.col("callee_path").alias("target_path")).distinct()
    through = calls.join(targets, "callee").select("caller", F.col("target").alias("callee"), "path", "line", F.col("target_path").alias("callee_path"))
    found = calls.unionByName(through)
    # dealt out before equal ones are sought: a task of the join makes many rows of few, and would hold them all at once
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * edges.sparkSession.sparkContext.defaultParallelism)
    return found.repartition(tasks, *found.columns).distinct().withColumn("link_type", F.lit("ssa-call"))


@dataclass(frozen=True)
class Propagation:
    """How a change spreads: tasks found by ``discover``, each given a ``transform`` and kept if ``validate`` holds."""

    discover: Callable[[DataFrame, DataFrame, str, int], DataFrame] = discover_tasks
    transform: Callable[[DataFrame], DataFrame] | None = None
    validate: Callable[[DataFrame], Column] | None = None

    def run(self, symbols: DataFrame, edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
        tasks = self.discover(symbols, edges, start, depth)
        tasks = tasks if self.transform is None else self.transform(tasks)
        return tasks if self.validate is None else tasks.where(self.validate(tasks))


def neighborhood(symbols: DataFrame, edges: DataFrame, imports: DataFrame, path: str) -> DataFrame:
    """(kind, a, b) of a file: imports, exported symbols and calls."""
    imp = imports.where(F.col("path") == path).select(F.lit("IMP").alias("kind"), F.col("import").alias("a"), F.lit("").alias("b"))
    exp = symbols.where((F.col("path") == path) & F.col("name").cast("string").rlike("^[A-Z]")).select(F.lit("EXP"), F.col("type"), F.col("name").cast("string"))
    call = edges.where(F.col("path") == path).select(F.lit("CALL"), F.col("caller").cast("string"), F.col("callee").cast("string"))
    return imp.union(exp).union(call).distinct()


def impact_edges(radius: DataFrame, symbol: str) -> DataFrame:
    """(child, parent, arrow) of a blast radius: the parent is the first caller one step nearer."""
    order = F.struct("path", "caller", "link_type")
    first = radius.groupBy(F.col("distance").alias("_d")).agg(F.min_by("caller", order).alias("_parent"))
    arrow = F.when(F.col("link_type") == "implements", "-.->").when(F.col("link_type") == "reference", "--o").otherwise("-->")
    joined = radius.join(F.broadcast(first), F.col("_d") == F.col("distance") - 1, "left")  # one row for each distance
    return joined.select(F.col("caller").cast("string").alias("child"), F.coalesce(F.col("_parent").cast("string"), F.lit(symbol)).alias("parent"), arrow.alias("arrow")).distinct()


def closure(flows: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """Functions reached from a variable over data flows (source, sink)."""
    origin = flows.sparkSession.range(1).select(F.lit(start).alias("node"))
    return reach(origin, flows.select(F.col("source").alias("src"), F.col("sink").alias("dst")), max_depth).where("depth > 0")


