"""Full-text, vector and hybrid search over an inverted index table."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.strings import trim
from tessera.functions.vectors import l2_distance

K1, B = 1.2, 0.75
RRF = 60
NEAREST = 100
#: Tasks over which the places of one token are spread.
SPREAD = 16
# fixed values: weights of the searched columns
COLUMN_WEIGHTS = {"name": 10.0, "type": 2.0, "signature": 5.0, "doc": 1.0, "path": 0.5}
SPLIT = "[^\\p{L}\\p{N}]+"


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), SPLIT), lambda w: w != "")


def build_index(rows: DataFrame, key: str, columns: list[str], more: list[str] = []) -> DataFrame:  # noqa: B006
    """Inverted index: (token, id, col, pos), from one pass over the rows; ``more`` columns of a row are on all of its places."""
    texts = F.array(*[F.struct(F.lit(c).alias("col"), tokenize(F.col(c)).alias("tokens")) for c in columns])
    each = rows.select(F.col(key).alias("id"), *more, F.explode(texts).alias("t"))
    return each.select("id", *more, "t.col", F.posexplode("t.tokens").alias("pos", "token")).select("token", "id", "col", "pos", *more)


@dataclass(frozen=True)
class Stored:
    """A written index: postings in order of their tokens, and the number of tokens of every row."""

    postings: DataFrame
    lengths: DataFrame  # id, length


def store_index(rows: DataFrame, key: str, columns: list[str], folder: str) -> Stored:
    """Write the index of ``rows`` to ``folder``; a search then reads the row groups of its tokens only."""
    postings = build_index(rows, key, columns)
    # dealt by token and a part of the ids: no token is in one task alone, and each file is in order of tokens
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(tasks, F.col("token"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("token", "id", "col", "pos").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
    sizes = rows.sparkSession.read.parquet(f"{folder}/postings").groupBy("id").agg(F.count("*").alias("length"))
    rows.select(F.col(key).alias("id")).join(sizes, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{folder}/lengths")
    return load_index(rows.sparkSession, folder)


def load_index(spark: SparkSession, folder: str) -> Stored:
    return Stored(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"))


def sanitize(query: str) -> str:
    """A quoted phrase with the trailing star kept; what has no word left is empty."""
    star = query.endswith("*")
    body = query.strip().removesuffix("*").replace('"', '""').lstrip("*")
    return f'"{body}"' + "*" * star if body else ""


def phrase_tokens(query: str) -> tuple[list[str], bool]:
    """Tokens of a query, and whether the last is a prefix."""
    body = query.strip()
    star = body.endswith("*")
    return [w for w in re.split(r"[\W_]+", body.lower()) if w], star


def phrase_match(index: DataFrame | Stored, query: str) -> DataFrame:
    """(id, col, pos) of every place where the query's tokens follow each other."""
    index = index.postings if isinstance(index, Stored) else index
    tokens, star = phrase_tokens(query)
    if not tokens:
        return index.select("id", "col", "pos").limit(0)
    found: DataFrame | None = None
    for i, t in enumerate(tokens):
        last = star and i == len(tokens) - 1
        hit = F.startswith(F.col("token"), F.lit(t)) if last else F.col("token") == t
        here = index.where(hit).select("id", "col", (F.col("pos") - i).alias("pos"))
        found = here if found is None else found.join(here, ["id", "col", "pos"])
    return found.distinct()


def bm25(index: DataFrame | Stored, documents: DataFrame, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, relevance): BM25 of the query as one phrase, negated so that less is better.

    ``documents``: (id) of all rows, so that rows without tokens count too.
    """
    weights = weights or {}
    hits = phrase_match(index, query)
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("col")), F.lit(1.0)) if weights else F.lit(1.0)
    tf = hits.groupBy("id").agg(F.sum(weight).alias("tf"))
    if isinstance(index, Stored):
        length = index.lengths
        facts = length.agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    else:
        length = index.groupBy("id").agg(F.count("*").alias("length"))
        facts = documents.agg(F.count("*").alias("n")).crossJoin(index.agg(F.count("*").alias("tokens")))
    totals = facts.crossJoin(tf.agg(F.count("*").alias("df")))  # one row each
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") * F.col("n") / F.col("tokens"))
    return length.join(tf, "id").crossJoin(F.broadcast(totals)).select("id", (-idf * F.col("tf") * (K1 + 1) / norm).alias("relevance"))


def weighted_search(index: DataFrame | Stored, documents: DataFrame, query: str, limit: int = 500) -> DataFrame:
    return bm25(index, documents, query, COLUMN_WEIGHTS).orderBy("relevance", "id").limit(limit)


def frecency(symbols: DataFrame, ids: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """Matched symbols, most used first."""
    return symbols.join(ids.select("id"), "id", "left_semi").orderBy(F.desc("runtime_hits"), "id").offset(offset).limit(limit)


def bump(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """One more hit for symbols that a search returned."""
    hit = ids.select("id", F.lit(1).alias("_h")).distinct()
    return symbols.join(hit, "id", "left").withColumn("runtime_hits", F.col("runtime_hits") + F.coalesce("_h", F.lit(0))).select(*symbols.columns)


def knn(vectors: DataFrame, query: list[float], k: int = NEAREST) -> DataFrame:
    """(id, distance) of the nearest ``k``; vectors of another size are left out."""
    same = vectors.where(F.size("embedding") == len(query))
    return same.select("id", l2_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", "id").limit(k)


def rank(rows: DataFrame, by: str) -> DataFrame:
    """(id, rn) of a limited result."""
    return rows.select("id", F.row_number().over(Window.orderBy(by, "id")).alias("rn"))


def fuse(text: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """(id, rrf_score): reciprocal ranks of both sides added up; each side has NEAREST rows at most."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(RRF)) + F.col(c)), F.lit(0.0))
    both = text.withColumnRenamed("rn", "a").join(vector.withColumnRenamed("rn", "b"), "id", "full_outer")
    return both.select("id", (part("a") + part("b")).alias("rrf_score")).orderBy(F.desc("rrf_score"), "id").limit(limit)


def hybrid(index: DataFrame | Stored, documents: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 20) -> DataFrame:
    text = rank(bm25(index, documents, query).orderBy("relevance", "id").limit(NEAREST), "relevance")
    return fuse(text, rank(knn(vectors, vector), "distance"), limit)


def search(index: DataFrame | Stored, documents: DataFrame, vectors: DataFrame, query: str, embed: Callable[[str], list[float]] | None, limit: int = 20) -> DataFrame:
    """Hybrid search, or text search alone if there is no embedder or it fails."""
    vector = None
    if embed is not None:
        try:
            vector = embed(query)
        except (ValueError, OSError, RuntimeError):
            vector = None
    if vector is None:
        return bm25(index, documents, query).orderBy("relevance", "id").limit(limit).select("id", (-F.col("relevance")).alias("rrf_score"))
    return hybrid(index, documents, vectors, query, vector, limit)


def search_all(index: DataFrame | Stored, documents: DataFrame, vectors: DataFrame, observations: DataFrame, query: str, embed: Callable[[str], list[float]] | None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Both sides of one question: (id, rrf_score) of symbols, and the notes that have the text."""
    return search(index, documents, vectors, query, embed, limit), insight_search(observations, query, limit)


def twins(symbols: DataFrame, name: str, path: str) -> DataFrame:
    """Other symbols with the structure of (name, path); an error if it is not known."""
    mine = symbols.where((F.col("name") == name) & (F.col("path") == path)).select("structural_hash").distinct()
    if mine.isEmpty():
        raise LookupError(f"no symbol {name!r} in {path!r}")
    same = symbols.join(mine, "structural_hash", "left_semi")
    return same.where(~((F.col("name") == name) & (F.col("path") == path)) & (F.coalesce("structural_hash", F.lit("")) != ""))


def all_twins(rows: DataFrame, key: str, hashed: str) -> DataFrame:
    """(key, twin): each row of a structure that others share, and the least key of it."""
    groups = rows.groupBy(hashed).agg(F.min(key).alias("twin"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, hashed).select(key, "twin", "n")


def parse_insight(observations: DataFrame) -> DataFrame:
    """(id, type, title, why, learned) from notes; of several lines of a kind the last counts."""
    header, alt = "^#\\s+(.+)$", "^\\[\\d+\\] #(\\d+) \\((\\w+)\\) (?:—|-) (.+)$"
    why, learned = "(?i)\\*\\*Why\\*\\*: (.+)$", "(?i)\\*\\*Learned\\*\\*: (.+)$"
    lines = F.transform(F.split("content", "\n"), lambda x: trim(x))
    last = lambda pattern, group: F.coalesce(F.try_element_at(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, group)), F.lit(-1)), F.lit(""))
    titled = F.filter(lines, lambda x: x.rlike(header) | x.rlike(alt))
    title = F.try_element_at(F.transform(titled, lambda x: F.when(x.rlike(header), F.regexp_extract(x, header, 1)).otherwise(F.regexp_extract(x, alt, 3))), F.lit(-1))
    return observations.select("id", last(alt, 2).alias("type"), F.coalesce(title, F.lit("")).alias("title"), last(why, 1).alias("why"), last(learned, 1).alias("learned"))


def insight_search(observations: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Notes with the text, letter case aside, newest first."""
    return observations.where(F.contains(F.lower("content"), F.lit(query.lower()))).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def insight_links(symbols: DataFrame, insights: DataFrame) -> DataFrame:
    """(symbol_id, insight_id) where a note's title, why or learned has the name as a word.

    Names that are one word meet the notes' words in an equi join; other names are
    found by their first word and then confirmed. The words carry ids alone; a note's
    text meets the names found in it once. Both joins sort: a note's words are more than
    its file tells, and a table thought small would go through the driver.
    """
    text = F.concat_ws("\n", "title", "why", "learned")
    notes = insights.select(F.col("id").alias("insight_id"), text.alias("text"))
    words = notes.select("insight_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda w: w != ""))).alias("word"))
    named = symbols.select(F.col("id").alias("symbol_id"), F.col("name").cast("string").alias("name"))
    names = named.select("name", F.regexp_extract(F.lower("name"), "[a-z0-9_]+", 0).alias("word")).where("word <> ''").distinct()
    met = words.hint("merge").join(names, "word").select("insight_id", "name")
    quoted = F.concat(F.lit("(?i)\\b"), F.regexp_replace("name", "([^A-Za-z0-9_\\s])", "\\\\$1"), F.lit("\\b"))
    found = notes.hint("merge").join(met, "insight_id").where(F.rlike(F.col("text"), quoted)).select("insight_id", "name").distinct()
    return found.join(named, "name").select("symbol_id", "insight_id").distinct()


def memory_scan(observations: DataFrame, project: str, since) -> DataFrame:
    return observations.where((F.col("project") == project) & (F.col("created_at") >= F.lit(since))).orderBy(F.desc("created_at"), F.desc("id"))


def correlate(memories: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(memory_id, symbol, paths): the first symbol named in a note, with up to three of its paths."""
    hits = insight_links(symbols, memories.select("id", F.col("content").alias("title"), F.lit("").alias("why"), F.lit("").alias("learned")))
    named = hits.join(symbols.select(F.col("id").alias("symbol_id"), F.col("name").cast("string").alias("name"), "path"), "symbol_id")
    first = named.groupBy("insight_id").agg(F.min("name").alias("name"))
    top = named.join(first, ["insight_id", "name"]).withColumn("r", F.row_number().over(Window.partitionBy("insight_id").orderBy("path", "symbol_id"))).where(F.col("r") <= most)
    return top.groupBy(F.col("insight_id").alias("memory_id"), F.col("name").alias("symbol")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def fresh_memories(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Notes whose text was not yet seen."""
    return new.join(seen.select("content").distinct(), "content", "left_anti")


def distilled(notes: DataFrame, by: str, distill: Callable[[list[str]], str]) -> DataFrame:
    """(by, text): the texts of each group, oldest first, given to ``distill``, which may ask a model; groups are bounded by their use."""

    def run(table):
        table = table.sort_by([("created_at", "ascending"), ("id", "ascending")])
        return pa.table({by: table[by].slice(0, 1), "text": pa.array([distill(table["content"].to_pylist())], pa.string())})

    kind = notes.schema[by].dataType.simpleString()
    return notes.select(by, "id", "content", "created_at").groupBy(by).applyInArrow(run, f"{by} {kind}, text string")
