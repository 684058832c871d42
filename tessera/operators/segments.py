"""A search index in immutable segments, with ranked blocks.

A segment holds the postings of some rows, written once. A change writes a segment of
its new rows and a list of the rows that it takes away, which count against all earlier
segments; segments of like size are merged when there are FANOUT of them, and what was
taken away is left out then. So a change writes in proportion to itself, and each row is
written again about once for each power of FANOUT.

Beside its postings a segment has, for each token, its rows by rank: BUCKETS classes of
the score that a row had when it was written, and of each class the largest score, counts
and shortest length. These bound every score in it: the first for the same weights, the
others, less closely, for any, whatever the average length is by then. A search for the best rows of a token reads the classes of the highest bounds
first, and none whose bound is below the k-th score found.

Tables of a segment: postings (token, bucket, id, counts, length, score, places), a row for each
token of a row, in order of token and class, dealt once and never joined again; ``places`` are
the column's number times 2**32 and the position; terms (token, bucket, n, most, shortest, top),
a row for each class; lengths (id, length). Of a removal: ids (id, length) and tokens (token, id).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search

FANOUT = 8
BUCKETS = 64
LOW = (1 << 32) - 1
ROWS_AT_ONCE = 200


@dataclass(frozen=True)
class Part:
    """A segment or a removal: its folder, its place in time, and how many rows and tokens it has."""

    folder: str
    seq: int
    rows: int
    tokens: int

    @property
    def average(self) -> float:
        return max(1.0, self.tokens / self.rows)


@dataclass(frozen=True)
class Report:
    """Classes and rows of a token that a search has read, and all of them."""

    classes: int
    of_classes: int
    rows: int
    of_rows: int


@dataclass(frozen=True)
class Segments:
    """State of an index; every change gives a new one and leaves the files of the old."""

    root: str
    columns: tuple[str, ...]
    segments: tuple[Part, ...] = ()
    removals: tuple[Part, ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Segments:
        d = json.loads(text)
        parts = lambda k: tuple(Part(**p) for p in d[k])
        return Segments(d["root"], tuple(d["columns"]), parts("segments"), parts("removals"))

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.segments) - sum(p.rows for p in self.removals)

    @property
    def tokens(self) -> int:
        return sum(p.tokens for p in self.segments) - sum(p.tokens for p in self.removals)

    # ---- reading

    def of(self, spark: SparkSession, table: str, parts: Iterable[Part]) -> DataFrame | None:
        read = [spark.read.parquet(f"{self.root}/{p.folder}/{table}").withColumn("seq", F.lit(p.seq)) for p in parts]
        return reduce(DataFrame.unionByName, read) if read else None

    def live(self, spark: SparkSession, table: str, parts: Iterable[Part] | None = None) -> DataFrame:
        """Rows (with ``seq``) of segments that no later removal names."""
        parts = self.segments if parts is None else parts
        rows, gone = self.of(spark, table, parts), self.of(spark, "ids", [r for r in self.removals if any(p.seq < r.seq for p in parts)])
        if gone is None:
            return rows
        gone = gone.select(F.col("id").alias("_id"), F.col("seq").alias("_seq"))
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("_seq")), "left_anti")

    def stored(self, spark: SparkSession) -> search.Stored:
        """The live rows in the form that every search takes."""
        each = self.live(spark, "postings").select("token", "id", "length", F.explode("places").alias("place"))
        col = F.element_at(F.array(*map(F.lit, self.columns)), (F.shiftright("place", 32) + 1).cast("int"))
        postings = each.select("token", "id", col.alias("col"), F.col("place").bitwiseAND(F.lit(LOW)).cast("int").alias("pos"), "length")
        return search.Stored(postings, self.live(spark, "lengths").drop("seq"))

    # ---- writing

    def changed(self, added: DataFrame, removed: DataFrame | None = None) -> Segments:
        """With rows ``added`` (id and the columns) and without ``removed``, earlier rows as they were; a new version of a row is both."""
        spark = added.sparkSession
        seq = max([p.seq for p in (*self.segments, *self.removals)], default=-1) + 1
        out = self
        if removed is not None and self.segments:
            out = replace(out, removals=(*out.removals, *self.removal(removed, seq)))
        sizes = reduce(lambda a, b: a + b, [F.size(search.tokenize(F.col(c))) for c in self.columns])
        part = self.segment(spark, self.packed(added), added.select("id", sizes.alias("length")), seq)
        return replace(out, segments=(*out.segments, *part)).merged(spark)

    def packed(self, rows: DataFrame) -> DataFrame:
        """(token, id, length, counts, places) from each row alone, so that a token's places in a row are dealt together."""
        n = len(self.columns)

        def run(batches):
            for batch in batches:
                for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(first, ROWS_AT_ONCE)
                    tokens, owner, lengths, counts, places = [], [], [], [], []
                    for k, columns in enumerate(zip(*[part.column(i + 1).to_pylist() for i in range(n)], strict=True)):
                        found: dict[str, list[int]] = {}
                        for i, words in enumerate(columns):
                            for at, word in enumerate(words, i << 32):
                                found.setdefault(word, []).append(at)
                        tokens += found
                        owner += [k] * len(found)
                        lengths += [sum(map(len, columns))] * len(found)
                        places += found.values()
                        counts += [[len(x)] if n == 1 else [sum(p >> 32 == i for p in x) for i in range(n)] for x in found.values()]
                    numbers = pa.list_(pa.int64())
                    arrays = [pa.array(tokens, pa.string()), part.column(0).take(pa.array(owner, pa.int64())), pa.array(lengths, pa.int32()), pa.array(counts, numbers), pa.array(places, numbers)]
                    yield pa.RecordBatch.from_arrays(arrays, ["token", "id", "length", "counts", "places"])

        lists = rows.select("id", *[search.tokenize(F.col(c)).alias(f"t{i}") for i, c in enumerate(self.columns)])
        return lists.mapInArrow(run, f"token string, id {lists.schema['id'].dataType.simpleString()}, length int, counts array<bigint>, places array<bigint>")

    def removal(self, removed: DataFrame, seq: int) -> list[Part]:
        spark, folder = removed.sparkSession, f"removed-{uuid.uuid4().hex}"
        sizes = reduce(lambda a, b: a + b, [F.size(search.tokenize(F.col(c))) for c in self.columns])
        removed.select("id", sizes.alias("length")).write.parquet(f"{self.root}/{folder}/ids")
        search.build_index(removed, "id", list(self.columns)).select("token", "id").distinct().sortWithinPartitions("token").write.parquet(f"{self.root}/{folder}/tokens")
        return self.counted(spark, folder, "ids", seq)

    def counted(self, spark: SparkSession, folder: str, table: str, seq: int) -> list[Part]:
        """The part of a written folder; none if it has no row."""
        n, tokens = spark.read.parquet(f"{self.root}/{folder}/{table}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return [Part(folder, seq, n, tokens)] if n else []

    def segment(self, spark: SparkSession, postings: DataFrame, lengths: DataFrame, seq: int) -> list[Part]:
        folder = f"segment-{uuid.uuid4().hex}"
        at = f"{self.root}/{folder}"
        lengths.write.parquet(f"{at}/lengths")
        found = self.counted(spark, folder, "lengths", seq)
        if not found:
            return []
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # by token and a part of the ids: no token is in one task alone, and each file is in order of tokens
        dealt = lambda df: df.repartition(tasks, F.col("token"), F.pmod(F.xxhash64("id"), F.lit(search.SPREAD)))
        written = lambda df, name: df.write.option("parquet.block.size", 8 << 20).parquet(f"{at}/{name}")
        # scores follow the exchange: they are its widest part and are made of the rest
        rows = dealt(postings)
        score = self.score(F.col("counts"), F.col("length"), found[0].average, search.COLUMN_WEIGHTS)
        bucket = F.least(F.floor(score / (search.K1 + 1) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        ranked = rows.select("token", bucket.alias("bucket"), "id", "counts", F.col("length").cast("long").alias("length"), score.alias("score"), "places")
        written(ranked.sortWithinPartitions("token", F.desc("bucket"), "id"), "postings")
        most = F.array(*[F.max(F.col("counts")[i]) for i in range(len(self.columns))])
        terms = spark.read.parquet(f"{at}/postings").groupBy("token", "bucket").agg(F.count("*").alias("n"), most.alias("most"), F.min("length").alias("shortest"), F.max("score").alias("top"))
        written(terms.sortWithinPartitions("token"), "terms")
        return found

    def score(self, counts: Column, length: Column, average: float, weights: dict[str, float]) -> Column:
        """BM25 without the part that all rows of a token share."""
        tf = reduce(lambda a, b: a + b, [counts[i] * F.lit(float(weights.get(c, 1.0))) for i, c in enumerate(self.columns)])
        return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / F.lit(average)))

    def merged(self, spark: SparkSession) -> Segments:
        """With segments of like size put together where there are FANOUT of them."""
        out = self
        while True:
            tiers: dict[int, list[Part]] = {}
            for p in out.segments:
                tiers.setdefault(int(math.log(p.rows + 1, FANOUT)), []).append(p)
            full = [v for v in tiers.values() if len(v) >= FANOUT]
            if not full:
                return out
            out = out.put_together(spark, min(full, key=lambda v: sum(p.rows for p in v)))

    def put_together(self, spark: SparkSession, parts: list[Part]) -> Segments:
        seq = max(p.seq for p in parts)
        # versions of one row in several of them: all but the newest are removed rows
        new = self.segment(spark, self.live(spark, "postings", parts).select("token", "id", "length", "counts", "places"), self.live(spark, "lengths", parts).drop("seq"), seq)
        removals: list[Part] = []
        for r in self.removals:
            inside = [p for p in parts if p.seq < r.seq]
            if not inside:
                removals.append(r)
                continue
            # what it took from these segments is gone now
            done = self.of(spark, "lengths", inside).select("id")
            folder = f"removed-{uuid.uuid4().hex}"
            for table in ("ids", "tokens"):
                spark.read.parquet(f"{self.root}/{r.folder}/{table}").join(done, "id", "left_anti").write.parquet(f"{self.root}/{folder}/{table}")
            removals += self.counted(spark, folder, "ids", r.seq)
        kept = tuple(p for p in self.segments if p not in parts)
        return replace(self, segments=tuple(sorted((*kept, *new), key=lambda p: p.seq)), removals=tuple(removals))

    # ---- the best rows of a token

    def best(self, spark: SparkSession, word: str, k: int, weights: dict[str, float] | None = None) -> tuple[DataFrame, Report]:
        """(id, relevance) of the ``k`` best rows for one word, as ``search.bm25`` ranks them, and what was read for them."""
        weights = weights or {}
        tokens, star = search.phrase_tokens(word)
        if len(tokens) != 1 or star:
            raise ValueError("one whole word is ranked by classes; rank phrases and beginnings of words with bm25")
        if not self.segments:
            return spark.createDataFrame([], "id long, relevance double"), Report(0, 0, 0, 0)
        here = F.col("token") == tokens[0]
        average = self.tokens / max(1, self.rows)
        # BUCKETS rows for each segment at most
        bound = self.score(F.col("most"), F.col("shortest"), average, weights)
        if all(weights.get(c, 1.0) == search.COLUMN_WEIGHTS.get(c, 1.0) for c in self.columns):
            # a score rises at most as the average length has risen since
            risen = F.lit(1.0)
            for p in self.segments:
                risen = F.when(F.col("seq") == p.seq, max(1.0, average / p.average)).otherwise(risen)
            bound = F.least(bound, F.col("top") * risen)
        facts = self.of(spark, "terms", self.segments).where(here).withColumn("bound", bound)
        classes = sorted(facts.select("seq", "bucket", "n", "bound").collect(), key=lambda r: -r.bound)
        gone = self.of(spark, "tokens", self.removals)
        total = sum(r.n for r in classes)
        df = total - (gone.where(here).count() if gone is not None else 0)
        idf = max(math.log((self.rows - df + 0.5) / (df + 0.5)), 1e-6)
        ranks = self.live(spark, "postings").where(here)

        def scored(some: list) -> DataFrame:
            wanted = F.lit(False)
            for seq in {r.seq for r in some}:
                wanted = wanted | ((F.col("seq") == seq) & F.col("bucket").isin([r.bucket for r in some if r.seq == seq]))
            rows = ranks.where(wanted).select("id", (-idf * self.score(F.col("counts"), F.col("length"), average, weights)).alias("relevance"))
            return rows.orderBy("relevance", "id").limit(k)

        taken, wanted = 0, 2 * k
        while True:
            while taken < len(classes) and sum(r.n for r in classes[:taken]) < wanted:
                taken += 1
            found = scored(classes[:taken])
            # two numbers: of k rows at most
            n, last = found.agg(F.count("*"), F.max("relevance")).first()
            if n >= k or taken == len(classes):
                break
            wanted *= 4
        # a bound may be a rounding away from the score that it bounds
        more = [r for r in classes[taken:] if r.bound >= -last / idf * (1 - 1e-9)]
        taken += len(more)
        report = Report(taken, len(classes), sum(r.n for r in classes[:taken]), total)
        return scored(classes[:taken]) if more else found, report
