"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set of word shingles has a signature: of each of COORDINATES hash functions the
least value. Two sets agree in a coordinate with the probability of their Jaccard
similarity, so the number of agreements of a link is binomial, and a least number follows
from the odds of missing one (ODDS). The first POSTED coordinates are posted: a text is
listed under each pair of coordinate and value. Texts that must share so many lists share
one of the rarest of each (the prefix): a text is left listed only there, and not at all
if too few of its lists have another text. Lists are merged by prefix: a pair is counted in the first list that
both prefixes share and skipped in all others, only sizes that can be similar meet, and a
count runs over whole signatures. What is above the threshold is compared by whole sets,
so no false link is left.

Only different sets are posted; copies follow their set. A list of over SMALL sets gives
first, for each set, its best match among the smaller ones, cut in chunks if the list is
long. These links join most of a large group; then only sets that are still in different
components are compared, those of a list's largest component with those outside it and the
latter with each other, whole set by whole set, in cells of two chunks each. So every pair
that could join two components is looked at, no list is one task, and rows that a group of
near copies gives are in proportion to its sets and links, also where most of its pairs are nearly similar.

Sets are compared as sorted 64-bit hashes of shingles: two different shingles of one
pair of texts share one with odds of their product over 2**64.

Defined cases: a text with fewer words than a shingle is one shingle; a null, empty or
blank text has an empty set, is linked with nothing and is its own component; repeated
rows each get a row; a null ``doc_id`` names a component only if it has no other, and a
row is kept if its ``doc_id`` is its component's, null being equal to null; a long text
is a slice of its own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import parts, textvec
from tessera.llm.graph import components
from tessera.llm.scratch import fresh_path, materialize, small_batches
from tessera.llm.simhash import LOWER

COORDINATES, POSTED = 128, 40
#: Of a link to have fewer agreements than the least number.
ODDS = 1e-10
#: Sets of a list whose pairs are all looked at at once, and sets of a chunk of a longer one.
SMALL, CHUNK = 64, 1024
#: Hashes of the whole sets of a chunk, about.
HASHES = 1 << 20
#: Pairs that are compared at a time.
BLOCK = 1 << 18


def least_agreements(coordinates: int, percent: int) -> int:
    """The largest number that a pair of this similarity has fewer agreements than with odds of ODDS at most."""
    p, odds = percent / 100, 0.0
    for t in range(coordinates):
        odds += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if odds > ODDS:
            return max(t, 1)
    return coordinates


# ---- sets and signatures


def sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, in order, and the first of each text (one entry more than texts)."""
    buf, offsets = textvec.utf8(texts)
    buf = LOWER[buf]
    starts, ends, first = textvec.words(buf, offsets, ~textvec.SPACE)
    words = np.diff(first)
    n = np.where(words > shingle, words - shingle + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hashed = textvec.Rolling(buf).ranges(starts, ends)
    value = np.zeros(len(row), np.uint64)
    for i in range(shingle):
        inside = at + i < first[row + 1]  # a text of fewer words is shorter
        value[inside] = textvec.mix(value[inside] * np.uint64(textvec.BASE) + hashed[at[inside] + i])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


SEEDS = textvec.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(textvec.BASE))


def signatures(value: np.ndarray, first: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Least values, a row for each set; sets have one hash at least."""
    out = np.empty((len(first), coordinates), np.uint32)
    x = (value >> np.uint64(32)).astype(np.uint32)
    for i, seed in enumerate(SEEDS[:coordinates]):
        y = (x ^ np.uint32(seed >> np.uint64(32))) * np.uint32((seed & np.uint64(0xFFFFFFFF)) | np.uint64(1))
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(y ^ (y >> np.uint32(13)), first)
    return out


def described(texts: pa.Array, shingle: int) -> list[pa.Array]:
    """Size, two sums that name the set, and signature of each text's set."""
    columns: list[list[np.ndarray]] = [[], [], []]
    signs: list = []
    for part in textvec.slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 1 << 20):
        value, first = sets(part.column(0), shingle)
        some = np.diff(first) > 0
        sums = np.zeros((2, len(some)), np.uint64)
        found = np.full(len(some), None, object)
        if some.any():
            at = first[:-1][some]
            sums[0][some] = np.add.reduceat(textvec.mix(value + np.uint64(1)), at)
            sums[1][some] = np.add.reduceat(textvec.mix(value * np.uint64(textvec.BASE)), at)
            found[some] = [s.tobytes() for s in signatures(value, at)]
        for column, values in zip(columns, (np.diff(first), sums[0].view(np.int64), sums[1].view(np.int64)), strict=True):
            column.append(values)
        signs += found.tolist()
    return [*[pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], pa.array(signs, pa.binary())]


# ---- lists and pairs


def postings(classes: DataFrame) -> DataFrame:
    """(node, key) for each posted coordinate; key holds coordinate and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column(1))[:, :POSTED].astype(np.int64)
                keys = values + (np.arange(POSTED, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), POSTED)), pa.array(keys.ravel())], ["node", "key"])

    return small_batches(classes.select("node", "sig")).mapInArrow(run, "node long, key long")


def matrix(signs: pa.Array) -> np.ndarray:
    raw, _ = textvec.utf8_bytes(signs)
    return raw.view(np.uint32).reshape(-1, COORDINATES)


def lists(classes: DataFrame, percent: int) -> DataFrame:
    """(key, total, node, mask) of all lists with more than one set; mask has the coordinates of the set's prefix."""
    least = least_agreements(POSTED, percent)
    posted = postings(classes)
    counts = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # POSTED entries at most for each set
    ranked = posted.join(counts, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("by")).where(F.size("by") >= least)
    prefix = F.transform(F.slice("by", 1, F.size("by") - (least - 1)), lambda x: x["key"])
    mask = F.aggregate("prefix", F.lit(0).cast("long"), lambda acc, key: acc + F.pow(F.lit(2.0), F.shiftright(key, 32)).cast("long"))
    listed = materialize(ranked.select("node", prefix.alias("prefix")).select("node", mask.alias("mask"), F.explode("prefix").alias("key")), "lists")
    totals = materialize(listed.groupBy("key").agg(F.count("*").alias("total")).where("total > 1"), "totals")
    return materialize(listed.join(totals, "key").select("key", "total", "node", "mask"), "lists")


class Group:
    """Rows of whole cells, in order of cell and size; they carry signatures, or ``whole`` sets."""

    def __init__(self, table: pa.Table, whole: bool):
        column = lambda name: table[name].to_numpy()
        self.node, self.n, self.mask, self.label, self.component = (column(c) for c in ("node", "n", "mask", "label", "component"))
        self.coordinate = column("key") >> 32
        self.all = column("every")
        self.cell = np.cumsum(changes(table)) - 1
        carried = table["carried"].combine_chunks()
        if whole:
            raw, offsets = textvec.utf8_bytes(carried)
            value, self.first = raw.view(np.uint64), offsets // 8
            self.codes = np.unique(value, return_inverse=True)[1].astype(np.int32)
            self.signs = signatures(value, self.first[:-1], POSTED)
        else:
            self.signs = matrix(carried)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of a cell that sizes, labels and components allow, some at a time."""
        most = int(self.n.max()) + 1
        place = self.cell * most + self.n
        bound = self.cell * most + np.minimum(100 * self.n // percent, most - 1)
        count = np.searchsorted(place, bound, side="right") - np.arange(len(place)) - 1
        at = 0
        total = np.concatenate([[0], np.cumsum(count)])
        while at < len(count):
            end = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK, side="right")) - 1)
            a = np.repeat(np.arange(at, end), count[at:end])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[at:end] - total[at], count[at:end])
            fit = (self.label[a] != self.label[b]) & (self.component[a] != self.component[b])
            yield a[fit], b[fit]
            at = end

    def own(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that share no list of an earlier coordinate."""
        for i in range(int(self.coordinate[a].max(initial=0))):
            both = (self.mask[a] & self.mask[b]) >> i & 1 == 1
            skip = both & (self.coordinate[a] > i) & (self.signs[a, i] == self.signs[b, i])
            a, b = a[~skip], b[~skip]
        return a, b

    def matches(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = BLOCK // 16
        return np.concatenate([np.zeros(0, np.int64), *[(self.signs[a[i : i + step]] == self.signs[b[i : i + step]]).sum(axis=1) for i in range(0, len(a), step)]])

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common hashes of pairs of whole sets; those of one ``a`` follow each other."""
        out, here = np.zeros(len(a), np.int64), np.zeros(int(self.codes.max(initial=0)) + 1, bool)
        edges = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = self.codes[self.first[a[i]] : self.first[a[i] + 1]]
            low, high = int(b[i:j].min()), int(b[i:j].max()) + 1
            here[mine] = True
            sums = np.add.reduceat(here[self.codes[self.first[low] : self.first[high]]], self.first[low:high] - self.first[low], dtype=np.int64)
            out[i:j] = sums[b[i:j] - low]
            here[mine] = False
        return out

    def linked(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of all pairs whose whole sets are similar."""
        out = [(np.zeros(0, np.int64),) * 2]
        for a, b in self.pairs(percent):
            a, b = self.own(a, b)
            both = self.shared(a, b)
            keep = 100 * both >= percent * (self.n[a] + self.n[b] - both)
            out.append((self.node[a[keep]], self.node[b[keep]]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return np.minimum(a, b), np.maximum(a, b)

    def found(self, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the pairs above the threshold: all of them, or the best of each set where not all are asked for."""
        out_a, out_b = [], []
        best, of = np.zeros(len(self.node), np.int64), np.zeros(len(self.node), np.int64)
        for a, b in self.pairs(percent):
            a, b = self.own(a, b)
            n = self.matches(a, b)
            a, b, n = a[n >= least], b[n >= least], n[n >= least]
            every = self.all[a]
            out_a.append(self.node[a[every]])
            out_b.append(self.node[b[every]])
            a, b, n = a[~every], b[~every], n[~every]
            order = np.lexsort((-a, n, b))  # the last of each b is its best
            a, b, n = a[order], b[order], n[order]
            last = np.flatnonzero(np.append(b[1:] != b[:-1], len(b) > 0)) if len(b) else np.zeros(0, np.int64)
            better = last[n[last] > best[b[last]]]
            best[b[better]], of[b[better]] = n[better], a[better]
        some = np.flatnonzero(best)
        a, b = np.concatenate([*out_a, self.node[of[some]]]), np.concatenate([*out_b, self.node[some]])
        return np.minimum(a, b), np.maximum(a, b)


CELL = ["key", "x", "y", "kind"]


def changes(table: pa.Table) -> np.ndarray:
    """True where a cell begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in CELL:
        values = table[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def merged(cells: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b) of rows (key, x, y, kind, every, node, n, mask, label, component, carried): pairs of a cell above the threshold, or links if rows carry whole sets."""
    least = least_agreements(COORDINATES, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def look(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows > 1:
                group = Group(rows, whole)
                a, b = group.linked(percent) if whole else group.found(percent, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            begin = int(np.flatnonzero(changes(table))[-1])  # the last cell may go on
            if begin:
                yield from look(table.slice(0, begin))
                held = table.slice(begin).combine_chunks().to_batches()
        if held:
            yield from look(pa.Table.from_batches(held))

    ordered = cells.repartition(*CELL).sortWithinPartitions(*CELL, "n")
    return materialize(small_batches(ordered).mapInArrow(run, "a long, b long").distinct(), "pairs")


COLUMNS = [*CELL, "every", "node", "n", "mask", "label", "component", "carried"]


def nearest(listed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of short lists above the threshold, and in longer ones the best of each set in its chunk."""
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / CHUNK))
    rows = listed.join(classes.select("node", "n", "sig"), "node")
    rows = rows.withColumns({"x": chunk, "y": F.lit(0), "kind": F.lit(0), "every": F.col("total") <= SMALL, "label": F.col("node"), "component": F.col("node"), "carried": F.col("sig")})
    return merged(rows.select(COLUMNS), percent, False)


def outside(listed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of long lists that meet several components (node, root), with ``component`` and the list's largest, ``main``; what is in it makes ``inside`` chunks and the rest ``outside``."""
    long = listed.where(F.col("total") > SMALL).join(classes.select("node", "n"), "node").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    long = materialize(long, "long")
    load = F.sum(F.lit(1.0) / CHUNK + F.col("n") / float(HASHES))
    counts = long.groupBy("key", "component").agg(F.count("*").alias("sets"), load.alias("load"))
    largest = F.max_by(F.struct("component", "load"), F.struct("sets", "component"))
    main = counts.groupBy("key").agg(largest.alias("m"), F.sum("load").alias("load"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("key", F.col("m.component").alias("main"), F.ceil("m.load").alias("inside"), F.ceil(F.col("load") - F.col("m.load")).alias("outside"))
    return materialize(long.join(materialize(main, "main"), "key"), "long")


def across(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links of ``outside`` rows whose ends are in different components, by their whole sets (node, hashes).

    Sets move instead of pairs: what leaves a cell are links, however many of its pairs are nearly similar.
    """
    rows = rows.withColumn("is_main", F.col("component") == F.col("main"))
    number = lambda n: F.greatest(F.col(n), F.lit(1))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), number("inside")).otherwise(number("outside"))))
    cell = lambda x, y, kind, label: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(kind).alias("kind"), label.cast("long").alias("label"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), number(n) - 1)
    chunk = F.col("chunk")
    # a chunk of one side meets all of the other; outer chunks meet each other, and themselves by node
    inner = F.transform(each("outside"), lambda x: cell(x, chunk, 0, F.lit(0)))
    outer = F.concat(F.transform(each("inside"), lambda y: cell(chunk, y, 0, F.lit(1))), F.transform(each("outside"), lambda y: cell(F.least(chunk, y), F.greatest(chunk, y), 1, F.when(chunk == y, F.col("node")).otherwise(chunk))))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("is_main"), inner).otherwise(outer))).select("key", "node", "n", "mask", "component", "cell.*", F.lit(True).alias("every"))
    return merged(rows.join(held.withColumnRenamed("hashes", "carried"), "node").select(COLUMNS), percent, True)


# ---- whole sets


def whole_sets(nodes: DataFrame, classes: DataFrame, folder: str, tasks: int, shingle: int) -> DataFrame:
    """(node, hashes) of ``nodes`` (node), read again from the stored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide, rows in parts.of_parts(batches, folder):
            texts = wide.batch.column(1).take(pa.array(rows["row"].to_numpy() - wide.first))
            value, first = sets(texts, shingle)
            found = pa.array([value[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows["node"].to_numpy()), found], ["node", "hashes"])

    places = nodes.join(classes.select("node", "place.part", "place.row"), "node").select("part", "row", "node")
    return materialize(parts.by_part(places, tasks, "row").mapInArrow(run, "node long, hashes binary"), "sets")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    return materialize(small_batches(rows.select("a", "b", "x", "y")).mapInArrow(run, "a long, b long"), "links")


def classes_of(listed: DataFrame) -> DataFrame:
    """(node, n, s1, s2, best, place, sig) for each different set; best is the least doc_id of its texts."""
    found = listed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("best"), F.min(F.struct("part", "row")).alias("place"), F.first("sig").alias("sig"))
    return materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    folder = fresh_path(docs.sparkSession, "texts")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = parts.store(narrow, folder, 1, lambda piece: [piece.column(0), *described(piece.column(1), shingle)], "doc_id long, n long, s1 long, s2 long, sig binary")
    tasks = max(1, listed.select("part").distinct().count())
    classes = classes_of(listed)
    by_key = lists(classes, percent)
    first = nearest(by_key, classes, percent)
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = whole_sets(ends(first), classes, folder, tasks, shingle)
    links = confirmed(first, held, percent)
    roots = materialize(components(links), "roots")
    rows = outside(by_key, classes, roots)
    more = whole_sets(rows.select("node").distinct().join(held.select("node"), "node", "left_anti"), classes, folder, tasks, shingle)
    links = links.unionByName(across(rows, held.unionByName(more), percent))
    named = classes.select("node", "n", "s1", "s2", "best").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialize(named.groupBy("root").agg(F.min("best").alias("component_id")), "least")
    # written out, so that the join reads two exchanges and a set with many copies can be split
    labels = materialize(named.join(least, "root").select("n", "s1", "s2", "component_id"), "labels")
    rows = listed.select("doc_id", "n", "s1", "s2")
    out = rows.where("n > 0").join(labels, ["n", "s1", "s2"]).unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
