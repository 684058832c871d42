"""Exact substring removal by a distributed suffix merge sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.
That holds for a string exactly if its suffix shares ``LENGTH`` bytes with a
neighbour in sorted order. Sorting every suffix would move hundreds of bytes for
each byte of text, so only suffixes that can matter are sorted:

1. Every window of LENGTH bytes is named by its anchor, the least hashed gram in
   it; consecutive windows with one anchor form a stretch. Equal windows have equal
   anchors, so windows of a stretch whose anchor hash occurs once cannot repeat.
2. Stretches that occur whole elsewhere are one suffix each. Where stretches with
   one anchor differ, their windows are compared by hash, and consecutive windows
   that occur together everywhere become one suffix.
3. Each task sorts its suffixes into a run, front-codes it and exchanges it by
   range; equal strings of a run travel once. Receivers combine runs with a loser
   tree that never compares bytes known to be shared. The shared lengths it yields
   decide: a suffix repeats if it shares all its bytes with a neighbour.
4. Steps 1 and 2 take strings with one hash for equal. The merge sees the strings:
   where one hash named two, all windows of all stretches with that anchor are
   sorted as suffixes of their own, and bytes alone decide.

So hashes choose what to sort, and no answer rests on them. Texts are copied once,
compressed, to part files in the shared folder, and later steps go back to those by
part, so texts are never shuffled. Anchors with very many different stretches (a
passage that a third of the texts share) have their windows counted by a
pre-aggregated group-by instead of in one task; both ways give the same suffixes.

Defined cases: a null or empty text has no bytes; texts under LENGTH bytes lose
nothing; repeated rows are separate documents, so texts of LENGTH bytes or more
that occur twice lose all; ties do not arise, as every occurrence of a repeated
string goes; a long text is hashed a megabyte at a time, and its task holds about
fifteen bytes for each of its bytes; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import parts as parts_
from tessera.llm import textvec
from tessera.llm.parts import PIECE, by_part, same, storage
from tessera.llm.runs import first_id, front_code, repeated
from tessera.llm.scratch import fresh_path, materialize, release, small_batches

LENGTH = 200
GRAM = 48
#: An anchor with more different stretches than this is counted by window instead of in one task.
MOST_IN_TASK = 4096
#: Stretches that a task compares at a time, but for those of one anchor.
CHUNK = 2048
#: Bytes of texts in a part file, but for a longer text; a task sorts the suffixes of a part at a time.
PART_BYTES = 16 << 20
#: Bytes of suffixes in a range of the merge, about, as long as that takes MOST_RANGES ranges or fewer.
RANGE_BYTES, MOST_RANGES = 64 << 20, 100_000
#: Sampled keys for each range, and the bytes of a suffix that decide its range.
SAMPLES_A_RANGE, KEY = 8, 64

PLACE = "part string, row int, start int, length int, c long"


@dataclass(frozen=True)
class Job:
    """Where the texts are and how they are compared; ``bits`` of a hash are used as a name."""

    folder: str
    length: int = LENGTH
    gram: int = GRAM
    bits: int = 64
    parts: int = 1

    def name(self, h: np.ndarray) -> np.ndarray:
        return h if self.bits == 64 else h & np.uint64((1 << self.bits) - 1)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` consecutive values."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    n = len(h) - width + 1
    while size * 2 <= width:
        later = value[size:] < value[:-size]
        place = np.where(later, place[size:], place[:-size])
        value = np.where(later, value[size:], value[:-size])
        size *= 2
    shift = width - size
    return np.where(value[shift : shift + n] < value[:n], place[shift : shift + n], place[:n])


def stretches(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, start in the row, windows, anchor hash, whole hash."""
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    rolling = textvec.Rolling(buf)
    grams = rolling.grams(gram)
    anchor = least(grams, length - gram + 1)
    at = np.arange(len(anchor))
    row = np.searchsorted(offsets, at, side="right") - 1
    whole = offsets[row + 1] - at >= length
    change = np.ones(len(at), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(at)) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    return row[first], first - offsets[row[first]], last - first + 1, grams[anchor[first]], rolling.ranges(first, last + length)


def pieces(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``stretches`` of a slice, a long text by parts that overlap, so that each window is in one of them."""
    if len(offsets) > 2 or len(buf) <= 2 * PIECE:
        yield stretches(buf, offsets, length, gram)
        return
    for at in range(0, len(buf), PIECE):
        part = buf[at : at + PIECE + length - 1]
        row, start, *rest = stretches(part, np.array([0, len(part)]), length, gram)
        yield row, start + at, *rest


def store(docs: DataFrame, job: Job) -> DataFrame:
    """Copy the texts to part files and list their stretches: (part, row, start, n, h, u).

    A row with a null ``h`` stands for each part. Written out once, since it makes files.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])
    out = pa.schema([("part", pa.string()), ("row", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(job.folder)
        part, sink, writer, rows, size = "", None, None, 0, 0
        for batch in batches:
            for piece in textvec.slices(batch, limit=PIECE):
                if writer is not None and size >= PART_BYTES:
                    writer.close()
                    sink.close()
                    writer = None
                if writer is None:
                    part, rows, size = uuid.uuid4().hex, 0, 0
                    sink = system.open_output_stream(f"{plain}/{part}.texts", compression=None)
                    writer = pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    yield pa.RecordBatch.from_arrays([pa.array([part]), *[pa.nulls(1, f.type) for f in list(out)[1:]]], schema=out)
                buf, offsets = textvec.utf8(piece.column(1))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
                writer.write_batch(pa.RecordBatch.from_arrays([piece.column(0), texts], schema=schema))
                for row, start, n, h, u in pieces(buf, offsets, job.length, job.gram):
                    yield pa.RecordBatch.from_arrays(
                        [same(len(row), part), pa.array((row + rows).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(job.name(u).view(np.int64))],
                        schema=out,
                    )
                rows += piece.num_rows
                size += len(buf)
        if writer is not None:
            writer.close()
            sink.close()

    return materialize(small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part string, row int, start int, n int, h long, u long"), "stretches")


class Part(parts_.Reader):
    """The texts of a part file, as one buffer for each batch."""

    ending = "texts"

    def next_batch(self) -> bool:
        if not super().next_batch():
            return False
        data = self.batch.column(1)
        self.offsets = np.frombuffer(data.buffers()[1], np.int64)[: self.batch.num_rows + 1]
        self.buf = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None and data.buffers()[2].size else np.zeros(0, np.uint8)
        return True

    def place(self, row: np.ndarray) -> np.ndarray:
        """Where these rows of the present batch begin in ``buf``."""
        return self.offsets[row - self.first]


def of_parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[Part, pa.Table]]:
    return parts_.of_parts(batches, folder, Part)


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(np.int64) for n in names]


def units(w: np.ndarray, owner: np.ndarray, place: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes for windows that occur twice or more: index of the first window and number of windows.

    ``w``: window hashes, in order of ``owner`` and ``place``; ``single``: not yet
    known to repeat. Windows that follow each other in all their occurrences join.
    """
    _, name, count = np.unique(w, return_inverse=True, return_counts=True)
    wanted = np.zeros(len(count), bool)
    wanted[name[single]] = True
    index = np.flatnonzero((wanted & (count > 1))[name])
    if not len(index):
        return index, index
    name = name[index]
    nxt = np.full(len(index), -1)
    adjoins = (owner[index][1:] == owner[index][:-1]) & (place[index][1:] == place[index][:-1] + 1)
    nxt[:-1][adjoins] = name[1:][adjoins]
    low, high = np.full(len(count), len(count)), np.full(len(count), -1)
    np.minimum.at(low, name, nxt)
    np.maximum.at(high, name, nxt)
    link = np.where((low == high) & (low >= 0) & (count == count[np.maximum(high, 0)]), high, -1)
    begins = np.ones(len(index), bool)
    begins[1:] = ~(adjoins & (link[name[:-1]] == name[1:]))
    first = np.flatnonzero(begins)
    return index[first], np.diff(np.append(first, len(index)))


def near(at: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Groups of spans, in order of ``at``, that lie within about PIECE bytes: first, last + 1, begin and end of their bytes."""
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + PIECE, side="right"))
        yield i, j, int(at[i]), int(end[i:j].max())
        i = j


def compare(classes: DataFrame, job: Job) -> DataFrame:
    """Suffixes of differing stretches (part, row, start, n, h, single) with one anchor, an anchor at a time."""
    length = job.length

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in of_parts(batches, job.folder):
            row, start, n = columns(rows, "row", "start", "n")
            at = texts.place(row) + start
            raw = memoryview(texts.buf)
            found = pa.array([raw[a : a + m + length - 1].tobytes() for a, m in zip(at.tolist(), n.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[rows[c].combine_chunks() for c in ("part", "row", "start", "n", "h", "single")], found], ["part", "row", "start", "n", "h", "single", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                end = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if end:
                    yield from resolve(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield from resolve(pa.Table.from_batches(held))

    def resolve(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        h = whole["h"].to_numpy()
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        at = 0
        while at < len(h):
            to = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + CHUNK))])
            table = whole.slice(at, to - at)
            at = to
            n, start = columns(table, "n", "start")
            buf, offsets = textvec.utf8_bytes(table["bytes"].combine_chunks())
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            w = job.name(textvec.Rolling(buf).grams(length)[offsets[owner] + place])
            index, many = units(w, owner, place, table["single"].to_numpy(zero_copy_only=False)[owner])
            mine = owner[index]
            named = textvec.mix(w[index] ^ textvec.mix(table["h"].to_numpy()[mine].view(np.uint64) + many.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([table["part"].combine_chunks().take(pa.array(mine)), table["row"].combine_chunks().take(pa.array(mine)), pa.array((start[mine] + place[index]).astype(np.int32)), pa.array((many + length - 1).astype(np.int32)), pa.array(named.view(np.int64))], ["part", "row", "start", "length", "c"])

    found = by_part(classes, job.parts, "row", "start").mapInArrow(fetch, "part string, row int, start int, n int, h long, single boolean, bytes binary")
    return found.repartition("h").sortWithinPartitions("h", "part", "row", "start").mapInArrow(run, PLACE)


def count_windows(classes: DataFrame, job: Job) -> tuple[DataFrame, list[DataFrame]]:
    """The same for anchors with very many stretches, window by window, counted by a group-by; and its working tables."""
    length = job.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, whole in of_parts(batches, job.folder):
            every = columns(whole, "row", "start", "n")
            at = texts.place(every[0]) + every[1]
            for i, j, low, high in near(at, at + every[2] + length - 1):
                yield from windows_of(texts, whole.slice(i, j - i).combine_chunks(), low, high)

    def windows_of(texts: Part, rows: pa.Table, low: int, high: int) -> Iterator[pa.RecordBatch]:
        row, start, n = columns(rows, "row", "start", "n")
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[owner]
        w = job.name(textvec.Rolling(texts.buf[low:high]).grams(length)[texts.place(row)[owner] + place - low])
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), same(len(owner), rows["part"][0].as_py()), pa.array(row[owner].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(rows["single"].to_numpy(zero_copy_only=False)[owner])], ["w", "part", "row", "start", "single"])

    windows = materialize(by_part(classes, job.parts, "row", "start").mapInArrow(run, "w long, part string, row int, start int, single boolean"), "windows")
    wanted = windows.groupBy("w").agg(F.count("*").alias("k"), F.max("single").alias("s")).where("k > 1 and s").select("w")
    wanted = materialize(wanted, "wanted")  # see candidates
    return windows.join(wanted, "w").select("part", "row", "start", F.lit(length).alias("length"), F.xxhash64("w").alias("c")), [windows, wanted]


def candidates(found: DataFrame, job: Job) -> DataFrame:
    """(part, row, start, length, c) of all suffixes to sort, once each or more; strings with one ``c`` should be equal.

    Group totals are written out before they are joined back: a join that reads both sides
    from exchanges of its own is one whose hot keys Spark can split.
    """
    stretch = ["h", "u", "n"]
    differ = (F.min("u") != F.max("u")) | (F.min("n") != F.max("n"))
    groups = materialize(found.groupBy("h").agg(F.count("*").alias("k"), differ.alias("differ")).where("k > 1").select("h", "differ"), "groups")
    shared = materialize(found.join(groups, "h"), "shared")
    of = materialize(shared.where("differ").groupBy(*stretch).agg(F.count("*").alias("k"), F.min(F.struct("part", "row", "start", "n")).alias("one")), "classes")
    again = with_twin(shared.where("differ"), of, stretch)
    clean = shared.where("not differ").unionByName(again).select("part", "row", "start", (F.col("n") + (job.length - 1)).cast("int").alias("length"), F.xxhash64(*stretch).alias("c"))
    sizes = materialize(of.groupBy("h").agg(F.count("*").alias("different")), "sizes")
    classes = materialize(of.join(sizes, "h").select("one.part", "one.row", "one.start", "one.n", "h", (F.col("k") == 1).alias("single"), (F.col("different") > MOST_IN_TASK).alias("many")), "differing")
    out = clean.unionByName(compare(classes.where("not many").drop("many"), job))
    used = [groups, shared, of, sizes, classes]
    if not classes.where("many").isEmpty():
        more, tables = count_windows(classes.where("many").drop("many"), job)
        out, used = out.unionByName(more), [*used, *tables]
    out = materialize(out, "suffixes")
    release(*used)
    return out


def with_twin(rows: DataFrame, of: DataFrame, key: list[str]) -> DataFrame:
    """The stretches that occur whole more than once; ``of`` has their number k by ``key``.

    Those with over a thousandth of all rows are a thousand at most, and are broadcast;
    the others are joined, and no key of theirs has many rows.
    """
    many = max(1, (of.agg(F.sum("k")).first()[0] or 0) // 1000)
    hot = F.broadcast(of.where(F.col("k") > many).where("k > 1").select(*key))
    cold = of.where(F.col("k") <= many).where("k > 1").select(*key)
    return rows.join(hot, key, "left_semi").unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left_semi"))


class Strings:
    """The different strings of a part's suffixes, with their places and the names they go by."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.owner = array("i")
        self.triples: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.named: list[np.ndarray] = []

    def add(self, texts: Part, rows: pa.Table) -> None:
        """Suffixes of one batch, in order of their places."""
        row, start, size = columns(rows, "row", "start", "length")
        at = texts.place(row) + start
        raw, index, owner = memoryview(texts.buf), self.index, self.owner
        for n, a in zip(size.tolist(), at.tolist(), strict=True):
            owner.append(index.setdefault(raw[a : a + n].tobytes(), len(index)))
        self.triples.append(np.stack([row, start, size], axis=1).astype(np.int32))
        self.names.append(pc.fill_null(rows["c"], 0).to_numpy())
        self.named.append(np.asarray(rows["c"].is_valid()))

    def sorted(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strings in order, how many places each has and those, how many names each has and those."""
        strings = sorted(self.index)
        rank = np.zeros(len(strings), np.int64)
        rank[[self.index[s] for s in strings]] = np.arange(len(strings))
        owner, triple = rank[np.frombuffer(self.owner, np.int32)], np.concatenate(self.triples)
        fresh = np.ones(len(triple), bool)  # a place that two steps have named counts once
        fresh[1:] = (triple[1:] != triple[:-1]).any(axis=1)
        places = triple[fresh][np.argsort(owner[fresh], kind="stable")]
        named = np.concatenate(self.named)
        who, name = owner[named], np.concatenate(self.names)[named]
        order = np.lexsort((name, who))
        who, name = who[order], name[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (name[1:] != name[:-1])
        count = lambda x: np.bincount(x, minlength=len(strings)).astype(np.int32)
        return strings, count(owner[fresh]), places, count(who[first]), name[first]


def cuts_of(suffixes: DataFrame, job: Job, total: int, ranges: int) -> list[bytes]:
    """Keys between ranges; about SAMPLES_A_RANGE keys for each are drawn, whatever the input."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in of_parts(batches, job.folder):
            row, start = columns(rows, "row", "start")
            at, raw = (texts.place(row) + start).tolist(), memoryview(texts.buf)
            yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + KEY].tobytes() for a in at], pa.binary())], ["key"])

    drawn = suffixes.where(F.pmod(F.xxhash64("part", "row", "start"), F.lit(max(1, total // (ranges * SAMPLES_A_RANGE)))) == 0)
    sample = sorted({bytes(r.key) for r in by_part(drawn, job.parts, "row", "start").mapInArrow(keys, "key binary").collect()})
    return [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []


def sort_and_merge(suffixes: DataFrame, job: Job) -> DataFrame:
    """For each part with suffixes, which of its strings repeat; and names by their number of strings.

    Rows (part, ids, names, counts): ids of a part's strings that repeat elsewhere in
    one range, or, without a part, the names met in it and how many different strings
    go by each. A part's places are in a file named after it, whose content its
    suffixes decide: a task that is run again puts the same file in place of itself.
    """
    spark = suffixes.sparkSession
    # one row: the number and bytes of the suffixes
    total, size = suffixes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-size // RANGE_BYTES)))
    cuts = spark.sparkContext.broadcast(cuts_of(suffixes, job, total, ranges))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(job.folder)
        part, known = None, Strings()

        def out() -> Iterator[pa.RecordBatch]:
            """Sorted runs by range, and the places of every string in a file."""
            strings, sizes, place, counts, names = known.sorted()
            attempt = f"{plain}/{part}.{uuid.uuid4().hex}"
            with system.open_output_stream(attempt, compression=None) as f:
                np.savez(f, sizes=sizes, place=place)
            system.move(attempt, f"{plain}/{part}.places")
            q = [bisect_right(cuts.value, s[:KEY]) for s in strings]
            at = np.concatenate([[0], np.cumsum(counts)])
            first = 0
            while first < len(strings):
                end = bisect_right(q, q[first])
                columns_ = [pa.array([front_code(strings[first:end], first)], pa.binary()), pa.array([names[at[first] : at[end]].tobytes()], pa.binary()), pa.array([counts[first:end].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([q[first]], pa.int32()), *columns_], ["part", "q", "run", "names", "counts"])
                first = end

        for texts, rows in of_parts(batches, job.folder):
            if rows["part"][0].as_py() != part:
                if part is not None:
                    yield from out()
                part, known = rows["part"][0].as_py(), Strings()
            known.add(texts, rows)
        if part is not None:
            yield from out()

    def combine(table):
        runs = [bytes(x) for x in table["run"].to_pylist()]
        flat = [np.frombuffer(x, np.int64) for x in table["names"].to_pylist()]
        ends = [np.concatenate([[0], np.cumsum(np.frombuffer(x, np.int32))]) for x in table["counts"].to_pylist()]
        first = [first_id(x) for x in runs]
        met: Counter[int] = Counter()
        ids = repeated(runs, lambda r, i: flat[r][ends[r][i - first[r]] : ends[r][i - first[r] + 1]].tolist(), met)
        n = len(runs)
        return pa.table({
            "part": pa.concat_arrays([table["part"].combine_chunks(), pa.nulls(1, pa.string())]),
            "ids": pa.array([*[np.array(x, "<i4").tobytes() for x in ids], None], pa.binary()),
            "names": pa.array([*[None] * n, [*met]], pa.list_(pa.int64())),
            "counts": pa.array([*[None] * n, [*met.values()]], pa.list_(pa.int32())),
        })

    runs = by_part(suffixes, job.parts, "row", "start", "length").mapInArrow(sort, "part string, q int, run binary, names binary, counts binary")
    return materialize(runs.groupBy("q").applyInArrow(combine, "part string, ids binary, names array<long>, counts array<int>"), "merged")


def misnamed(merged: DataFrame) -> DataFrame:
    """(c): names that more than one string goes by."""
    return merged.where("part is null").select(F.inline(F.arrays_zip("names", "counts"))).groupBy(F.col("names").alias("c")).agg(F.sum("counts").alias("n")).where("n > 1").select("c")


def reexamined(suffixes: DataFrame, wrong: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``suffixes`` with every single window, nameless, in place of those of anchors that have a wrong name.

    A window starts in one stretch only, so no suffix is left at the place of a window.
    """
    at = lambda df, *more: df.select(F.col("part").alias("p"), F.col("row").alias("r"), F.col("start").alias("s"), *more)
    inside = lambda start, s, n: (start >= s) & (start < s + n)
    hit = at(suffixes.join(wrong, "c")).distinct()
    anchors = found.join(hit, (F.col("part") == F.col("p")) & (F.col("row") == F.col("r")) & inside(F.col("s"), F.col("start"), F.col("n"))).select("h").distinct()
    again = materialize(found.join(materialize(anchors, "anchors"), "h").select("part", "row", "start", "n"), "again")
    rest = suffixes.join(at(again, "n"), (F.col("part") == F.col("p")) & (F.col("row") == F.col("r")) & inside(F.col("start"), F.col("s"), F.col("n")), "left_anti")
    windows = F.explode(F.sequence("start", F.col("start") + F.col("n") - 1))
    return rest.unionByName(again.select("part", "row", windows.alias("start"), F.lit(length).alias("length"), F.lit(None).cast("long").alias("c")))


def remove(names: DataFrame, merged: DataFrame, job: Job) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) with removed: array of (start, end) in bytes."""
    repeats = merged.where("part is not null").groupBy("part").agg(F.collect_list("ids").alias("ids"))
    names = names.join(repeats, "part", "left")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(job.folder)
        for batch in batches:
            for item in batch.to_pylist():
                place = np.zeros((0, 3), np.int64)
                if item["ids"] is not None:
                    with system.open_input_file(f"{plain}/{item['part']}.places") as f, np.load(f) as saved:
                        flags = saved["sizes"] > 1
                        for ids in item["ids"]:
                            flags[np.frombuffer(ids, "<i4")] = True
                        place = saved["place"][np.repeat(flags, saved["sizes"])].astype(np.int64)
                    place = place[np.lexsort((place[:, 1], place[:, 0]))]
                texts = Part(job.folder, item["part"])
                while texts.next_batch():
                    here = place[np.searchsorted(place[:, 0], texts.first) : np.searchsorted(place[:, 0], texts.end)]
                    at = texts.place(here[:, 0]) + here[:, 1]
                    depth = np.zeros(len(texts.buf) + 1, np.int32)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + here[:, 2], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    rows = []
                    for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
                        mask, text = gone[a:b], texts.buf[a:b]
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        kept = text[~mask] if len(edges) else text
                        rows.append((b - a, b - a - len(kept), len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)]))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]
                    yield pa.RecordBatch.from_arrays([texts.batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return names.repartitionByRange(job.parts, "part").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """Removed bytes of every row of ``docs``; see ``remove`` for the columns. Any number of ``bits`` gives the same."""
    job = Job(fresh_path(docs.sparkSession, "texts"), length, gram, bits)
    listed = store(docs, job)
    names = materialize(listed.where("h is null").select("part").coalesce(1), "names")
    job = replace(job, parts=max(1, names.count()))
    found = listed.where("h is not null")
    suffixes = candidates(found, job)
    merged = sort_and_merge(suffixes, job)
    wrong = misnamed(merged)
    if not wrong.isEmpty():
        merged = sort_and_merge(materialize(reexamined(suffixes, materialize(wrong, "wrong"), found, length), "suffixes"), job)
    release(listed, suffixes)
    return remove(names, merged, job)
