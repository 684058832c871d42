"""Best-fit packing of token pieces, after Martello-Toth reduction.

Lengths are whole numbers up to the sequence limit, so an instance of any number of
pieces is a histogram with at most that many bars. The reduction and best-fit
decreasing run on the histogram, whole groups of equal bins at a time; their work
and memory depend on the limit and not on the rows. Each piece then finds its place
by its rank among the pieces of its length, which a range-dealt running sum gives.

Reduction: for a length j, a set with j in it that dominates every other feasible
set with j is fixed for as many bins as the counts allow. Three provable cases: j
alone, where nothing fits beside it; j with the largest fitting piece, where that
fills the bin or no two pieces fit; j with two pieces, where no three fit and no
other pair is better in its smaller piece.

Defined cases: a null or empty text is the end id alone; repeated rows are separate
pieces, and rows alike in doc_id and ids may change places; a text of any length is
encoded a million characters at a time and cut into pieces; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, running_sum, small_batches

LIMIT = 4096
END_ID = 1
#: Bytes of words and ids that a worker remembers, twice over.
REMEMBERED_BYTES = 48 << 20
#: Characters of a text that are split into words at a time.
SLICE_CHARS = 1 << 20
#: Marks that are cut from the end of a word.
MARKS = ".,;:!?%$&#*|)(\"-"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian bytes, word by word with a bounded memory of words.

    Valid for tokenizers that never join across a space, tab or line break and cut
    letters from marks, as those that drop white space; lower case only if so is the
    tokenizer. Closing marks are cut off only where every character before them is a
    letter to the tokenizer itself, after its own normalisation; other words are
    encoded whole. Two generations of words are remembered; the older one goes as a
    whole, so little more than twice ``remembered`` bytes are held.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.safe = set(string.ascii_letters)
        self.remembered, self.held = remembered, 0

    def __call__(self, text: str) -> bytes:
        if self.held > self.remembered:
            self.older, self.known, self.held = self.known, {"": b""}, 0
        if len(text) <= SLICE_CHARS:
            return self.ids(words(text))
        return b"".join(map(self.ids, stretches(text)))

    def ids(self, found: list[str]) -> bytes:
        if new := set(found).difference(self.known):
            self.learn(new)
        return b"".join(map(self.known.__getitem__, found))

    def letter(self, c: str) -> bool:
        """Whether the tokenizer takes ``c`` as a letter, between letters and before a mark."""
        cut = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(s)))
        return c.isalpha() and (cut(f"a{c}a"), cut(f"{c}."), cut(c)) == (1, 2, 1)

    def word(self, s: str) -> bool:
        """Whether ``s`` is letters only, to the tokenizer."""
        if self.safe.issuperset(s):
            return True
        fresh = set(s).difference(self.safe)
        self.safe.update(c for c in fresh if self.letter(c))
        return self.safe.issuperset(fresh)

    def learn(self, new: set[str]) -> None:
        known, older, letters = self.known, self.older, self.safe.issuperset
        if again := older.keys() & new:
            known.update({w: older[w] for w in again})
            new = new.difference(again)
        plain: set[str] = set()
        mixed: list[str] = []
        made: list[str] = []  # words of another case or with closing marks, and their parts
        cores: list[str] = []
        marks: list[str] = []
        for w in new:
            if letters(w):
                core, mark = w, ""
            else:
                core = w.rstrip(MARKS)
                if not letters(core) and not self.word(core):
                    mixed.append(w)
                    continue
                mark = w[len(core) :]
                plain.add(mark)
            if core.isascii():
                core = core.lower()
            plain.add(core)
            if core is not w and core != w:
                made.append(w)
                cores.append(core)
                marks.append(mark)
        plain = plain.difference(known)
        if again := older.keys() & plain:
            known.update({p: older[p] for p in again})
            plain = plain.difference(again)
        self.encode([*plain], mixed)
        get = known.__getitem__
        known.update(zip(made, map(bytes.__add__, map(get, cores), map(get, marks))))
        self.held += sum(map(len, new)) + 200 * (len(new) + len(plain))

    def encode(self, plain: list[str], mixed: list[str]) -> None:
        """Ids of new words; the plain ones, all letters or all marks, some hundred in one text and cut where words end."""
        for first in range(0, len(plain), 250):
            some = plain[first : first + 250]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                mixed += some
                continue
            raw, at = ids.tobytes(), 0
            for p, end in zip(some, (4 * ends).tolist(), strict=True):
                self.known[p] = raw[at:end]
                at = end
        for p, e in zip(mixed, self.tokenizer.encode_batch_fast(mixed, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes()


def words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def stretches(text: str) -> Iterator[list[str]]:
    """The words of a long text, about SLICE_CHARS characters at a time, cut at spaces only."""
    text, at = text.replace("\n", " ").replace("\t", " ").replace("\r", " "), 0
    while at < len(text):
        end = text.find(" ", at + SLICE_CHARS)
        end = len(text) if end < 0 else end + 1
        yield text[at:end].split(" ")
        at = end


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks that a worker runs, so that words are remembered across them."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut into pieces."""
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list[int | None]] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if f == "piece" else pa.int64()) for f, c in zip(fields, out, strict=True)], fields)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """``count`` equal bins; ``items`` are (length, how many) in the order placed."""

    count: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)


def reduce_(counts: dict[int, int], limit: int) -> list[Bins]:
    """Fix dominating sets; takes their pieces out of ``counts``."""
    fixed: list[Bins] = []
    lengths = sorted(x for x, n in counts.items() if n)

    def take(lengths_used: list[int]) -> None:
        each = {x: lengths_used.count(x) for x in lengths_used}
        t = min(counts[x] // n for x, n in each.items())
        for x, n in each.items():
            counts[x] -= n * t
            if not counts[x]:
                lengths.pop(bisect_left(lengths, x))
        fixed.append(Bins(t, limit - sum(lengths_used), sorted(each.items(), reverse=True)))

    def largest(most: int, used: list[int]) -> int | None:
        """Largest length up to ``most`` with a piece left beside ``used``."""
        i = bisect_right(lengths, most) - 1
        while i >= 0 and counts[lengths[i]] <= used.count(lengths[i]):
            i -= 1
        return lengths[i] if i >= 0 else None

    def smallest(used: list[int], n: int) -> int:
        """Total of the ``n`` smallest pieces beside ``used``; past the limit if there are fewer."""
        total = 0
        for x in lengths:
            k = min(n, counts[x] - used.count(x))
            total, n = total + k * x, n - k
            if not n:
                return total
        return limit + 1

    for j in sorted(lengths, reverse=True):
        while counts[j]:
            room = limit - j
            a = largest(room, [j])
            if a is None:
                take([j])
            elif a == room or smallest([j], 2) > room:
                take([j, a])
            elif smallest([j], 3) > room and (b := largest(room - a, [j, a])) is not None and bisect_right(lengths, room // 2) == bisect_right(lengths, b):
                take([j, a, b])
            else:
                break
    return fixed


def best_fit(counts: dict[int, int], limit: int) -> list[Bins]:
    """Best-fit decreasing, equal bins at a time."""
    open_: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(b: Bins) -> None:
        if b.count:
            if b.room not in open_:
                open_[b.room] = []
                insort(rooms, b.room)
            open_[b.room].append(b)

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[x]
        while left:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                b = Bins(-(-left // (limit // x)), limit)
            else:
                b = open_[rooms[i]].pop()
                if not open_[rooms[i]]:
                    del open_[rooms.pop(i)]
            each = b.room // x
            full = min(b.count, left // each)
            put(Bins(full, b.room - each * x, [*b.items, (x, each)]))
            left -= full * each
            rest = b.count - full
            if rest and left and left < each:
                put(Bins(1, b.room - left * x, [*b.items, (x, left)]))
                left, rest = 0, rest - 1
            put(Bins(rest, b.room, b.items))
    return [b for bs in open_.values() for b in bs]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[Bins]:
    counts = dict(counts)
    return reduce_(counts, limit) + best_fit(counts, limit)


def intervals(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces for each bin), by length and rank."""
    rows, used, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for x, each in b.items:
            rows.append((x, used.get(x, 0), sequence, offset, each))
            used[x] = used.get(x, 0) + each * b.count
            offset += x * each
        sequence += b.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``."""
    cut = materialize(pieces(docs, path or tokenizer_path(), limit), "pieces")
    # one row for each length: ``limit`` at most
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = cut.sparkSession.sparkContext.broadcast(intervals(plan(counts, limit)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = running_sum(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank").select(*names, F.col("rank").cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = t[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            inside = rank - row[:, 1]
            sequence, offset = row[:, 2] + inside // row[:, 4], row[:, 3] + inside % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
