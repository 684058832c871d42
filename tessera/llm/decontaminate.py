"""Benchmark decontamination by winnowing.

Both sides are word sequences. Fingerprints are the minimum k-gram hash of every
window of ``GUARANTEE`` words, so any shared run of that many words shares a
fingerprint. The tables of document and benchmark fingerprints are joined; every hit
is extended to the windows that it stands for, which are joined with the benchmark's
windows by their words, so hashes choose and words decide. Items with fewer words
than the guarantee are one window, and every stretch of as many words of a document
is a fingerprint of its own.

A Bloom filter of the benchmark's fingerprints, of FILTER_BITS bits at most whatever
the benchmark's size, keeps document fingerprints that cannot meet one out of the
join; what it lets through in error the join drops. Equal texts are looked at once.

Defined cases: a null or wordless text has no words and is never hit; a null item
text has no windows; a null item_id is left out of the item list but its hits
count; repeated items with one item_id count once; the leftmost of equal minima is a
window's fingerprint; a long text is a slice of its own, of which a task holds about
fifty bytes for each byte; an empty benchmark hits nothing; an empty document table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec
from tessera.llm.scratch import materialize, small_batches

GUARANTEE = 10
K = 5
#: Bits of the filter at most, bits for each fingerprint up to there, and places of a fingerprint in it.
FILTER_BITS, BITS_EACH, PLACES = 1 << 28, 64, 4
#: Texts that are broadcast to be left out at most; more are joined by their digests.
MOST_BROADCAST = 100_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD = textvec.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
WORD_PATTERN = re.compile(rb"[0-9a-z\x80-\xff]+")


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Position of the leftmost minimum of every full window."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    return np.argmin(sliding_window_view(grams, window), axis=1) + np.arange(len(grams) - window + 1)


def word_grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by the first."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = textvec.mix(out * np.uint64(textvec.BASE) + hashed[i : i + n])
    return out


def hashes(words: bytes) -> np.ndarray:
    """Hashes of the words of a text of words with spaces between."""
    buf = np.frombuffer(words, np.uint8)
    starts, ends, _ = textvec.words(buf, np.array([0, len(buf)]), WORD)
    return textvec.Rolling(buf).ranges(starts, ends)


def selected(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of word hashes: the fingerprint of every window of GUARANTEE words, and the word at which it stands."""
    grams = word_grams(hashed, K)
    at = winnow(grams, GUARANTEE - K + 1)
    return grams[at], at


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(m, fp, words, item) of every window of m words of the benchmark, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = WORD_PATTERN.findall((text.as_py() or "").encode().lower())
                if not found:
                    continue
                m = min(len(found), GUARANTEE)
                hashed = hashes(b" ".join(found))
                fp = selected(hashed)[0] if m == GUARANTEE else word_grams(hashed, m)
                n = len(fp)
                yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int32()), pa.array(fp.view(np.int64)), pa.array([b" ".join(found[i : i + m]) for i in range(n)], pa.binary()), pa.array([item] * n, pa.int64())], ["m", "fp", "words", "item"])

    rows = small_batches(benchmark).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "m int, fp long, words binary, item long").distinct()


def places(fp: np.ndarray, m: np.ndarray | int, bits: int) -> np.ndarray:
    """Places of fingerprints of windows of ``m`` words in a filter, one row for each of PLACES."""
    h = textvec.mix(fp + np.uint64(textvec.BASE) * np.asarray(m, np.uint64))
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PLACES)]).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """Bloom filter of fingerprints; ``short``: numbers of words under the guarantee that items have."""

    bits: bytes
    short: tuple[int, ...]

    def may_have(self, fp: np.ndarray, m: int) -> np.ndarray:
        table = np.frombuffer(self.bits, np.uint8)
        at = places(fp, m, 8 * len(table))
        return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def filter_of(prints: DataFrame) -> Filter:
    """Filter of (m, fp); the bits are set in tasks and meet here in pages of 4 KB, FILTER_BITS in all at most."""
    # one number, and one row for each length under the guarantee
    total = prints.count()
    short = sorted(r.m for r in prints.where(F.col("m") < GUARANTEE).select("m").distinct().collect())
    bits = min(FILTER_BITS, 1 << max(20, (BITS_EACH * total).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch["fp"].to_numpy().view(np.uint64), batch["m"].to_numpy(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["page", "bit"])

    pages = prints.mapInArrow(run, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = bytearray(bits // 8)
    for r in pages:
        table[4096 * r.page : 4096 * (r.page + 1)] = r.bits
    return Filter(bytes(table), tuple(short))


WINDOW = pa.struct([("pos", pa.int32()), ("words", pa.binary())])
PRINTS = pa.list_(pa.struct([("m", pa.int32()), ("fp", pa.int64()), ("windows", pa.list_(WINDOW))]))
PRINTS_DDL = "array<struct<m:int,fp:long,windows:array<struct<pos:int,words:binary>>>>"


def chosen(f: Filter, texts: pa.Array) -> Iterator[tuple[int, list[dict]]]:
    """Number of words of each text, and its fingerprints that the filter lets through with the windows they stand for."""
    buf, offsets = textvec.utf8(texts)
    buf = LOWER[buf]
    starts, ends, first = textvec.words(buf, offsets, WORD)
    hashed = textvec.Rolling(buf).ranges(starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n, out = b - a, []

        def window(i: int, m: int) -> dict:
            return {"pos": i, "words": b" ".join([buf[x:y].tobytes() for x, y in zip(starts[a + i : a + i + m], ends[a + i : a + i + m], strict=True)])}  # noqa: B023

        if n >= GUARANTEE:
            fp, at = selected(hashed[a:b])
            change = np.flatnonzero(np.diff(at, prepend=-1))  # windows with one fingerprint follow each other
            hit = np.flatnonzero(f.may_have(fp[change], GUARANTEE))
            last = np.append(change[1:], len(at))
            out += [{"m": GUARANTEE, "fp": int(fp[change[k]].view(np.int64)), "windows": [window(i, GUARANTEE) for i in range(change[k], last[k])]} for k in hit.tolist()]
        for m in f.short:
            if n >= m:
                fp = word_grams(hashed[a:b], m)
                out += [{"m": m, "fp": int(fp[i].view(np.int64)), "windows": [window(i, m)]} for i in np.flatnonzero(f.may_have(fp, m)).tolist()]
        yield n, out


def sifted(docs: DataFrame, f: Filter, every: bool) -> DataFrame:
    """(doc_id, n_words, key, prints): key, the text's digest, and prints are null for texts that cannot be hit.

    ``every``: rows of those too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(f)  # FILTER_BITS at most
    names = ["doc_id", "n_words", "key", "prints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch):
                n, prints = zip(*chosen(shared.value, part.column(1)), strict=True)
                keys = [hashlib.sha256((t.as_py() or "").encode()).hexdigest() if p else None for t, p in zip(part.column(1), prints, strict=True)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array([p or None for p in prints], PRINTS)], names)
                yield out if every else out.filter(out["key"].is_valid())

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, key string, prints {PRINTS_DDL}")


def hits(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(key, m, pos, item): windows of texts (key, prints), each text once, that are windows of the benchmark."""
    met = prints.select("key", F.inline("prints")).join(items.select("m", "fp").distinct(), ["m", "fp"], "left_semi")
    windows = met.select("key", "m", F.inline("windows"))
    return windows.join(items.select("m", "words", "item"), ["m", "words"]).select("key", "m", "pos", "item")


def looked_up(docs: DataFrame, benchmark: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """``sifted`` rows, and the hits of their texts."""
    items = materialize(item_windows(benchmark), "items")
    rows = materialize(sifted(docs, filter_of(items.select("m", "fp").distinct()), every), "sifted")
    once = materialize(rows.where("key is not null").select("key", "prints").dropDuplicates(["key"]), "texts")
    return rows, materialize(hits(once, items), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    rows, found = looked_up(docs, benchmark, True)
    spans = F.array_sort(F.collect_list(F.struct("pos", "m")))
    # words in any window: what each window adds beyond the ends of those before it
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(F.greatest(acc["end"], x["pos"] + x["m"]).alias("end"), (acc["n"] + F.greatest(x["pos"] + x["m"] - F.greatest(acc["end"], x["pos"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    words = found.select("key", "m", "pos").distinct().groupBy("key").agg(covered.alias("n_hit"))
    listed = F.array_sort(F.collect_list(F.col("item").cast("string")))
    items = found.where("item is not null").select("key", "item").distinct().groupBy("key").agg(listed.alias("items"))
    of = materialize(words.join(items, "key", "left").select("key", "n_hit", "items"), "found")
    none = F.array().cast("array<string>")
    some = rows.where("key is not null").select("doc_id", "n_words", "key").join(of, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    out = rows.where("key is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items")).unionByName(some)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item hits; a null text is kept."""
    _, found = looked_up(docs, benchmark, False)
    free = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    bad = materialize(found.select(F.col("key").alias(free)).distinct(), "contaminated")
    if bad.count() <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    return docs.join(bad, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256) == F.col(free), "left_anti")
