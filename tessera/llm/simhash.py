"""SimHash near-duplicates by multi-index hashing.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Two fingerprints at Hamming distance 3 or less differ by one bit at
most in one of their two 32-bit halves. Each half is a table; a fingerprint looks
up every value of the radius-1 ball around each of its halves and the complete
distance decides. Only distinct fingerprints are compared.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like
any other; a text with fewer words than a shingle is one shingle; repeated rows
each get a row; a null ``doc_id`` keeps a null and is never a component's name
unless the component has no other; a long text is a slice of its own, of which a task
holds about sixty bytes for each byte; an empty table gives an empty result. Columns
other than the two read are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import parts, textvec, xxh
from tessera.llm.graph import components
from tessera.llm.scratch import fresh_path, materialize, small_batches

SEED = 42
RADIUS = 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def prints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Unsigned fingerprints of a column of texts."""
    buf, offsets = textvec.utf8(texts)
    buf = LOWER[buf]
    starts, ends, first = textvec.words(buf, offsets, ~textvec.SPACE)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # words with one space after each
    kept = ~textvec.SPACE[buf]
    kept[ends[ends < len(buf)]] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    joined = buf[kept]
    joined[textvec.SPACE[joined]] = 0x20
    starts, ends = place[starts], place[ends]
    words = np.diff(first)
    n = np.where(words > shingle, words - shingle + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(n)), n)
    word = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(word + shingle, first[row + 1]) - 1
    hashed = xxh.hashes(joined, starts[word], ends[last], SEED)
    some = n > 0
    out[some] = xxh.majority(hashed, (np.cumsum(n) - n)[some])
    return out


def of_batch(texts: pa.Array, shingle: int) -> pa.Array:
    """Signed fingerprints, a slice of texts at a time."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *[prints(part.column(0), shingle) for part in textvec.slices(batch, 0, 1 << 20)]]).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), of_batch(batch.column(1), shingle)], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at distance RADIUS or less."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    table = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("value")), F.struct(F.lit(1).alias("half"), high.alias("value")))).alias("k")).select("fp", "k.half", "k.value")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = table.select(F.col("fp").alias("a"), "half", F.explode(F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    entries = table.withColumnRenamed("fp", "b")
    return probes.join(entries, (probes.half == entries.half) & (probes.value == entries.value) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def classes(fps: DataFrame, best: Column) -> DataFrame:
    """(fp, root, best): each distinct fingerprint, its component's name and an aggregate of its rows."""
    least = materialize(fps.groupBy("fp").agg(best.alias("best")), "classes")
    roots = components(links(least.select("fp")))
    return least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    named = classes(fps, F.min("doc_id"))
    least = named.groupBy("root").agg(F.min("best").alias("component_id"))
    # written out, so that the join reads two exchanges and a hot fingerprint can be split
    labels = materialize(named.join(least, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of ``docs``, all columns, for each component: that with the least doc_id, null ids last.

    Of rows alike in doc_id any one stays. Rows are written to part files together with
    their fingerprints and taken back by place, so no text is read twice or shuffled.
    """
    folder = fresh_path(docs.sparkSession, "rows")
    text, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def facts(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(key).cast(pa.int64()), of_batch(batch.column(text), shingle)]

    listed = parts.store(docs, folder, text, facts, "doc_id long, fp long")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "part", "row"))
    kept = classes(listed, best).groupBy("root").agg(F.min("best").alias("best")).select("best.part", "best.row")
    many = listed.select("part").distinct().count()
    return parts.take(kept, folder, max(1, many), docs.schema)
