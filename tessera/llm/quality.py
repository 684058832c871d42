"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Features are the distinct hashed words and word pairs of a text, each of weight
1/sqrt(their number). Training takes follow-the-regularised-leader updates over a
bounded sample of labelled rows; scoring is a sparse dot product for every row.

Defined cases: a null, empty or blank text has no features, so its score is the
bias alone; a label that is null or not 0 or 1 is left out of training; no usable
label gives every row the score 0.5; repeated rows each get a score, and a doc_id with
two labels has the larger; a long text is scored whole, as a slice of its own; rows
alike in the hash they are drawn by come by doc_id; an empty table gives an empty
result. Columns other than those named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec
from tessera.llm.scratch import small_batches

#: The fit takes at most so many labelled rows, drawn by hash, and so many of their features in all.
SAMPLE_ROWS, SAMPLE_FEATURES = 10_000, 1 << 25


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.1
    epochs: int = 3
    seed: int = 7


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, one after another, and the rows' offsets into them."""
    starts, ends, first = textvec.words(buf, offsets, ~textvec.SPACE)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    hashed = textvec.Rolling(buf).ranges(starts, ends)
    pairs = textvec.mix(hashed[:-1] * np.uint64(textvec.BASE) + hashed[1:])
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    inner = row[1:] == row[:-1]
    shift = np.uint64(64 - bits)
    keys = np.concatenate([(row << np.uint64(bits)) | (hashed >> shift), ((row[1:] << np.uint64(bits)) | (pairs >> shift))[inner]])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    at = np.searchsorted(keys >> np.uint64(bits), np.arange(rows + 1, dtype=np.uint64))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), at


def fit(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights, the bias last, from FTRL-proximal updates on rows of feature numbers, in a seeded order."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    draw = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for r in draw.permutation(len(rows)):
            i = np.append(rows[r], size)
            x = np.full(len(i), 1 / np.sqrt(max(1, len(i) - 1)))
            x[-1] = 0.1
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[r]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def drawn(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int, settings: Settings) -> DataFrame:
    """(draw, doc_id, y, f) of at most ``sample_rows`` labelled rows in order of a hash of doc_id; f: feature numbers.

    The sample is the same however the input is split. Texts of any length count;
    what is sorted is their features, which the number of bits bounds.
    """
    known = labels.where(F.col(target).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("y"))
    draw = F.xxhash64("doc_id", F.lit(settings.seed)).alias("draw")
    ids = known.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id").select("doc_id", "y", draw).orderBy("draw", "doc_id").limit(sample_rows)
    # ``sample_rows`` narrow rows at most
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").select("draw", "text", "doc_id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch):
                found, at = features(*textvec.utf8(part.column(1)), settings.bits)
                f = pa.array([found[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), f], ["draw", "doc_id", "y", "f"])

    # a doc_id of several rows brings them all, so rows are counted again
    return rows.mapInArrow(run, "draw long, doc_id long, y int, f binary").orderBy("draw", "doc_id", "f").limit(sample_rows)


def train(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int = SAMPLE_ROWS, settings: Settings = Settings()) -> np.ndarray:
    """Weights of a model of ``labels[target]``, fitted in one task on at most ``sample_rows`` rows.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out. Of the sample's rows, in
    order, those count whose features together are SAMPLE_FEATURES or fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        labels: list[int] = []
        total = 0
        for batch in batches:
            for y, f in zip(batch["y"].to_pylist(), batch["f"].to_pylist(), strict=True):
                total += len(f) // 4
                if total <= SAMPLE_FEATURES:
                    rows.append(np.frombuffer(f, "<i4"))
                    labels.append(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit(rows, np.array(labels), settings).astype("<f4").tobytes()], pa.binary())], ["w"])

    found = drawn(docs, labels, target, sample_rows, settings).mapInArrow(run, "w binary").collect()
    return np.frombuffer(found[0].w, "<f4") if found else np.zeros((1 << settings.bits) + 1, "<f4")


def probabilities(texts: pa.Array, w: np.ndarray, bits: int) -> np.ndarray:
    found, at = features(*textvec.utf8(texts), bits)
    sums = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
    dots = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(1, np.diff(at)))
    return 1 / (1 + np.exp(-np.clip(dots + 0.1 * float(w[-1]), -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a ``score`` column added: the estimated probability of label 1."""
    spark = docs.sparkSession
    bits = int(np.log2(len(weights) - 1))
    shared = spark.sparkContext.broadcast(weights.tobytes())
    scored = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, "<f4")
        for batch in batches:
            for part in textvec.slices(batch):
                p = probabilities(part.column(1), w, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    return scored.mapInArrow(run, "doc_id long, score double")


def passing(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more; no join is needed."""
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, "<f4")
        for batch in batches:
            for part in textvec.slices(batch, at):
                yield part.filter(pa.array(probabilities(part.column(at), w, bits) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score(docs, train(docs, labels, target)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
