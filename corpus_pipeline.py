"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes every stage's result as Parquet in the shared folder and gives
what it reads back to the next, and removes a stage's working tables and input once
its result is written. All stages but the last return the columns of ``docs``. No SQL
states the whole: the classifier is learned.

In all stages a null text counts as an empty one, columns other than those named pass
through whatever their names, a text of any length is taken whole, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality, secrets, simhash
from tessera.llm.scratch import materialize, release, working

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Repeated rows are each judged; a null doc_id is judged like any other; a score at the threshold stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.passing(docs, quality.train(docs, labels, "quality"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies stays, null ids last.

    All wordless texts are one group; of rows alike in doc_id and group one stays.
    """
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; wordless ones stay, repeated rows share their fate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text, and is null for a null text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of at most 4096 tokens; a wordless text is its end mark."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with working(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        if before is not None:
            release(before)
        before = docs
    return docs
