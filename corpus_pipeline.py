"""A training corpus from raw documents: filter, clean, deduplicate, mask and pack them, a stage at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions.session import scratch_path
from cardmill.llm.common import documents, labels
from cardmill.llm.line_dedup import remove_repeated_runs
from cardmill.llm.packing import pack_documents
from cardmill.llm.queries import default_vocabulary
from cardmill.llm.secrets import mask_secrets
from cardmill.llm.simhash import keep_first_of_each
from cardmill.llm.toxicity import fit, score_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language."""
    scored = score_documents(docs, fit(docs, labels(spark, sf_dir)))
    return scored.filter(F.col("_score") < F.col("_threshold")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs that an earlier place has: three or more lines, or fewer with 50 words or more."""
    return counted(remove_repeated_runs(docs, 3, 50))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return keep_first_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by their kind."""
    return counted(docs.withColumn("text", mask_secrets("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token of the documents in sequences of 1,024."""
    return pack_documents(docs, default_vocabulary(), 1024, 2)


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no trained classifier and no token vocabulary; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read again.

    The written tables stay until the application ends.
    """
    docs = documents(spark, sf_dir)
    folder = scratch_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
