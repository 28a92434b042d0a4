"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents, n_chars being the length of the text as it is then. Rows with
the same id are told apart by their texts; rows without id are treated like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastbreak.llm.common import free_name, shared_folder, table
from fastbreak.llm.packing import pack
from fastbreak.llm.secrets import scan_secrets
from fastbreak.llm.simhash import smallest_of_groups
from fastbreak.llm.suffix_array import remove_repeats
from fastbreak.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from fastbreak.sources.feeds import exists


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs).select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of these documents and the given labels."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return score_toxicity(docs, model, out=score).where(F.col(score) < THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return smallest_of_groups(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a document with a smaller id has too."""
    return _measured(remove_repeats(docs), docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each finding."""
    found = free_name(docs, "secrets")
    return _measured(scan_secrets(docs, out=found, redacted="text"), docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", cut_secrets),
    ("best_fit_packing", pack_documents),
]

#: Neither models, components nor tokenizers can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All stages over the whole documents table.

    path: a folder that the driver and all executors share, a new one if it is not given. A stage that is written
    there already is not computed again, so a run that has died goes on where it was.
    """
    path = path or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        if not exists(spark, f"{path}/{name}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
