"""A corpus pipeline of five operators; each stage's rows are written as Parquet and read again by the next one.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, no rows and columns that are named
like the operators' own; the operators say what each gives. Stages but the last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import mixing, near_dedup, secret_scan, sentencepieces, toxicity
from claimgraph.llm.runtime import delete, hold, shared_dir, tables


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the field, trained on this input's labelled rows, finds toxic. Null and empty texts stay, as do
    null ids of clean texts; repeated rows share a fate; no rows give no rows."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates, and one of repeated rows. Rows with a
    null id and texts without words stay."""
    return near_dedup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in place of each secret; every document stays, null and empty texts as they are."""
    return secret_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the sources' target weights; none is left out. A null source is one, a null id a document."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all texts, decoded again as a check; copies of a document get the same one."""
    return sentencepieces.encode(docs)


STAGES = [("toxicity", toxic), ("near_dedup", dedup), ("secret_scan", secrets), ("mixing", mix), ("sentencepieces", pieces)]

#: A trained field and sampled roundings aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. A stage's table is deleted once the next one is written, and what it used itself; the
    last one's stays until runtime.clear()."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    at = f"{shared_dir(spark).rstrip('/')}/claimgraph/pipeline-{uuid.uuid4().hex}"
    hold(at)
    for name, stage in STAGES:
        with tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, before)
        before = f"{at}/{name}"
    return docs
