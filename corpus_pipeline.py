"""Corpus pipeline over the documents table: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import decontaminate, langid, line_dedup, pieces, simhash
from codequarry.llm.common import read, shared_dir

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: Fingerprints, suffix arrays and pieces are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
