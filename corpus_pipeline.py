"""The document pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes the documents that the one before kept and returns them with its decisions in effect; the last returns the pieces of the
packed sequences. `run` writes every stage's result to the shared folder and rereads it, so a lost executor costs no earlier stage; a stage's own tables are deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seismolake.llm import ngram_join, packing, pii, quality, suffix_dedup
from seismolake.llm.common import fresh_dir, scratch, table

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("PII", pii.stage),
    ("packing", packing.stage),
]

#: Token ids can't be had in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_dir(spark, name.replace(" ", "_"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
