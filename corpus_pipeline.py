"""Documents to packed training sequences: five of the numbered operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import stages
from lotlens.llm.common import saved, table

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("benchmark_decontamination", stages.without_benchmark),
    ("secret_scans", stages.secrets),
    ("packing", stages.packing),
]

#: Trained weights, hashes and byte-pair merges aren't SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
